"""Reads of a database over JDBC in which the database does the work that it can. Columns are named as it spells them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A table; filters and columns are left to the database. With a whole-number key it is read in `parts` ranges of it at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key is not None and parts > 1:
        low, high = query(spark, url, f'SELECT MIN("{key}") AS "low", MAX("{key}") AS "high" FROM {name}', **options).first()
        if low is not None:
            reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts))
    return reader.load()


def query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


def one(spark: SparkSession, url: str, name: str, key: str, value: object, *columns: str, **options: str) -> tuple:
    """The columns of the one row with that key; ValueError if there is none, or more than one."""
    found = table(spark, url, name, **options).where(F.col(key) == F.lit(value)).select(*columns).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} rows of {name} have that {key}")
    return tuple(found[0])


def newest(spark: SparkSession, url: str, name: str, by: list[str], limit: int = 20, rows: str = "FETCH FIRST {} ROWS ONLY", **options: str) -> DataFrame:
    """The first rows in descending order of columns, sorted and cut by the database. rows is how it says so, for other dialects."""
    order = ", ".join(f'"{c}" DESC' for c in by)
    return query(spark, url, f"SELECT * FROM {name} ORDER BY {order} {rows.format(int(limit))}", **options).orderBy(*[F.desc(c) for c in by])
