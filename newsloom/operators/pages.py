"""W07 by seeking: a table stored in ranges of its order, so a page reads the files that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PART = "_range"


def store(df: DataFrame, path: str, order: list, ranges: int = 200) -> None:
    """Write df in ranges of `order`, a folder each, beside a table of how many rows each has and how many come before it.

    `order` is total, or rows that tie may change places between pages.
    """
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(_PART, F.spark_partition_id())
    placed.write.partitionBy(_PART).parquet(f"{path}/rows")
    df.limit(0).write.parquet(f"{path}/columns")  # what a table without rows looks like
    sizes = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows").groupBy(_PART).agg(F.count("*").alias("n"))  # from the files' footers: a row a range
    before = F.sum("n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    sizes.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/ranges")


def page(spark: SparkSession, path: str, order: list, number: int, size: int) -> DataFrame:
    """Rows of one page, with page and total_pages; the number is held between 1 and the last. Only the ranges that hold it are read."""
    ranges = spark.read.parquet(f"{path}/ranges")
    total = ranges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    first, end = (number - 1) * size, number * size
    held = ranges.where((F.col("before") < end) & (F.col("before") + F.col("n") > first)).select(_PART, "before").collect()  # a page's ranges
    columns = spark.read.parquet(f"{path}/columns").schema.add(_PART, "integer")
    rows = spark.read.schema(columns).parquet(f"{path}/rows").where(F.col(_PART).isin([r[_PART] for r in held])).drop(_PART)
    skip = first - min((r["before"] for r in held), default=first)
    return rows.orderBy(*order).offset(skip).limit(size).withColumns({"page": F.lit(number), "total_pages": F.lit(pages)})
