"""K02, K03, K08 over stored tables: idempotent merges into files that are partitioned by a hash of the key.

A table is a folder of Parquet files in `parts` partitions. A merge reads the partitions that its source touches, finds the
rows that really change, and rewrites those rows' partitions only; a merge that changes nothing writes nothing. So the same
batch may come twice, as it does when a stream starts again after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from newsloom.operators.shared import materialize

PARTS = 64
_PART = "_part"


def create(df: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """Write df, whose keys are unique and not null, as a stored table. One key is one partition, so no partition holds a hot group."""
    placed = df.withColumn(_PART, _part(F.col(key), parts))
    placed.repartition(_PART).write.partitionBy(_PART).parquet(path)


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def table(spark: SparkSession, path: str, columns: str | StructType | None = None) -> DataFrame:
    """The rows of a stored table; one that was never written is empty if its columns are given."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        if columns is None:
            raise
        return spark.createDataFrame([], columns)
    return found.drop(_PART)


def _picked(source: DataFrame, key: str) -> DataFrame:
    """One row a key, the one that comes last by its columns: combined before the shuffle. Rows without key are left out."""
    best = F.max(F.struct(*[F.col(f"`{c}`") for c in source.columns])).alias("one")
    return source.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(best).select("one.*")


def merge(spark: SparkSession, path: str, source: DataFrame, key: str, update: list[str] | None = None, gone: Column | None = None, parts: int = PARTS, flip: bool = False) -> dict[str, int]:
    """Merge source into the table at path: how many rows were inserted, updated and deleted, and how many partitions written.

    Rows of new keys go in; of keys that are there the `update` columns are replaced (none: they stay, K02). Where `gone`,
    over source's columns, is true the key is deleted instead; with `flip` so is every key that is there. source has the table's columns and maybe more; of rows that
    repeat a key the greatest counts. Null keys are left out. The table is created where there is none.
    """
    update, gone = update or [], F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    new = materialize(_picked(source.withColumn("_gone", gone), key).withColumn(_PART, _part(F.col(key), parts)))
    touched = [r[0] for r in new.select(_PART).distinct().collect()]  # at most `parts` numbers
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        fresh = new.where("NOT _gone")
        inserted = fresh.count()
        if inserted:
            fresh.drop("_gone").repartition(_PART).write.partitionBy(_PART).parquet(path)
        return {"inserted": inserted, "updated": 0, "deleted": 0, "written": len(touched) if inserted else 0}
    columns = [c for c in old.columns if c != _PART]
    old = old.where(F.col(_PART).isin(touched))
    both = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), [_PART, key], "full_outer")
    differs = F.lit(False)
    for c in update:
        differs = differs | ~F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`"))
    kind = (
        F.when(F.col("_old").isNull(), F.when(~F.col("_gone"), F.lit("inserted"))).when(F.col("_new").isNull(), None)
        .when(F.col("_gone") | F.lit(flip), F.lit("deleted")).when(differs, F.lit("updated"))
    )
    value = lambda c: F.col(key) if c == key else F.when(F.col("_old").isNull() | F.lit(c in update) & F.col("_new").isNotNull(), F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`"))
    rows = both.select(_PART, kind.alias("_kind"), F.col("_old").isNull().alias("_alien"), *[value(c).alias(c) for c in columns])
    rows = materialize(rows)  # the table is read here and overwritten below
    counts = {r["_kind"]: r["n"] for r in rows.where("_kind IS NOT NULL").groupBy("_kind").agg(F.count("*").alias("n")).collect()}
    written = [r[0] for r in rows.where("_kind IS NOT NULL").select(_PART).distinct().collect()]
    if written:
        kept = rows.where(F.col(_PART).isin(written) & ~(F.col("_kind").eqNullSafe("deleted") | (F.col("_alien") & F.col("_kind").isNull())))
        emptied = set(written) - {r[0] for r in kept.select(_PART).distinct().collect()}
        out = kept.select(*columns, _PART)
        out.repartition(_PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(path)
        for p in emptied:  # dynamic overwriting leaves partitions alone that get no row
            spark.createDataFrame([], out.drop(_PART).schema).write.mode("overwrite").parquet(f"{path}/{_PART}={p}")
    return {k: counts.get(k, 0) for k in ("inserted", "updated", "deleted")} | {"written": len(written)}


def toggle(spark: SparkSession, path: str, keys: DataFrame, key: str, parts: int = PARTS) -> dict[str, int]:
    """Keys (key, further columns) that are stored go, the others are stored: bookmarks and follows. A repeated key counts once."""
    return merge(spark, path, keys, key, parts=parts, flip=True)


def merge_stream(stream: DataFrame, path: str, key: str, update: list[str], checkpoint: str, parts: int = PARTS, after: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Merge every batch of a stream; `after` hears a batch's number and counts.

    A batch that was merged is written down beside the table, so one that comes again after a failure is passed over; one
    that failed midway is merged again, to the same result.
    """
    done = f"{path.rstrip('/')}-batches"

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if table(spark, done, "batch long").where(F.col("batch") == number).limit(1).count():
            return
        counts = merge(spark, path, batch, key, update, parts=parts)
        spark.createDataFrame([(number,)], "batch long").write.mode("append").parquet(done)
        if after is not None:
            after(number, counts)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
