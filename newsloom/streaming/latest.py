"""A04 on a stream: the last row of each key and the place of its first, given again whenever either changes.

A stream's own state (last_wins_stream) is one value a key, the row as JSON, kept by RocksDB on executors' disks and in the
checkpoint. Keys that nothing has come for leave it after their time to live; what comes later begins anew. Where a table is
kept (store_latest), it is the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from newsloom.operators import stored
from newsloom.operators.shared import apart

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start while this lasts keep their state in RocksDB, which this kind of state asks for."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class _Last(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "at long, first long, row string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        at, first, row = old or (None, None, None)
        for pdf in rows:
            i = pdf["at"].idxmax()
            low, high = int(pdf["at"].min()), int(pdf["at"][i])
            first = low if first is None else min(first, low)
            if at is None or high > at:
                at, row = high, pdf["row"][i]
        if old is None or (at, first) != (old[0], old[1]):
            self.state.update((at, first, row))
            yield pd.DataFrame({"at": [at], "first_seq": [first], "row": [row]})

    def close(self) -> None:
        pass


def last_wins_stream(stream: DataFrame, key: str, order: str = "seq", ttl_seconds: int | None = None) -> DataFrame:
    """A stream's rows -> the last row of each key, in its columns, with first_seq: one for every key that a batch changes, in update mode.

    `order` is a whole number and unique: batches may come in any order, rows of a batch too. Rows without it are left out;
    rows without key are one key, as in a batch. Start it within rocksdb(spark).
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in stream.columns])
    rows = stream.where(F.col(order).isNotNull()).select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"), F.to_json(columns).alias("row"))
    ttl = None if ttl_seconds is None else ttl_seconds * 1000
    out = rows.groupBy("key").transformWithStateInPandas(_Last(ttl), "at long, first_seq long, row string", "Update", "None" if ttl is None else "ProcessingTime")
    return out.select(F.from_json("row", stream.schema).alias("last"), "first_seq").select("last.*", "first_seq")


def store_latest(stream: DataFrame, path: str, key: str, checkpoint: str, order: str = "seq", parts: int = stored.PARTS) -> StreamingQuery:
    """Keep the table at path at the last row of each key, with first_seq; rows without key or `order` are not stored. Ends when all that is there is read.

    The table is the state: a batch is combined to a row a key and joined with it, and what changes is merged. So no key is
    handled alone, and a batch that comes again changes nothing.
    """
    columns, update = stream.columns, [c for c in [*stream.columns, "first_seq"] if c != key]

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(key).isNotNull() & F.col(order).isNotNull())
        last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.col(order)).alias("last")
        new = rows.groupBy(F.col(key).alias("_key")).agg(last, F.min(order).cast("long").alias("first"))
        held = stored.table(batch.sparkSession, path, batch.withColumn("first_seq", F.lit(0).cast("long")).schema)
        held = held.select(F.col(key).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("old"), F.col("first_seq").alias("old_first"))
        met = apart(new).join(held, "_key", "left")
        later = F.col("old").isNull() | (F.col(f"last.`{order}`") > F.col(f"old.`{order}`"))
        changed = met.where(later | (F.col("first") < F.col("old_first")))
        rows = changed.select(F.when(later, F.col("last")).otherwise(F.col("old")).alias("row"), F.least("first", "old_first").alias("first_seq"))
        stored.merge(batch.sparkSession, path, rows.select("row.*", "first_seq"), key, update, parts=parts)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
