"""K05, A13 with timings: runs are counted by the write itself, failures are rows too."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from newsloom.operators.dedupe import last_wins

SUCCESS, FAILED = "success", "failed"
LOG = "provider string, fetched long, inserted long, skipped long, classified long, started_at timestamp, completed_at timestamp, status string, error string"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def _row(provider: str, fetched: int, inserted: int, started: dt.datetime, error: str | None) -> tuple:
    return provider, fetched, inserted, fetched - inserted, inserted, started, _now(), FAILED if error else SUCCESS, error


def ingest(articles: DataFrame, key: str, out: str, provider: str, log: str | None = None, order: str = "seq") -> DataFrame:
    """Append the last article of each key to the Parquet files at out, and one row of LOG to those at log; gives that row.

    What comes in and what is written are observed while it is written: one job, one scan, no second pass for counts. A run
    that fails is logged with what had been counted as 0 and its error, and raises nothing; what it wrote is left out by
    Spark's committer.
    """
    spark, started = articles.sparkSession, _now()
    came, kept = Observation(), Observation()
    n = F.count(F.lit(1)).alias("n")
    try:
        unique = last_wins(articles.observe(came, n), key, order).drop("first_seq")
        unique.observe(kept, n).write.mode("append").parquet(out)
        row = _row(provider, came.get["n"], kept.get["n"], started, None)
    except Exception as e:  # noqa: BLE001  a failed run is a row of the log
        row = _row(provider, 0, 0, started, f"{type(e).__name__}: {str(e).splitlines()[0]}")
    logged = spark.createDataFrame([row], LOG)
    if log is not None:
        logged.write.mode("append").parquet(log)
    return logged


class RunListener(StreamingQueryListener):
    """Hands `add` a row of LOG for every batch of the streams of ingest_stream that had rows, and for each that failed."""

    def __init__(self, add: Callable[[tuple], None]):
        self.add, self.names = add, {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("run")
        if seen is not None and seen["fetched"]:
            started = dt.datetime.fromisoformat(event.progress.timestamp.replace("Z", "+00:00"))
            self.add(_row(event.progress.name, seen["fetched"], seen["fetched"], started, None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.add(_row(self.names.get(str(event.runId)), 0, 0, _now(), event.exception.splitlines()[0]))


def ingest_stream(stream: DataFrame, out: str, checkpoint: str, provider: str) -> StreamingQuery:
    """Append a stream to Parquet files, its batches counted as `run` while they are written; a RunListener logs them."""
    w = stream.observe("run", F.count(F.lit(1)).alias("fetched")).writeStream.format("parquet").queryName(provider)
    return w.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)
