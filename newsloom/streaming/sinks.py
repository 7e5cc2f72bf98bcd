"""Answers as JSON, notices of new rows, and a stream that is polled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The mark before each kind of notice, seconds between polls, and how long an answer of each kind may be kept.
NOTICES = {"breaking_news": "🔥", "match_alert": "⚽", "daily_digest": "📰"}
POLL_SECONDS = 120
MAX_AGE = {"news": (90, 180), "live": (15, 30), "sports": (300, 900)}


def envelope(page: DataFrame, order: list, kind: str, **meta: object) -> DataFrame:
    """One row, body and cache_control: the rows of a page (bounded: a report, not a table) as `data` beside meta's fields."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)]).alias("k"), F.struct(*page.columns).alias("v")))), lambda x: x["v"])
    body = F.to_json(F.struct(items.alias("data"), *[F.lit(v).alias(k) for k, v in meta.items()]))
    age, stale = MAX_AGE[kind]
    return page.agg(body.alias("body")).withColumn("cache_control", F.lit(f"public, s-maxage={age}, stale-while-revalidate={stale}"))


def notices(rows: DataFrame, kind: str, chat: str, text: str) -> DataFrame:
    """Rows as messages: chat_id, message."""
    return rows.select(F.col(chat).cast("string").alias("chat_id"), F.concat(F.lit(f"{NOTICES[kind]} "), F.col(text)).alias("message"))


def notify(stream: DataFrame, checkpoint: str, send: Callable[[str, str], None] | None = None, poll_seconds: int | None = POLL_SECONDS) -> StreamingQuery:
    """A streaming (chat_id, message) handed to `send` from the executors, batch by batch; without `send` nothing is sent.

    A batch begins every poll_seconds and never while another runs; None takes what is there and ends. After a failure a
    batch is sent again, so a message may come twice but none is lost.
    """

    def deliver(batch: DataFrame, _: int) -> None:
        if send is not None:
            batch.foreachPartition(lambda rows: [send(r.chat_id, r.message) for r in rows] and None)

    w = stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if poll_seconds is None else w.trigger(processingTime=f"{poll_seconds} seconds")).start()
