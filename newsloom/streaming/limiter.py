"""X01 on a stream: the same fold, its state kept by Spark for each key.

Order is that of processing: within a micro-batch events of a key are sorted by time; an event that comes in a later
batch than its time would ask for counts where it arrives, as in a limiter that serves requests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators.ratelimit import fold


def rate_limit_stream(events: DataFrame, key: str, ts: str, tie: str, limit: int = 30, window_seconds: int = 60) -> DataFrame:
    """Streaming events -> tie, key, n, allowed, remaining, in append mode. Rows without key or time are left out, as in a batch.

    Idle keys leave the state after two windows of processing time, so a replay that stalls for longer than that begins
    a key's window anew.
    """
    window = window_seconds * 1_000_000
    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(tie).alias("tie"), F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["us", "tie"])
        n, now = fold(pdf.us.to_numpy(), window, tuple(state.get) if state.exists else None)
        state.update(now)
        state.setTimeoutDuration(2 * window_seconds * 1000)
        yield pd.DataFrame({"tie": pdf.tie.to_numpy(), "key": keys[0], "n": n})

    kinds = dict(e.dtypes)
    out = e.groupBy("key").applyInPandasWithState(run, f"tie {kinds['tie']}, key {kinds['key']}, n long", "reset long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select(F.col("tie").alias(tie), F.col("key").alias(key), "n", (F.col("n") <= limit).alias("allowed"), F.greatest(F.lit(0), limit - F.col("n")).cast("long").alias("remaining"))
