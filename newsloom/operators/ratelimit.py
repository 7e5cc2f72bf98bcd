"""The fixed-window limiter whose windows begin with a key's own events.

Nothing in SQL's windows begins where the data says, so each key's events are folded in order. A key's events arrive
sorted and in batches; the state that crosses batches is (reset, count), so a hot key needs no more memory than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(times: np.ndarray, window: int, state: tuple[int, int] | None) -> tuple[np.ndarray, tuple[int, int]]:
    """Counts within their windows for ascending times, and the state after them: where the window ends, and its count."""
    if times.dtype.kind != "i":
        raise TypeError("times are whole microseconds")
    counts = np.empty(len(times), np.int64)
    reset, n = state if state else (-(1 << 62), 0)
    at = 0
    while at < len(times):  # a step a window, not an event
        if times[at] >= reset:
            reset, n = int(times[at]) + window, 0
        end = int(np.searchsorted(times, reset, "left"))
        counts[at:end] = n + 1 + np.arange(end - at)
        n, at = n + end - at, end
    return counts, (reset, n)


def rate_limit(events: DataFrame, key: str, ts: str, tie: str, limit: int = 30, window_seconds: int = 60) -> DataFrame:
    """events -> tie, key, n, allowed, remaining. Ties in time go by `tie`; rows without key or time are left out."""
    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(tie).alias("tie"), F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    window = window_seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            us, keys = pdf.us.to_numpy(), pdf.key.to_numpy()
            edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
            n = np.empty(len(keys), np.int64)
            for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)]):
                state = state if keys[a] == last else None
                n[a:z], state = fold(us[a:z], window, state)
                last = keys[a]
            yield pd.DataFrame({"tie": pdf.tie, "key": keys, "n": n})

    kinds = dict(e.dtypes)
    out = e.repartition("key").sortWithinPartitions("key", "us", "tie").mapInPandas(run, f"tie {kinds['tie']}, key {kinds['key']}, n long")
    return out.select(F.col("tie").alias(tie), F.col("key").alias(key), "n", (F.col("n") <= limit).alias("allowed"), F.greatest(F.lit(0), limit - F.col("n")).cast("long").alias("remaining"))
