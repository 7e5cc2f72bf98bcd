"""Last-wins dedupe at the place of the first (A04), and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The last row of each key, with `first_seq`, the place that the key's first row had; rows without key are one key.

    Combined before the shuffle, so a key that holds most rows is no hot task. `order` is unique, or ties may go either way.
    """
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("last")
    return df.groupBy(F.col(key).alias("_key")).agg(last, F.min(order).alias("first_seq")).select("last.*", "first_seq")


def run_log(df: DataFrame, key: str) -> DataFrame:
    """fetched, inserted, skipped, classified, status."""
    out = df.agg(F.count("*").alias("fetched"), F.countDistinct(key).alias("inserted"))
    return out.select("fetched", "inserted", (F.col("fetched") - F.col("inserted")).alias("skipped"), F.col("inserted").alias("classified"), F.lit("success").alias("status"))
