"""Connected components by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from newsloom.operators.shared import materialize


def _large(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionAll(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "near")
    least = both.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("least"))
    return both.where("near > node").join(least, "node").select(F.col("near").alias("high"), F.col("least").alias("low"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionAll(least.withColumnRenamed("least", "low")).distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written once, with their number and checksum, which are observed as they are written."""
    seen = Observation()
    kept = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("high", "low")).alias("sum")))
    return kept, (seen.get["n"], seen.get["sum"])


def star_components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected edges -> (node, component): the smallest node reachable, for every node of an edge.

    Both steps keep what is connected connected; they alternate until every component is a star around its smallest node,
    which is seen by the number and a checksum of the edges. A node with very many neighbours is aggregated before the
    shuffle and met by its minimum alone, in a join whose hot keys Spark can split. Null ends and self loops are ignored;
    repeated edges count once; an empty table gives an empty result.
    """
    now, seen = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    while seen[0]:
        last = seen
        now, seen = _kept(_small(materialize(_large(now))))
        if last == seen:
            break
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
