"""Connected components of an edge table, by label contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.shared import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected edges -> (node, component): the smallest node reachable, for every node of an edge.

    Each round hooks every node to the smallest one around it and then contracts: edges join the labels of their ends,
    equal ends fall away and so does all that is finished. Of the nodes that still have edges at least half go in every
    round, on chains too, so the tables of all rounds together are about twice the first. Labels are followed back
    through the rounds at the end. Only counts reach the driver. Null ends and self loops are ignored; repeated edges
    count once; an empty table gives an empty result.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        hooked = materialize(near.select("node", F.least("node", "near").alias("label")))
        # A label may itself be hooked further: two more steps, so chains of hooks shrink faster than edges do.
        step = lambda n: hooked.select(F.col("node").alias(f"at{n}"), F.col("label").alias(f"to{n}"))
        far = hooked.join(step(1), F.col("label") == F.col("at1")).join(step(2), F.col("to1") == F.col("at2"))
        hooked = materialize(far.select("node", F.col("to2").alias("label")))
        rounds.append(hooked)
        a, b = (hooked.select(F.col("node").alias(x), F.col("label").alias(f"to_{x}")) for x in ("a", "b"))
        moved = left.join(a, "a").join(b, "b").where("to_a <> to_b")
        left = materialize(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds.pop()
    while rounds:  # a node that has no edges after a round keeps that round's label
        later = found.select(F.col("node").alias("label"), F.col("label").alias("component"))
        found = materialize(rounds.pop().join(later, "label", "left").select("node", F.coalesce("component", "label").alias("label")))
    return found.withColumnRenamed("label", "component")
