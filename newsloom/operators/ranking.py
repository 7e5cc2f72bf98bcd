"""Places in a total order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.shared import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with each row's place, from 0, in `order`: its place in its range of the sort and the rows of the ranges before."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed)
    part = F.shiftright("_at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a task
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return ranked.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_part", "_before", "_at")
