"""A15 over stored tables: new articles join the clusters that are there, whatever order they come in.

Stored are articles, links and labels, each in a partition a day. A slice is compared with itself and with the days around it
alone; its links may give articles that are stored greater labels, which are handed on over stored links only from those
that changed. Labels only ever grow towards what one greedy run over all articles gives, so slices may come in any order and
more than once. Articles are stored last: a load that failed midway is simply repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from newsloom.operators.clustering import HOURS, placed, spread
from newsloom.operators.shared import apart, materialize
from newsloom.operators.similarity import story_links

HOPS = 2  # so many links are followed one by one, from what changed alone
_KEY = "struct<published: timestamp_ntz, back: bigint>"
_TABLES = {"articles": "seq long, published timestamp_ntz, tok array<string>", "links": f"key {_KEY}, before {_KEY}, of binary, to binary", "labels": f"key {_KEY}, label {_KEY}"}


def _read(spark: SparkSession, path: str, table: str, low: object = None, high: object = None) -> DataFrame:
    """A stored table with its day; days outside of low and high are not read."""
    try:
        found = spark.read.schema(f"{_TABLES[table]}, day date").parquet(f"{path}/{table}")
    except AnalysisException:
        found = spark.createDataFrame([], f"{_TABLES[table]}, day date")
    return found if low is None else found.where(F.col("day").between(F.lit(low).cast("date"), F.lit(high).cast("date")))


def _bounds(df: DataFrame, column: str) -> tuple | None:
    """First and last day of a column, `HOURS` further both ways; None of no rows."""
    span = F.expr(f"INTERVAL {HOURS} HOURS")
    r = df.agg((F.min(column) - span).cast("date").cast("string"), (F.max(column) + span).cast("date").cast("string")).first()
    return None if r[0] is None else tuple(r)


def _by_day(df: DataFrame, published: str) -> DataFrame:
    return df.withColumn("day", F.to_date(published)).repartition("day")


def load(spark: SparkSession, path: str, articles: DataFrame) -> dict[str, int]:
    """Add articles (seq, published, tok) to the clusters stored at path: how many were new, links made, labels that changed, days written.

    A seq that is stored for the same day, or comes twice, counts once. Articles without time or tokens are clusters of
    their own; those without time are left out.
    """
    given = articles.where(F.col("published").isNotNull()).select("seq", F.col("published").cast("timestamp_ntz").alias("published"), "tok").dropDuplicates(["seq"])
    around = _bounds(given, "published")
    if around is None:
        return dict.fromkeys(("articles", "links", "labels", "days"), 0)
    near = _read(spark, path, "articles", *around)
    new = materialize(given.withColumn("day", F.to_date("published")).join(near.select("seq", "day"), ["seq", "day"], "left_anti").drop("day"))
    both = near.drop("day").withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))
    links = materialize(story_links(both, HOURS).join(_read(spark, path, "links", *around).select("key", "before"), ["key", "before"], "left_anti").select("key", "before", "of", "to"))

    ends = links.select("key").union(links.select(F.col("before").alias("key"))).distinct()
    own = new.select(F.struct("published", (-F.col("seq")).alias("back")).alias("key"))
    nodes = ends.union(own).distinct().join(_read(spark, path, "labels", *around).select("key", F.col("label").alias("old")), "key", "left")
    start = materialize(nodes.select("key", F.coalesce("old", "key").alias("label"), "old"))
    first = spread(links, start.select("key", "label"))
    moved = materialize(first.join(start.select("key", "old"), "key").where(~F.col("old").eqNullSafe(F.col("label"))))
    changed, front = moved.select("key", "label"), moved.where("old IS NOT NULL")
    for _ in range(HOPS):
        if (reach := _bounds(front, "key.published")) is None:
            break
        changed, front = _handed_on(spark, path, changed, front, reach)
    if (reach := _bounds(front, "key.published")) is not None:
        changed = _handed_far(spark, path, changed, links, reach)

    days = 0
    if new.limit(1).count():
        if links.limit(1).count():
            _by_day(links, "key.published").write.mode("append").partitionBy("day").parquet(f"{path}/links")
        days = _store_labels(spark, path, changed)
        _by_day(new, "published").write.mode("append").partitionBy("day").parquet(f"{path}/articles")
    return {"articles": new.count(), "links": links.count(), "labels": changed.count(), "days": days}


def _handed_on(spark: SparkSession, path: str, changed: DataFrame, front: DataFrame, reach: tuple) -> tuple[DataFrame, DataFrame]:
    """One step from the labels that changed last (front: key, label, old) over stored links and, where the first article of a
    cluster got another label, to all that had its own. Gives all changed labels and the next front."""
    heard = _read(spark, path, "links", *reach).join(front.select(F.col("key").alias("before"), "label"), "before").select("key", "label")
    heads = front.where("old = key").select(F.col("key").alias("label"), F.col("label").alias("further"))
    if heads.limit(1).count():
        heard = heard.unionAll(_read(spark, path, "labels").where(F.col("day") <= F.lit(reach[1]).cast("date")).join(heads, "label").select("key", F.col("further").alias("label")))
    heard = materialize(heard.groupBy("key").agg(F.max("label").alias("heard")))
    span = _bounds(heard, "key.published") or reach
    now = _read(spark, path, "labels", *span).select("key", F.col("label").alias("stored"))
    known = heard.join(changed, "key", "left").join(now, "key", "left")
    old = F.coalesce("label", "stored", "key")
    better = materialize(known.where(old < F.col("heard")).select("key", F.col("heard").alias("label"), old.alias("old")))
    merged = materialize(changed.unionAll(better.select("key", "label")).groupBy("key").agg(F.max("label").alias("label")))
    return merged, better


def _handed_far(spark: SparkSession, path: str, changed: DataFrame, links: DataFrame, reach: tuple) -> DataFrame:
    """All that is left to hand on, in few rounds however long the chains are: stored articles up to the last one that changed
    find their labels anew, those after it keep theirs. Gives all changed labels."""
    last = F.lit(reach[1]).cast("date")
    stored = _read(spark, path, "labels").where(F.col("day") <= F.date_add(last, 2 * HOURS // 24)).select("key", F.col("label").alias("old"))
    known = materialize(apart(stored).join(changed, "key", "full_outer").select("key", F.coalesce("label", "old").alias("old")))
    within = F.to_date("key.published") <= last
    over = _read(spark, path, "links").where(F.col("day") <= last).drop("day").unionAll(links.where(within))
    found = spread(materialize(over), known.select("key", F.when(within, F.col("key")).otherwise(F.col("old")).alias("label")))
    better = apart(found).join(known, "key").where("label > old").select("key", "label")
    return materialize(changed.unionAll(better).groupBy("key").agg(F.max("label").alias("label")))


def _store_labels(spark: SparkSession, path: str, changed: DataFrame) -> int:
    """Write the partitions of the days that have a changed label; how many."""
    fresh = changed.withColumn("day", F.to_date("key.published"))
    days = [r[0] for r in fresh.select("day").distinct().collect()]  # a value a day
    kept = _read(spark, path, "labels").where(F.col("day").isin(days)).join(changed.select("key"), "key", "left_anti")
    rows = materialize(kept.select("key", "label", "day").unionAll(fresh.select("key", "label", "day")))  # read and overwritten
    rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/labels")
    return len(days)


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """seq, cluster, pos of all stored articles, as story_clusters gives them for all at once."""
    labels = _read(spark, path, "labels")
    return placed(labels.select((-F.col("key.back")).alias("seq"), (-F.col("label.back")).alias("cluster"), F.col("key.published").alias("published")))
