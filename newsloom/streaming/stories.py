"""X04, X05 on streams: pairs of the same story by a stream-stream join within an interval of event time.

Both sides have a watermark, and the interval bounds how long a row can still meet another, so Spark drops state that lies
further back than the interval and the allowed delay. Rows that come later than the delay allows are dropped by rule. No
state but the join's is needed: a pair meets on every token that both have, and only its first common token, in an order
that all rows share, lets it through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from newsloom.operators.shared import materialize, shuffles_freed
from newsloom.operators.similarity import needed

DELAY = "1 hour"


def _met(articles: DataFrame, hours: int, left: Callable[[Column], Column], right: Callable[[Column], Column], one_way: Column, delay: str) -> DataFrame:
    """articles (seq, published, tok) -> a, b, na, nb, shared: each pair within so many hours whose first common token is among
    the first left(n) of a and the first right(n) of b."""
    longest = F.array_sort(F.transform(F.array_distinct("tok"), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))  # long words are rare ones
    seconds = F.unix_seconds(F.col("published"))
    t = articles.withColumn("published", F.col("published").cast("timestamp")).withWatermark("published", delay)
    t = t.where(F.size("tok") > 0).select("seq", "published", F.transform(longest, lambda x: x["w"]).alias("tok"), F.floor(seconds / (hours * 3600)).alias("step"))
    n = F.size("tok")

    def side(x: str, steps: Column, some: Callable[[Column], Column]) -> DataFrame:
        first = F.slice("tok", 1, F.greatest(F.lit(0), some(n)))
        rows = t.select(F.col("seq").alias(x), F.col("published").alias(f"p{x}"), n.alias(f"n{x}"), F.col("tok").alias(f"t{x}"), F.explode(steps).alias(f"s{x}"), first.alias("some"))
        return rows.withColumn(f"w{x}", F.explode("some")).drop("some")

    a, b = side("a", F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1), left), side("b", F.array("step"), right)
    common, span = F.array_intersect("ta", "tb"), F.expr(f"INTERVAL {hours} HOURS")
    near = (F.col("pb") >= F.col("pa") - span) & (F.col("pb") <= F.col("pa") + span)
    met = a.join(b, (F.col("wa") == F.col("wb")) & (F.col("sa") == F.col("sb")) & near & one_way & (F.col("wa") == F.get(common, F.lit(0))))
    return met.select("a", "b", "na", "nb", F.size(common).cast("long").alias("shared"))


def same_story_stream(articles: DataFrame, hours: int = 72, least: int = 3, overlap: float = 0.52, delay: str = DELAY) -> DataFrame:
    """J01 of a stream (seq, published, tok) -> a, b, shared, with a < b, in append mode.

    A pair is given once both are there, if neither is more than `delay` behind the newest when it comes. Rows without time
    or tokens have no pairs; a seq that comes twice is two articles.
    """
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    p = _met(articles, hours, lambda n: n - needed(n, overlap, least) + 1, lambda n: n, smaller, delay)
    p = p.where((F.col("shared") >= least) & (F.col("shared") / F.greatest(F.lit(1), F.least("na", "nb")) >= overlap))
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared")


def likely_duplicates_stream(articles: DataFrame, hours: int = 48, least: float = 0.55, delay: str = DELAY) -> DataFrame:
    """J02 of a stream: a, b, shared, with a < b, as same_story_stream."""
    rarest = lambda n: n - needed(n, least) + 1
    p = _met(articles, hours, rarest, rarest, F.col("a") < F.col("b"), delay)
    return p.where(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")) >= least).select("a", "b", "shared")


def append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream gives from the data that is there to Parquet files, each row once; call it again when more has come."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


_STORED = "seq long, published timestamp, tok array<string>, batch long, day date"


def store_pairs(stream: DataFrame, path: str, checkpoint: str, rule: Callable[[DataFrame, int], DataFrame], hours: int, delay_seconds: int = 3600) -> StreamingQuery:
    """Pairs of a stream (seq, published, tok) by a rule of similarity.py, added to those stored at path. Ends when all that is there is read.

    Instead of a join's state, which holds each article's tokens with each of them, every batch is compared, as classes of
    equal titles, with itself and with the stored articles of the days around it. Rows that come more than the delay behind
    the newest stored one are dropped by rule; seq is unique. What a batch writes has its number and is written over if it
    comes again, so each pair is there once.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _kept(spark, path).where(F.col("batch") < number)
        newest = known.agg(F.max("published").alias("p"))  # a row
        rows = batch.select("seq", F.col("published").cast("timestamp").alias("published"), F.array_distinct("tok").alias("tok")).where(F.col("published").isNotNull())
        in_time = F.col("p").isNull() | (F.unix_micros("published") >= F.unix_micros("p") - delay_seconds * 1_000_000)
        new = materialize(rows.crossJoin(F.broadcast(newest)).where(in_time).drop("p").withColumn("day", F.to_date("published")))
        span = F.expr(f"INTERVAL {hours} HOURS")
        low, high = new.agg((F.min("published") - span).cast("date"), (F.max("published") + span).cast("date")).first()
        if low is not None:
            near = known.where(F.col("day").between(F.lit(low), F.lit(high))).select("seq", "published", "tok", F.lit(False).alias("fresh"))
            both = near.unionAll(new.select("seq", "published", "tok", F.lit(True).alias("fresh")))
            with shuffles_freed(spark):
                rule(both, hours).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/pairs/batch={number}")
            new.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/articles/batch={number}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _kept(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_STORED).parquet(f"{path}/articles")
    except AnalysisException:
        return spark.createDataFrame([], _STORED)


def stored_pairs(spark: SparkSession, path: str) -> DataFrame:
    """a, b, shared: all pairs that store_pairs has found, with a < b."""
    try:
        return spark.read.schema("a long, b long, shared long, batch long").parquet(f"{path}/pairs").drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], "a long, b long, shared long")
