"""The articles view over documents, and news items of single articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import scoring

NOW = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of a text is its title: seq, title, excerpt, url, published, language, source, reliability, official."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    hours = F.pmod(F.col("doc_id") * 7919, F.lit(720)).cast("int")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.substring_index("text", "\n", 1).alias("title"), F.left("text", F.lit(520)).alias("excerpt"),
        F.concat(F.lit("https://news.example/"), (F.col("doc_id") - (F.col("doc_id") % 10 == 9).cast("int")).cast("string")).alias("url"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours)).alias("published"),
        F.col("lang").alias("language"), "source", (80 + n * 7 % 19).alias("reliability"), (n < 2).alias("official"),
    )


def age_hours(published, now: str = NOW):
    seconds = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(published.cast("timestamp"))
    return F.greatest(F.lit(0.0), seconds / 3600.0)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One news item for each article, scored as a cluster of its own."""
    a = articles(spark, sf_dir)
    english = F.col("language") == "en"
    place = F.when(english, "Bóng đá quốc tế").otherwise("Thể thao Việt Nam")
    a = a.withColumns({
        "category": F.when(english, "Bóng đá · Quốc tế").otherwise("Bóng đá · Việt Nam"), "age": age_hours(F.col("published")),
        "imp": scoring.importance(F.col("title"), F.lit("Bóng đá")), "rel": F.col("reliability").cast("double"),
    })
    one = F.lit(1.0)
    return a.select(
        "seq", F.concat(F.lit("rss-"), F.col("seq").cast("string")).alias("id"), "title", F.left("excerpt", F.lit(420)).alias("summary"),
        "category", place.alias("competition"), F.col("source").alias("team"), F.array("source").alias("sources"), F.array("title").alias("key_points"),
        "language", "published", "age", "official",
        scoring.hotness(F.col("age"), one, F.col("rel"), F.col("imp"), scoring.velocity(one, F.col("age")), F.col("imp"), F.col("official")).alias("hotness"),
        scoring.reliability(F.col("rel"), one, F.col("official"), scoring.speculative(F.col("title"), F.col("excerpt"))).alias("reliability"),
    )
