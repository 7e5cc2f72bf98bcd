"""Clusters to news items, and the order of the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates, scoring
from newsloom.functions.text import tokens
from newsloom.operators.clustering import story_clusters
from newsloom.operators.dedupe import last_wins
from newsloom.operators.ranking import with_rank
from newsloom.operators.shared import apart, materialize
from newsloom.sources.articles import NOW, age_hours


# Fixed value: the category of articles that come without one.
CATEGORY = "Bóng đá"


def news_items(articles: DataFrame, now: str = NOW) -> DataFrame:
    """articles (seq, title, excerpt, url, published, language, source, reliability, official) -> news items with cluster_pos.

    articles may have category, translated, id, and what enrichment gives: topic, key_points, importance. Without them all
    are of CATEGORY, none is translated, seq is the id, and the rest is derived. All is combined before it is shuffled; only
    the sources and details of a cluster, which are its output, are gathered.
    """
    defaults = {
        "category": F.lit(CATEGORY), "translated": F.lit(False), "id": F.col("seq").cast("string"), "topic": F.lit(None).cast("string"),
        "key_points": F.lit(None).cast("array<string>"), "importance": F.lit(None).cast("int"),
    }
    a = articles.withColumns({c: x for c, x in defaults.items() if c not in articles.columns}).withColumn("tok", tokens(F.col("title")))
    a = materialize(a)  # read for links, for places and for the items
    given = F.when(F.col("importance") != 0, F.col("importance").cast("double"))
    m = apart(a).join(story_clusters(a), "seq").withColumn("imp", F.coalesce(given, scoring.importance(F.col("title"), F.col("category"))))
    # The last article of a source stands for it, at the place of its first.
    stands = F.max(F.struct("pos", "reliability", F.col("official").alias("official"))).alias("last")
    s = m.groupBy("cluster", "source").agg(stands, F.min("pos").alias("src_first")).groupBy("cluster").agg(
        F.count("*").cast("double").alias("n"), F.avg(F.col("last.reliability").cast("double")).alias("rel"), F.bool_or("last.official").alias("official"),
        F.array_sort(F.collect_list(F.struct("src_first", "source"))).alias("srcs"),
    )
    lead = F.struct("translated", "published", "reliability", (-F.col("pos")).alias("back"), "seq", "id", "title", "excerpt", "url", "language", "category", "topic", "key_points")
    g = m.groupBy("cluster").agg(
        F.max("imp").alias("imp"), F.max(lead).alias("lead"), F.max("published").alias("newest"),
        F.array_sort(F.collect_list(F.struct("pos", F.col("source").alias("name"), "url", "reliability", "language"))).alias("details"),
        F.array_sort(F.collect_list(F.when(F.col("pos") <= 3, F.struct("pos", "id", "title")))).alias("first"),
    ).join(apart(s), "cluster")
    age = age_hours(F.col("lead.published"), now)
    english = F.col("lead.language") == "en"
    g = with_rank(g.withColumn("age", age), [F.desc("newest"), F.col("cluster")], "cluster_pos")
    verified = F.col("official") | (F.col("n") >= 2)
    hot = scoring.hotness(F.col("age"), F.col("n"), F.col("rel"), F.col("imp"), scoring.velocity(F.col("n"), F.col("age")), F.col("imp"), verified)
    rel = scoring.reliability(F.col("rel"), F.col("n"), F.col("official"), scoring.speculative(F.col("lead.title"), F.col("lead.excerpt")))
    others = F.slice(F.filter("first", lambda o: o["id"] != F.col("lead.id")), 1, 2)
    derived = F.transform(F.concat(F.array("lead.excerpt"), F.transform(others, lambda o: o["title"])), lambda p: F.left(p, F.lit(190)))
    points = F.when(F.size("lead.key_points") > 0, F.col("lead.key_points")).otherwise(derived)
    topic = F.col("lead.topic")
    kind = F.when(english, F.concat(F.coalesce(topic, "lead.category"), F.lit(" · Quốc tế"))).otherwise(F.concat("lead.category", F.lit(" · Việt Nam")))
    place = F.when(english, "Bóng đá quốc tế").otherwise("Thể thao Việt Nam")
    tone = F.element_at(F.array(*[F.lit(t) for t in scoring.TONES]), (F.col("cluster_pos") % 5 + 1).cast("int"))
    return g.select(
        F.col("lead.seq").alias("seq"), F.concat(F.lit("rss-"), "lead.id").alias("id"), F.col("lead.title").alias("title"),
        F.left("lead.excerpt", F.lit(420)).alias("summary"), F.slice(points, 1, 3).alias("key_points"),
        F.concat(F.lit("rss-"), "lead.id").alias("slug"), kind.alias("category"),
        F.coalesce(topic, place).alias("competition"), place.alias("team"), dates.distance(F.col("lead.published"), F.lit(now).cast("timestamp")).alias("published_ago"),
        dates.iso(F.col("lead.published")).alias("published_timestamp"), F.col("lead.published").alias("published"), hot.alias("hotness"), rel.alias("reliability"),
        F.transform("srcs", lambda x: x["source"]).alias("sources"), F.transform("details", lambda x: x.dropFields("pos")).alias("source_details"),
        F.col("lead.url").alias("original_url"), F.col("lead.language").alias("original_language"), F.col("lead.translated").alias("translated"),
        scoring.trending_reasons(F.col("n"), F.col("age"), F.col("imp")).alias("trending_reasons"), tone.alias("image_tone"),
        (F.col("cluster_pos") < 2).alias("featured"), F.col("cluster_pos").cast("int").alias("cluster_pos"),
    )


def feed(articles: DataFrame, size: int = 60, now: str = NOW) -> DataFrame:
    """Dedupe by url, cluster, score; the newest `size`."""
    kept = last_wins(articles, "url").drop("seq").withColumnRenamed("first_seq", "seq")
    return news_items(kept, now).orderBy(F.desc("published"), F.desc("hotness"), F.desc("reliability"), "cluster_pos").limit(size)
