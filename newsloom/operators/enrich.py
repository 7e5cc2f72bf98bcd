"""Enrichment and summaries by rule: P12, P14-P16, T07, F13, J03."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules' names, and what is said where an article says nothing.
CLASSIFIED_TEAMS = ("Arsenal", "Liverpool")
NO_TITLE, NO_EXCERPT = "Bản tin tổng hợp", "Thông tin đang được cập nhật."
SUMMARY_NOTE = " Đây là bản tóm tắt minh họa, không bổ sung dữ kiện ngoài nguồn."


def source_details(details: Column, sources: Column, url: Column, reliability: Column, language: Column) -> Column:
    """The given details, else one for each source name by the item's own values."""
    derived = F.transform(sources, lambda s: F.struct(s.alias("name"), F.coalesce(url, F.lit("#")).alias("url"), reliability.alias("reliability"), F.coalesce(language, F.lit("vi")).alias("language")))
    return F.when(F.coalesce(F.size(details), F.lit(0)) > 0, details).otherwise(derived)


def entities(title: Column, excerpt: Column) -> Column:
    """Teams, players (none) and competitions of P14's rules. Null texts count as empty."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(excerpt, F.lit(""))))
    teams = F.filter(F.array(*[F.lit(t) for t in CLASSIFIED_TEAMS]), lambda t: F.contains(text, F.lower(t)))
    league = F.when(F.contains(text, F.lit("champions")), "champions-league").otherwise("premier-league")
    return F.struct(teams.alias("teams"), F.array().cast("array<string>").alias("players"), F.array(league).alias("competitions"))


def summaries(articles: DataFrame, key: str = "cluster", order: str = "pos") -> DataFrame:
    """Articles (cluster, pos, id, title, excerpt) -> a row for each cluster: title, summary, key_points, source_ids.

    The first article speaks for the cluster; at most three titles are key points; source_ids lists all ids in order.
    """
    first = F.min_by(F.struct("title", "excerpt"), order)
    # Only the first three titles are wanted: they are picked before rows of a cluster meet.
    ids = F.transform(F.array_sort(F.collect_list(F.struct(order, "id"))), lambda x: x["id"])
    titles = F.slice(F.array_sort(F.collect_list(F.when(F.col(order) <= 3, F.struct(order, "title")))), 1, 3)
    g = articles.groupBy(key).agg(first.alias("lead"), titles.alias("titles"), ids.alias("source_ids"))
    return g.select(
        key, F.coalesce("lead.title", F.lit(NO_TITLE)).alias("title"), F.concat(F.coalesce("lead.excerpt", F.lit(NO_EXCERPT)), F.lit(SUMMARY_NOTE)).alias("summary"),
        F.transform("titles", lambda x: x["title"]).alias("key_points"), "source_ids",
    )


def translate_candidates(articles: DataFrame, limit: int = 20) -> DataFrame:
    """The newest English articles; ties by place."""
    return articles.where(F.col("language") == "en").orderBy(F.desc("published"), "seq").limit(limit)


def accepted(enriched: DataFrame, asked: DataFrame) -> DataFrame:
    """answers (id, title, summary, ...) to what was asked for whose title and summary say something; of several for an id the last by title."""
    fine = enriched.where((F.length("title") > 0) & (F.length("summary") > 0)).join(asked.select("id"), "id", "left_semi")
    return fine.groupBy("id").agg(*[F.max_by(c, F.struct("title", "summary")).alias(c) for c in enriched.columns if c != "id"])


def overlay(articles: DataFrame, answers: DataFrame) -> DataFrame:
    """Articles whose id has an answer take its title and summary (as excerpt) and count as translated; ids in answers are unique."""
    a = answers.select(F.col("id").alias("_id"), F.col("title").alias("_title"), F.col("summary").alias("_summary"))
    return articles.join(a, F.col("id") == F.col("_id"), "left").withColumns({
        "title": F.coalesce("_title", "title"), "excerpt": F.coalesce("_summary", "excerpt"), "translated": F.col("_id").isNotNull(),
    }).drop("_id", "_title", "_summary")
