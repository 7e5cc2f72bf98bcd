"""Views over matches and entities: filters, fixtures, look-ups, follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import fold, normalize_search
from newsloom.operators.ranking import with_rank


def match_text(*columns: str) -> Column:
    """Folded text of a match; null parts are left out."""
    return normalize_search(F.concat_ws(" ", *columns))


def filter_matches(matches: DataFrame, query: str = "", competition: str = "", team: str = "") -> DataFrame:
    """the conditions that are given; empty ones do not count. A row whose column is null fails a condition on it."""
    if competition:
        matches = matches.where(F.col("competition") == competition)
    if team:
        matches = matches.where((F.col("home") == team) | (F.col("away") == team))
    return matches.where(F.contains(match_text("home", "away", "competition", "venue"), F.lit(fold(query)))) if query else matches


def entity_fixtures(matches: DataFrame, terms: list[str], limit: int = 3, order: str = "seq") -> DataFrame:
    """the first matches, not finished, whose teams or competition hold one of the terms; without terms none."""
    text = match_text("home", "away", "competition")
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(fold(t)))
    return matches.where((F.col("status") != "finished") & found).orderBy(order).limit(limit)


def point_lookup(df: DataFrame, column: str, value: object, order: str = "seq") -> DataFrame:
    """The first row whose column has the value; no row where none has."""
    return df.where(F.col(column) == F.lit(value)).orderBy(order).limit(1)


def followed_names(entities: DataFrame, follows: DataFrame) -> DataFrame:
    """Names of entities (id, name) that stand in follows (entity_id); repeated follows count once."""
    return entities.join(follows.select(F.col("entity_id").alias("id")), "id", "left_semi").select("id", "name")


def with_display(df: DataFrame, name: str, teams: DataFrame, default: str = "#7cfa4c") -> DataFrame:
    """Df and the accent of the team named in `name`; of teams of one name the first (by id); unknown ones get the default."""
    first = teams.groupBy(F.col("name").alias("_team")).agg(F.min_by("accent", "id").alias("_accent"))
    return df.join(first, F.col(name) == F.col("_team"), "left").withColumn("accent", F.coalesce("_accent", F.lit(default))).drop("_team", "_accent")


def all_real(answers: DataFrame, expected: int = 4, by: list[str] | None = None) -> DataFrame:
    """A10: (provider, demo) -> real: whether all the expected answers came, none from the demo provider. No answers: false.

    One row, or one for each value of the columns `by`.
    """
    ok = (F.col("provider") != "mock") & ~F.col("demo")
    return answers.groupBy(*by or []).agg(F.coalesce((F.count("*") == expected) & F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("real"))


def total_hits(*results: DataFrame) -> DataFrame:
    """One row, total: rows of all results together."""
    counts = None
    for r in results:
        one = r.agg(F.count("*").alias("n"))
        counts = one if counts is None else counts.unionAll(one)
    return counts.agg(F.sum("n").alias("total"))


def numbered(df: DataFrame, order: list) -> DataFrame:
    """Df with label: the place in `order`, from 1, with two digits at least (100 stays 100)."""
    n = F.col("_place") + 1
    label = F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    return with_rank(df, order, "_place").withColumn("label", label).drop("_place")


def hottest(items: DataFrame, limit: int = 1, exclude: str | None = None) -> DataFrame:
    """The hottest items, ties by reliability and then by place. The first is the hero; the next six leave it out."""
    if exclude is not None:
        items = items.where(F.col("id") != exclude)
    return items.orderBy(F.desc("hotness"), F.desc("reliability"), "seq").limit(limit)
