"""Matches, standings and teams from two provider schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import dates, scoring, text


# What stands for a venue, the leagues and competitions asked for, days before and after today.
NO_VENUE = "Chưa công bố"
LEAGUES = (39, 2, 140, 135)
COMPETITIONS = ("PL", "CL", "PD", "SA", "BL1", "FL1", "DED", "PPL", "BSA", "ELC", "WC")
WINDOW_DAYS = (-1, 7)


def _answers(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """Answers landed as files of one answer (or one array of answers) each, or of one answer a line, so that large files are split."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def last_five(form: Column) -> Column:
    """The last five entries, and of these only W, D and L."""
    tail = F.slice(form, F.greatest(F.lit(1), F.size(form) - 4), F.lit(5))
    return F.filter(tail, lambda x: x.isin("W", "D", "L"))


def form_of_letters(form: Column) -> Column:
    return last_five(F.filter(F.split(F.coalesce(form, F.lit("")), ""), lambda c: c != ""))


def form_of_list(form: Column) -> Column:
    return last_five(F.split(F.coalesce(form, F.lit("")), ","))


def team_name(team: Column, default: str = "Chưa xác định") -> Column:
    """P09."""
    return F.coalesce(*[F.nullif(F.trim(team[c]), F.lit("")) for c in ("name", "shortName", "tla")], F.lit(default))


def short_name(team: Column) -> Column:
    """P08."""
    return F.coalesce(team["tla"], team["shortName"], F.upper(F.left(team_name(team), F.lit(3))))


def api_matches(spark: SparkSession, path: str, leagues: list[int] | None = None, lines: bool = False) -> DataFrame:
    """Fixtures of the first provider; an empty list of leagues allows all."""
    r = _answers(spark, path, schemas.API_FIXTURES, lines).select(F.inline("response"))
    if leagues:
        r = r.where(F.col("league.id").isin(leagues))
    return r.select(
        F.col("fixture.id").cast("string").alias("id"), F.col("league.name").alias("competition"), F.col("teams.home.name").alias("home"), F.col("teams.away.name").alias("away"),
        F.col("goals.home").alias("home_score"), F.col("goals.away").alias("away_score"), F.col("fixture.date").alias("start_time"),
        scoring.match_status(F.col("fixture.status.short")).alias("status"), F.col("fixture.status.elapsed").alias("minute"), F.coalesce("fixture.venue.name", F.lit(NO_VENUE)).alias("venue"),
        dates.clock(F.col("fixture.date").try_cast("timestamp")).alias("start"),
    )


def data_matches(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Matches of the second provider; scores by either of its two names."""
    m = _answers(spark, path, schemas.DATA_MATCHES, lines).select(F.inline("matches"))
    score = F.col("score.fullTime")
    return m.select(
        F.col("id").cast("string").alias("id"), F.col("competition.name").alias("competition"), team_name(F.col("homeTeam")).alias("home"), team_name(F.col("awayTeam")).alias("away"),
        F.coalesce(score["home"], score["homeTeam"]).alias("home_score"), F.coalesce(score["away"], score["awayTeam"]).alias("away_score"), F.col("utcDate").alias("start_time"),
        scoring.match_status_text(F.col("status")).alias("status"), "minute", F.coalesce("venue", F.lit(NO_VENUE)).alias("venue"),
        dates.day_and_clock(F.col("utcDate").try_cast("timestamp")).alias("start"),
    )


def data_standings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The table of type TOTAL, else the first."""
    s = _answers(spark, path, schemas.DATA_STANDINGS, lines)
    table = F.coalesce(F.get(F.filter("standings", lambda x: x["type"] == "TOTAL"), F.lit(0)), F.get("standings", F.lit(0)))["table"]
    t = s.select(F.inline(table))
    return t.select(
        "position", team_name(F.col("team")).alias("team"), F.col("playedGames").alias("played"), "won", F.col("draw").alias("drawn"), "lost",
        F.col("goalDifference").alias("goal_difference"), "points", form_of_list(F.col("form")).alias("form"),
    )


def in_window(matches: DataFrame, today: Column, days: tuple[int, int] = WINDOW_DAYS) -> DataFrame:
    """Matches from a day before today to a week after, by the day of start_time in UTC."""
    day = F.to_date(F.col("start_time").try_cast("timestamp"))
    return matches.where(day.between(F.date_add(today, days[0]), F.date_add(today, days[1])))


def of_status(matches: DataFrame, status: str) -> DataFrame:
    """live, scheduled (fixtures) or finished (results) ones; a window is read once and filtered thrice."""
    return matches.where(F.col("status") == status)


def api_standings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """P06 of the first provider: the first table of the first answer; form letter by letter."""
    r = _answers(spark, path, schemas.API_STANDINGS, lines)
    t = r.select(F.inline(F.get(F.get("response", F.lit(0))["league"]["standings"], F.lit(0))))
    return t.select(
        F.col("rank").alias("position"), F.col("team.name").alias("team"), F.col("all.played").alias("played"), F.col("all.win").alias("won"), F.col("all.draw").alias("drawn"),
        F.col("all.lose").alias("lost"), F.col("goalsDiff").alias("goal_difference"), "points", form_of_letters(F.col("form")).alias("form"),
    )


def api_teams(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """P08 of the first provider."""
    r = _answers(spark, path, schemas.API_TEAMS, lines).select(F.inline("response"))
    name = F.col("team.name")
    return r.select(
        F.col("team.id").cast("string").alias("id"), name.alias("name"), F.coalesce("team.code", F.upper(F.left(name, F.lit(3)))).alias("short_name"), text.slugify_ascii(name).alias("slug"),
        F.coalesce("team.country", F.lit("")).alias("country"), F.coalesce("venue.name", F.lit("")).alias("venue"),
    )


def data_teams(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """P08 of the second provider."""
    t = _answers(spark, path, schemas.DATA_TEAMS, lines).select(F.explode("teams").alias("team"))
    name = team_name(F.col("team"))
    return t.select(
        F.col("team.id").cast("string").alias("id"), name.alias("name"), F.coalesce("team.tla", "team.shortName", F.upper(F.left(name, F.lit(3)))).alias("short_name"),
        text.slugify_ascii(name).alias("slug"), F.coalesce("team.area.name", F.lit("")).alias("country"), F.coalesce("team.venue", F.lit("")).alias("venue"),
    )


def provider_name(key: str | None, provider: str | None) -> str:
    """A provider that is known and has a key, else the demo tables."""
    return provider if (key or "").strip() and provider in ("football-data", "api-football") else "mock"


def provider_matches(spark: SparkSession, provider: str, path: str | None = None, leagues: list[int] | None = None) -> DataFrame:
    """S06-S08 by name: landed files of a provider, or the demo matches."""
    from newsloom.sources import demo

    if provider == "api-football":
        return api_matches(spark, path, list(LEAGUES) if leagues is None else leagues)
    return data_matches(spark, path) if provider == "football-data" else demo.matches(spark)


def merge_matches(*lists: DataFrame) -> DataFrame:
    """Lists one after the other, the last match of an id at the place of its first. Of one list's matches of an id its order decides."""
    from newsloom.operators.dedupe import last_wins

    out = None
    for n, df in enumerate(lists):
        df = df.withColumn("seq", F.struct(F.lit(n).alias("list"), F.monotonically_increasing_id().alias("at")))
        out = df if out is None else out.unionByName(df)
    return last_wins(out, "id", "seq").drop("seq")
