"""The demo dimensions and the rows generated from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import slugify_plain

# The demo tables.
COMPETITIONS = (
    ("epl", "Premier League", "premier-league", "Anh", "2025/26"), ("ucl", "Champions League", "champions-league", "Châu Âu", "2025/26"),
    ("laliga", "La Liga", "la-liga", "Tây Ban Nha", "2025/26"), ("seriea", "Serie A", "serie-a", "Ý", "2025/26"), ("vleague", "V.League 1", "v-league-1", "Việt Nam", "2025/26"),
)
TEAMS = (
    ("Arsenal", "ARS", "Anh", "#ef4444", "Emirates"), ("Liverpool", "LIV", "Anh", "#dc2626", "Anfield"), ("Manchester City", "MCI", "Anh", "#38bdf8", "Etihad"),
    ("Chelsea", "CHE", "Anh", "#2563eb", "Stamford Bridge"), ("Manchester United", "MUN", "Anh", "#e11d48", "Old Trafford"), ("Tottenham", "TOT", "Anh", "#e2e8f0", "Tottenham Hotspur Stadium"),
    ("Real Madrid", "RMA", "Tây Ban Nha", "#f8fafc", "Santiago Bernabéu"), ("Barcelona", "BAR", "Tây Ban Nha", "#7c3aed", "Camp Nou"), ("Atlético Madrid", "ATM", "Tây Ban Nha", "#ef4444", "Metropolitano"),
    ("Juventus", "JUV", "Ý", "#d4d4d8", "Allianz Stadium"), ("Inter Milan", "INT", "Ý", "#0ea5e9", "San Siro"), ("AC Milan", "MIL", "Ý", "#ef4444", "San Siro"),
    ("Bayern Munich", "BAY", "Đức", "#dc2626", "Allianz Arena"), ("Dortmund", "BVB", "Đức", "#facc15", "Signal Iduna Park"), ("PSG", "PSG", "Pháp", "#1d4ed8", "Parc des Princes"),
    ("Marseille", "OM", "Pháp", "#38bdf8", "Vélodrome"), ("Hà Nội FC", "HNF", "Việt Nam", "#7c3aed", "Hàng Đẫy"), ("Thể Công Viettel", "TCV", "Việt Nam", "#ef4444", "Mỹ Đình"),
    ("Nam Định", "NĐ", "Việt Nam", "#22c55e", "Thiên Trường"), ("Công An Hà Nội", "CAHN", "Việt Nam", "#dc2626", "Hàng Đẫy"),
)
MATCHES = (
    ("m1", "Premier League", "Arsenal", "Liverpool", 2, 1, "20:30", "live", 67, "Emirates"), ("m2", "La Liga", "Barcelona", "Atlético Madrid", 0, 0, "21:00", "live", 34, "Camp Nou"),
    ("m3", "Champions League", "Real Madrid", "Manchester City", None, None, "02:00", "scheduled", None, "Santiago Bernabéu"), ("m4", "Serie A", "Inter Milan", "Juventus", None, None, "01:45", "scheduled", None, "San Siro"),
    ("m5", "V.League 1", "Hà Nội FC", "Nam Định", None, None, "19:15", "scheduled", None, "Hàng Đẫy"), ("m6", "Premier League", "Chelsea", "Tottenham", 3, 2, "FT", "finished", None, "Stamford Bridge"),
    ("m7", "Serie A", "AC Milan", "Inter Milan", 1, 1, "FT", "finished", None, "San Siro"), ("m8", "Champions League", "Bayern Munich", "PSG", 2, 0, "FT", "finished", None, "Allianz Arena"),
)
STANDINGS = (
    (1, "Arsenal", 24, 17, 5, 2, 31, 56, "WWDWW"), (2, "Manchester City", 24, 16, 5, 3, 28, 53, "WDWWW"), (3, "Liverpool", 24, 15, 6, 3, 25, 51, "DWWLW"),
    (4, "Chelsea", 24, 13, 6, 5, 17, 45, "WLWDW"), (5, "Tottenham", 24, 12, 5, 7, 10, 41, "LWDWL"), (6, "Manchester United", 24, 11, 6, 7, 7, 39, "WDLWD"),
)
NAMES = ("Minh Quân", "Alex Martin", "Luka Silva", "Noah Williams", "Marco Rossi", "Kai Müller")
POSITIONS = ("Tiền đạo", "Tiền vệ", "Hậu vệ", "Thủ môn")
TRANSFER_STATES = ("Đã xác nhận", "Đang đàm phán", "Tin đồn")


def pick(values, i):
    """values[i mod their number], of a column i from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def competitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMPETITIONS), "id string, name string, slug string, country string, season string")


def teams(spark: SparkSession) -> DataFrame:
    rows = [(f"team-{i}", *t) for i, t in enumerate(TEAMS, 1)]
    return spark.createDataFrame(rows, "id string, name string, short_name string, country string, accent string, stadium string").withColumn("slug", slugify_plain(F.col("name")))


def matches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MATCHES), "id string, competition string, home string, away string, home_score int, away_score int, start string, status string, minute int, venue string")


def standings(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(STANDINGS), "position int, team string, played int, won int, drawn int, lost int, goal_difference int, points int, letters string")
    return rows.withColumn("form", F.filter(F.split("letters", ""), lambda c: c != "")).drop("letters")


def players(spark: SparkSession, n: int = 30) -> DataFrame:
    i = F.col("i")
    return spark.range(n).withColumnRenamed("id", "i").select(
        F.concat(F.lit("player-"), (i + 1).cast("string")).alias("id"), F.concat(pick(NAMES, i), F.lit(" "), (i + 1).cast("string")).alias("name"),
        pick([t[0] for t in TEAMS], i).alias("team"), pick(POSITIONS, i).alias("position"), pick([t[2] for t in TEAMS], i).alias("nationality"),
        (i * 3 % 16).alias("goals"), (i * 2 % 11).alias("assists"),
    )


def transfers_of(ids: DataFrame) -> DataFrame:
    """ids (i, from 0) -> a transfer each, further columns left out."""
    i, sure = F.col("i"), F.col("i") % 3 == 0
    names = [t[0] for t in TEAMS]
    return ids.select(
        F.concat(F.lit("transfer-"), (i + 1).cast("string")).alias("id"), F.concat(pick(NAMES, i), F.lit(" "), (i + 1).cast("string")).alias("player"),
        pick(names, i).alias("from_team"), pick(names, i + 6).alias("to_team"), pick(TRANSFER_STATES, i).alias("status"),
        F.when(sure, 94).otherwise(58 + i * 3).alias("reliability"), F.when(sure, F.concat((20 + i * 4).cast("string"), F.lit(" triệu €"))).otherwise("Chưa công bố").alias("fee"),
        F.concat((i + 1).cast("string"), F.lit(" giờ trước")).alias("updated"),
    )


def transfers(spark: SparkSession, n: int = 10) -> DataFrame:
    return transfers_of(spark.range(n).withColumnRenamed("id", "i"))


def seeded_players(ids: DataFrame) -> DataFrame:
    """Ids (id, from 1) -> a player each as the seed makes them: id, name, slug, born, position, shirt."""
    i = F.col("id").cast("string")
    return ids.select(
        "id", F.concat(pick(NAMES, F.col("id") - 1), F.lit(" "), i).alias("name"), F.concat(F.lit("demo-player-"), i).alias("slug"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") * 97).cast("int")).alias("born"), pick(POSITIONS, F.col("id") - 1).alias("position"), (F.col("id") * 7 % 30 + 1).alias("shirt"),
    )
