"""Queries over provider answers: tables land as the JSON that providers send, one answer a line, and are read back from it, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import matches
from newsloom.operators.shared import new_path
from newsloom.sources import demo, sports
from newsloom.sources.articles import read

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _land(spark, answers, name: str) -> str:
    path = new_path(spark, name)
    answers.write.json(path)
    return path


def _games(spark, d):
    """Orders as matches between a segment and a nation; a customer's orders make one answer."""
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("away"))
    sides = read(spark, d, "customer").join(nations, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("home"), "away")
    o = read(spark, d, "orders").join(sides, "o_custkey")
    at = F.date_format(F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.withColumn("at", at)


_GAMES = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, c_mktsegment AS home, n_name AS away, o_orderdate + to_minutes(o_orderkey % 1440) AS kickoff
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""
_STATE = "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'live' ELSE 'scheduled' END AS status"


@query(f"""WITH {_GAMES} SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS competition, home, away, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 5 AS INT) END AS home_score,
CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey % 4 AS INT) END AS away_score, {_STATE}, CASE WHEN o_orderkey % 3 = 0 THEN 'Chưa công bố' ELSE 'Ground ' || (o_custkey % 7) END AS venue,
strftime(kickoff + INTERVAL 7 HOURS, '%H:%M') AS start FROM o WHERE o_custkey % 6 IN (2, 3)""")
def landed_fixtures(spark, d):
    """Two leagues out of six."""
    o, played = _games(spark, d), F.col("o_orderstatus") != "P"
    short = F.when(F.col("o_orderstatus") == "F", "FT").when(F.col("o_orderstatus") == "O", "1H").otherwise("NS")
    venue = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("Ground "), (F.col("o_custkey") % 7).cast("string")))
    one = F.struct(
        F.struct(F.col("o_orderkey").alias("id"), F.col("at").alias("date"), F.struct(short.alias("short")).alias("status"), F.struct(venue.alias("name")).alias("venue")).alias("fixture"),
        F.struct((F.col("o_custkey") % 6).alias("id"), F.col("o_orderpriority").alias("name")).alias("league"),
        F.struct(F.struct(F.col("home").alias("name")).alias("home"), F.struct(F.col("away").alias("name")).alias("away")).alias("teams"),
        F.struct(F.when(played, F.col("o_orderkey") % 5).alias("home"), F.when(played, F.col("o_custkey") % 4).alias("away")).alias("goals"),
    )
    path = _land(spark, o.groupBy("o_custkey").agg(F.collect_list(one).alias("response")).select("response"), "fixtures")
    return sports.api_matches(spark, path, [2, 3], lines=True).select("id", "competition", "home", "away", "home_score", "away_score", "status", "venue", "start")


@query(f"""WITH {_GAMES}, m AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS competition, home, CASE WHEN o_orderkey % 4 = 0 THEN 'Chưa xác định' ELSE away END AS away,
CAST(o_orderkey % 5 AS INT) AS home_score, {_STATE}, strftime(kickoff + INTERVAL 7 HOURS, '%H:%M %d/%m') AS start, CAST(kickoff AS DATE) AS day FROM o)
SELECT * EXCLUDE day FROM m WHERE day BETWEEN DATE '1996-12-31' AND DATE '1997-01-08'""")
def landed_matches_of_a_week(spark, d):
    """Names by what is there, scores by either name, a window of days."""
    o = _games(spark, d)
    word = F.when(F.col("o_orderstatus") == "F", "FINISHED").when(F.col("o_orderstatus") == "O", "IN_PLAY").otherwise("TIMED")
    away, new = F.when(F.col("o_orderkey") % 4 != 0, F.col("away")), F.col("o_orderkey") % 2 == 0
    goals = F.col("o_orderkey") % 5
    one = F.struct(
        F.col("o_orderkey").alias("id"), F.col("at").alias("utcDate"), word.alias("status"), F.struct(F.col("o_orderpriority").alias("name")).alias("competition"),
        F.struct(F.when(new, F.col("home")).alias("name"), F.col("home").alias("shortName")).alias("homeTeam"), F.struct(F.lit(" ").alias("name"), away.alias("tla")).alias("awayTeam"),
        F.struct(F.struct(F.when(new, goals).alias("home"), F.when(~new, goals).alias("homeTeam")).alias("fullTime")).alias("score"),
    )
    path = _land(spark, o.groupBy("o_custkey").agg(F.collect_list(one).alias("matches")).select("matches"), "matches")
    week = sports.in_window(sports.data_matches(spark, path, lines=True), F.lit("1997-01-01").cast("date"))
    return week.select("id", "competition", "home", "away", "home_score", "status", "start")


_FORM = "CASE l_returnflag WHEN 'A' THEN 'W' WHEN 'N' THEN 'D' ELSE 'L' END"
_TABLE = f"""WITH r AS (SELECT l_orderkey, string_agg({_FORM}, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS letters FROM lineitem GROUP BY l_orderkey)"""


def _tables(spark, d):
    """Every order is a team whose lines, by number, are its results."""
    letter = F.when(F.col("l_returnflag") == "A", "W").when(F.col("l_returnflag") == "N", "D").otherwise("L")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", letter.alias("x"))
    r = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["x"]).alias("results"))
    return r.withColumn("n", F.col("l_orderkey").cast("int"))


@query(_TABLE + """ SELECT CAST(l_orderkey AS INT) AS position, 'Team ' || l_orderkey AS team, CAST(length(letters) AS INT) AS played, right(letters, 5) AS form FROM r""")
def landed_tables_by_letters(spark, d):
    """P06 of the first provider."""
    row = F.struct(
        F.col("n").alias("rank"), F.struct(F.concat(F.lit("Team "), F.col("l_orderkey").cast("string")).alias("name")).alias("team"), F.array_join("results", "").alias("form"),
        F.struct(F.size("results").alias("played")).alias("all"),
    )
    answer = _tables(spark, d).select(F.array(F.struct(F.struct(F.array(F.array(row)).alias("standings")).alias("league"))).alias("response"))
    t = sports.api_standings(spark, _land(spark, answer, "tables"), lines=True)
    return t.select("position", "team", "played", F.array_join("form", "").alias("form"))


@query(_TABLE + """ SELECT CAST(l_orderkey AS INT) AS position, 'T' || l_orderkey AS team, CAST(length(letters) AS INT) AS played, right(letters, 5) AS form FROM r""")
def landed_tables_by_list(spark, d):
    """P06, P07, P09 of the second provider: of two tables that which is called TOTAL."""
    row = F.struct(F.col("n").alias("position"), F.struct(F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("tla")).alias("team"), F.size("results").alias("playedGames"), F.array_join("results", ",").alias("form"))
    answer = _tables(spark, d).select(F.array(F.struct(F.lit("HOME").alias("type"), F.slice(F.array(row), 1, 0).alias("table")), F.struct(F.lit("TOTAL").alias("type"), F.array(row).alias("table"))).alias("standings"))
    t = sports.data_standings(spark, _land(spark, answer, "standings"), lines=True)
    return t.select("position", "team", "played", F.array_join("form", "").alias("form"))


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'C' || s_suppkey ELSE 'SUP' END AS short_name, {_SLUG.format('s_name')} AS slug, n_name AS country, '' AS venue
FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'p' || p_partkey, p_name, upper(left(p_name, 3)), {_SLUG.format('p_name')}, '', p_brand FROM part""")
def landed_teams(spark, d):
    """P08 of both providers: suppliers and parts as teams."""
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = read(spark, d, "supplier").join(nation, "s_nationkey")
    code = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("C"), F.col("s_suppkey").cast("string")))
    one = F.struct(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), code.alias("code"), F.col("n_name").alias("country")).alias("team"))
    first = sports.api_teams(spark, _land(spark, s.select(F.array(one).alias("response")), "teams"), lines=True)
    other = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("venue"))
    second = sports.data_teams(spark, _land(spark, read(spark, d, "part").select(F.array(other).alias("teams")), "clubs"), lines=True)
    return first.unionByName(second.withColumn("id", F.concat(F.lit("p"), F.col("id"))))


# Fixed values, for SQL: the demo teams (short name, name, stadium) in their order, and the demo matches.
_TEAMS = """t AS (SELECT unnest(range(0, 20)) AS i, unnest(['ARS','LIV','MCI','CHE','MUN','TOT','RMA','BAR','ATM','JUV','INT','MIL','BAY','BVB','PSG','OM','HNF','TCV','NĐ','CAHN']) AS short_name,
unnest(['Arsenal','Liverpool','Manchester City','Chelsea','Manchester United','Tottenham','Real Madrid','Barcelona','Atlético Madrid','Juventus','Inter Milan','AC Milan','Bayern Munich','Dortmund','PSG','Marseille',
'Hà Nội FC','Thể Công Viettel','Nam Định','Công An Hà Nội']) AS name,
unnest(['Emirates','Anfield','Etihad','Stamford Bridge','Old Trafford','Tottenham Hotspur Stadium','Santiago Bernabéu','Camp Nou','Metropolitano','Allianz Stadium','San Siro','San Siro','Allianz Arena','Signal Iduna Park',
'Parc des Princes','Vélodrome','Hàng Đẫy','Mỹ Đình','Thiên Trường','Hàng Đẫy']) AS stadium)"""


def _followed(spark, d):
    """Customers follow the demo teams in turn."""
    i = F.concat(F.lit("team-"), (F.col("c_custkey") % 20 + 1).cast("string"))
    return read(spark, d, "customer").select("c_custkey", i.alias("id")).join(F.broadcast(demo.teams(spark)), "id")  # 20 teams


@query(f"""WITH {_TEAMS} SELECT c_custkey, 'team-' || (i + 1) AS id, name, short_name, stadium, trim(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM customer JOIN t ON i = c_custkey % 20""")
def demo_teams(spark, d):
    return _followed(spark, d).select("c_custkey", "id", "name", "short_name", "stadium", "slug")


@query(f"""WITH {_TEAMS}, m AS (SELECT * FROM (VALUES ('Arsenal', 'Liverpool', 'live'), ('Barcelona', 'Atlético Madrid', 'live'), ('Real Madrid', 'Manchester City', 'scheduled'), ('Inter Milan', 'Juventus', 'scheduled'),
('Hà Nội FC', 'Nam Định', 'scheduled'), ('Chelsea', 'Tottenham', 'finished'), ('AC Milan', 'Inter Milan', 'finished'), ('Bayern Munich', 'PSG', 'finished')) AS m(home, away, status))
SELECT status, count(*) AS n FROM customer JOIN t ON i = c_custkey % 20 JOIN m ON name IN (home, away) GROUP BY status""")
def demo_matches_by_status(spark, d):
    """How many customers see a match of the team that they follow."""
    m = sports.provider_matches(spark, sports.provider_name(None, "football-data")).select(F.explode(F.array("home", "away")).alias("name"), "status")
    return _followed(spark, d).select("name").join(F.broadcast(m), "name").groupBy("status").agg(F.count("*").alias("n"))  # 16 sides


@query(f"""WITH {_TEAMS} SELECT 'transfer-' || (s_suppkey + 1) AS id, a.name AS from_team, b.name AS to_team, CASE s_suppkey % 3 WHEN 0 THEN 94 ELSE 58 + s_suppkey * 3 END AS reliability,
CASE s_suppkey % 3 WHEN 0 THEN (20 + s_suppkey * 4) || ' triệu €' ELSE 'Chưa công bố' END AS fee FROM supplier JOIN t a ON a.i = s_suppkey % 20 JOIN t b ON b.i = (s_suppkey + 6) % 20""")
def demo_transfers(spark, d):
    return demo.transfers_of(read(spark, d, "supplier").select(F.col("s_suppkey").alias("i"))).select("id", "from_team", "to_team", "reliability", "fee")


@query("""SELECT s_suppkey + 1 AS id, ['Minh Quân', 'Alex Martin', 'Luka Silva', 'Noah Williams', 'Marco Rossi', 'Kai Müller'][s_suppkey % 6 + 1] || ' ' || (s_suppkey + 1) AS name, 'demo-player-' || (s_suppkey + 1) AS slug,
CAST(DATE '1995-01-01' + CAST((s_suppkey + 1) * 97 AS INT) AS DATE) AS born, ['Tiền đạo', 'Tiền vệ', 'Hậu vệ', 'Thủ môn'][s_suppkey % 4 + 1] AS position, ((s_suppkey + 1) * 7) % 30 + 1 AS shirt FROM supplier""")
def generated_rows(spark, d):
    return demo.seeded_players(read(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("id")))


@query("""SELECT n_regionkey AS name, count(*) = 4 AND bool_and(c_mktsegment <> 'MACHINERY' AND c_acctbal >= 0) AS real
FROM (SELECT n_regionkey, c_mktsegment, min(c_acctbal) AS c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment <> 'BUILDING' OR n_regionkey = 1 GROUP BY ALL) GROUP BY n_regionkey
UNION ALL SELECT c_nationkey + 100, count(DISTINCT c_mktsegment) = 4 AND bool_and(c_mktsegment <> 'MACHINERY') FROM customer WHERE c_mktsegment <> 'MACHINERY' OR c_nationkey % 2 = 0 GROUP BY c_nationkey""")
def providers_real(spark, d):
    """Segments as providers of a region, where the poorest customer tells demo answers, and of a nation."""
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = read(spark, d, "customer").join(nations, "c_nationkey")
    named = F.when(F.col("c_mktsegment") == "MACHINERY", "mock").otherwise(F.col("c_mktsegment")).alias("provider")
    regions = c.where("c_mktsegment <> 'BUILDING' OR n_regionkey = 1").groupBy(F.col("n_regionkey").alias("name"), named).agg((F.min("c_acctbal") < 0).alias("demo"))
    own = c.where("c_mktsegment <> 'MACHINERY' OR c_nationkey % 2 = 0").select((F.col("c_nationkey") + 100).alias("name"), named, F.lit(False).alias("demo")).distinct()
    return matches.all_real(regions, by=["name"]).unionAll(matches.all_real(own, by=["name"]))
