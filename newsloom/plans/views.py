"""Queries over match views, enrichment, ingestion and the warehouse's rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import warehouse_rules
from newsloom.functions import dates
from newsloom.operators import dedupe, enrich, matches, warehouse
from newsloom.plans import sql
from newsloom.sources import feeds
from newsloom.sources.articles import NOW, articles, items, read

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def match_view(spark, d):
    """Orders as matches: segments play nations, for a priority."""
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("away"))
    sides = read(spark, d, "customer").join(nations, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("home"), "away")
    status = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "P", "live").otherwise("scheduled")
    return read(spark, d, "orders").join(sides, "o_custkey").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("competition"), "home", "away", status.alias("status"), F.lit("Sân nhà").alias("venue"), F.col("o_orderdate").alias("start_time")
    )


_M = """m AS (SELECT o_orderkey AS seq, o_orderpriority AS competition, c_mktsegment AS home, n_name AS away,
CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'live' ELSE 'scheduled' END AS status, 'Sân nhà' AS venue, o_orderdate AS start_time
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def _text(*columns: str) -> str:
    return sql.fold(" || ' ' || ".join(columns))


# Matches and entities


@query(f"WITH {_M} SELECT seq, home, away FROM m WHERE contains({_text('home', 'away', 'competition', 'venue')}, 'san nha') AND competition = '2-HIGH' AND (home = 'BUILDING' OR away = 'BUILDING')")
def match_filter(spark, d):
    return matches.filter_matches(match_view(spark, d), "sÂn  nhà", "2-HIGH", "BUILDING").select("seq", "home", "away")


@query(f"WITH {_M} SELECT seq, home, away, status FROM m WHERE status <> 'finished' AND (contains({_text('home', 'away', 'competition')}, 'machinery') OR contains({_text('home', 'away', 'competition')}, '5 low')) ORDER BY seq LIMIT 3")
def entity_fixtures(spark, d):
    return matches.entity_fixtures(match_view(spark, d), ["Machinery", "5-LOW"]).select("seq", "home", "away", "status")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1")
def point_lookup(spark, d):
    return matches.point_lookup(read(spark, d, "customer"), "c_mktsegment", "BUILDING", "c_custkey").select("c_custkey", "c_name")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def followed_names(spark, d):
    nations = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    follows = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").cast("string").alias("entity_id"))
    return matches.followed_names(nations, follows)


@query("""WITH t AS (SELECT p_brand AS name, arg_min(p_type, p_partkey) AS accent FROM part WHERE p_size < 10 GROUP BY p_brand)
SELECT p_partkey, p_brand, coalesce(accent, '#7cfa4c') AS accent FROM part LEFT JOIN t ON name = p_brand""")
def team_display(spark, d):
    p = read(spark, d, "part")
    teams = p.where("p_size < 10").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_type").alias("accent"))
    return matches.with_display(p.select("p_partkey", "p_brand"), "p_brand", teams)


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(*) FROM nation) AS total")
def total_hits(spark, d):
    return matches.total_hits(*(read(spark, d, t) for t in ("customer", "part", "nation")))


@query("SELECT s_suppkey, CASE WHEN n < 10 THEN '0' ELSE '' END || n AS label FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier)")
def numbered_list(spark, d):
    return matches.numbered(read(spark, d, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "label")


@query(f"""WITH {sql.ITEMS}, h AS (SELECT *, row_number() OVER (ORDER BY hotness DESC, reliability DESC, seq) AS n FROM i) SELECT id, hotness, reliability, n = 1 AS hero FROM h WHERE n <= 7""")
def home_highlights(spark, d):
    i = items(spark, d)
    hero = matches.hottest(i).first()
    if hero is None:
        return i.select("id", "hotness", "reliability", F.lit(True).alias("hero"))
    first = i.where(F.col("id") == hero.id).select("id", "hotness", "reliability", F.lit(True).alias("hero"))
    return first.unionAll(matches.hottest(i, 6, hero.id).select("id", "hotness", "reliability", F.lit(False).alias("hero")))


# Enrichment


@query(f"WITH {sql.ARTICLES} SELECT seq, published FROM a WHERE language = 'en' ORDER BY published DESC, seq LIMIT 20")
def translate_candidates(spark, d):
    return enrich.translate_candidates(articles(spark, d)).select("seq", "published")


@query("""WITH e AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'good ' || doc_id ELSE '' END AS title, 'text' AS summary FROM labels)
SELECT doc_id AS id, coalesce(title, source) AS title, coalesce(summary, lang) AS excerpt, title IS NOT NULL AS translated FROM documents LEFT JOIN e ON id = doc_id AND title <> '' AND lang = 'en'""")
def enrichment_overlay(spark, d):
    a = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("excerpt"), "lang")
    title = F.when(F.col("quality") == 1, F.concat(F.lit("good "), F.col("doc_id").cast("string"))).otherwise("")
    given = read(spark, d, "labels").select(F.col("doc_id").alias("id"), title.alias("title"), F.lit("text").alias("summary"))
    return enrich.overlay(a, enrich.accepted(given, a.where("lang = 'en'"))).select("id", "title", "excerpt", "translated")


@query(f"""WITH {sql.ITEMS} SELECT seq, CASE WHEN seq % 2 = 0 THEN 'given' ELSE source END AS name, CASE WHEN seq % 2 = 0 THEN 'u' ELSE '#' END AS url
FROM (SELECT i.seq, unnest(i.sources) AS source FROM i)""")
def source_details_fallback(spark, d):
    kind = "array<struct<name:string,url:string,reliability:int,language:string>>"
    given = F.when(F.col("seq") % 2 == 0, F.array(F.struct(F.lit("given").alias("name"), F.lit("u").alias("url"), F.lit(1).alias("reliability"), F.lit("vi").alias("language"))))
    i = items(spark, d).withColumn("details", given.cast(kind))
    out = enrich.source_details(F.col("details"), F.col("sources"), F.lit(None).cast("string"), F.col("reliability"), F.col("language"))
    return i.select("seq", F.explode(out).alias("x")).select("seq", "x.name", "x.url")


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)
SELECT conv_id AS cluster, arg_min(role, pos) AS title, arg_min(text, pos) || '{enrich.SUMMARY_NOTE}' AS summary,
string_agg(role, ',' ORDER BY pos) FILTER (WHERE pos <= 3) AS key_points, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY pos) AS source_ids FROM c GROUP BY conv_id""")
def cluster_summaries(spark, d):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("cluster"), pos.alias("pos"), F.col("turn").cast("string").alias("id"), F.col("role").alias("title"), F.col("text").alias("excerpt"))
    return enrich.summaries(c).select("cluster", "title", "summary", F.array_join("key_points", ",").alias("key_points"), F.array_join("source_ids", ",").alias("source_ids"))


@query(f"""WITH {sql.ARTICLES}, x AS (SELECT *, lower(title || ' ' || excerpt) AS t FROM a) SELECT seq, CASE WHEN contains(t, 'arsenal') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'liverpool') THEN 1 ELSE 0 END AS n_teams,
CASE WHEN contains(t, 'champions') THEN 'champions-league' ELSE 'premier-league' END AS competition FROM x""")
def extracted_entities(spark, d):
    e = articles(spark, d).select("seq", enrich.entities(F.col("title"), F.col("excerpt")).alias("e"))
    return e.select("seq", F.size("e.teams").alias("n_teams"), F.get("e.competitions", F.lit(0)).alias("competition"))


# Ingestion, times


@query(f"""WITH {sql.ITEMS}, f AS (SELECT id FROM i ORDER BY seq LIMIT 5) SELECT count(*) AS fetched, count(DISTINCT id) AS inserted, count(*) - count(DISTINCT id) AS skipped, count(DISTINCT id) AS classified, 'success' AS status FROM f""")
def mock_ingestion(spark, d):
    first = items(spark, d).withColumn("slug", F.col("id"))
    landed = feeds.normalized(feeds.mock_articles(first, F.lit(NOW)), "mock")
    return dedupe.run_log(landed, "hash")


@query("""WITH e AS (SELECT event_id, ts, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts) AS s, ts + INTERVAL 7 HOURS AS l FROM events),
u AS (SELECT *, CASE WHEN s < 60 THEN floor(s + 0.5) || ' giây' WHEN s < 3600 THEN CAST(floor(s / 60 + 0.5) AS BIGINT) || ' phút' WHEN s < 86400 THEN CAST(floor(s / 3600 + 0.5) AS BIGINT) || ' giờ'
WHEN s < 2592000 THEN CAST(floor(s / 86400 + 0.5) AS BIGINT) || ' ngày' ELSE CAST(floor(s / 2592000 + 0.5) AS BIGINT) || ' tháng' END AS ago
FROM (SELECT * REPLACE (CAST(floor(s) AS DOUBLE) AS s) FROM (SELECT event_id, ts, l, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) AS s FROM e)))
SELECT event_id, strftime(l, '%H:%M') AS clock, strftime(l, '%H:%M %d/%m') AS day_clock, strftime(l, '%Y-%m-%d') AS day, ago || ' trước' AS ago FROM u""")
def date_labels(spark, d):
    ts = F.col("ts")
    return read(spark, d, "events").select(
        "event_id", dates.clock(ts).alias("clock"), dates.day_and_clock(ts).alias("day_clock"), dates.local_day(ts).alias("day"), dates.distance(ts, F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("ago")
    )


# Warehouse


@query("""SELECT c_custkey, list_aggregate(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+'), lambda w: w <> ''))), 'string_agg', ',') AS words FROM customer""")
def text_vector(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.array_join(warehouse.text_vector("c_name", "c_mktsegment"), ",").alias("words"))


@query("SELECT l_orderkey, l_linenumber, l_partkey - l_suppkey AS difference FROM lineitem")
def generated_difference(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", warehouse_rules.goal_difference(F.col("l_partkey"), F.col("l_suppkey")).alias("difference"))


@query("""SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY s_suppkey) AS id, s_name, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM supplier""")
def insert_returning(spark, d):
    notes = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    new = read(spark, d, "supplier").select("s_suppkey", "s_name")
    return warehouse.insert_returning(notes, new, ["s_suppkey"], F.lit(NOW).cast("timestamp_ntz")).select("id", "s_name", "created_at")


@query("""SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS c_name, CASE WHEN s_suppkey IS NOT NULL THEN 'now' ELSE 'then' END AS updated_at FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
UNION ALL SELECT s_suppkey, s_name, 'now' FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey)""")
def touched_rows(spark, d):
    target = read(spark, d, "customer").select("c_custkey", "c_name", F.lit("then").alias("updated_at"))
    source = read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("").alias("updated_at"))
    return warehouse.touched(target, source, "c_custkey", ["c_name"], F.lit("now"))


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE c_name END AS display_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def new_profiles(spark, d):
    meta = F.when(F.col("c_acctbal") < 0, F.to_json(F.struct(F.col("c_mktsegment").alias("display_name")))).otherwise("{}")
    users = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("@mail.example")).alias("email"), meta.alias("meta"))
    return warehouse.new_profiles(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), users)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'failed' END AS status,
o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS moved FROM orders""")
def job_states(spark, d):
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    jobs = o.select(F.col("o_orderkey").alias("id"), status.alias("status"))
    return warehouse.advanced(jobs, o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.lit("completed").alias("to")))


@query("""SELECT o_orderkey AS id, 'two_teams' AS rule FROM orders WHERE o_custkey % 25 = o_orderkey % 25 UNION ALL SELECT o_orderkey, 'minute_range' FROM orders WHERE o_totalprice / 1000 > 200
UNION ALL SELECT o_orderkey, 'status_known' FROM orders WHERE o_orderstatus = 'P'""")
def match_checks(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("unknown")
    m = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("minute"), F.lit(0).alias("home_score"), F.lit(None).cast("int").alias("away_score"),
        (F.col("o_custkey") % 25).alias("home_team_id"), (F.col("o_orderkey") % 25).alias("away_team_id"), status.alias("status"),
    )
    return warehouse_rules.broken_checks(m, "matches").select("id", "rule")


@query("""SELECT 'players' AS child, 'team_id' AS fk, CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'matches', 'home_team_id', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_regionkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def broken_references(spark, d):
    teams = read(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("id"))
    players = read(spark, d, "customer").select(F.col("c_nationkey").alias("team_id"))
    m = read(spark, d, "nation").select(F.col("n_regionkey").alias("home_team_id"), F.lit(None).cast("int").alias("away_team_id"))
    return warehouse_rules.broken_references({"teams": teams, "players": players, "matches": m})


@query("""SELECT 'own' AS who, count(*) AS n FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'published', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'admin', count(*) FROM orders
UNION ALL SELECT 'links', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' UNION ALL SELECT 'nobody', 0""")
def readable_rows(spark, d):
    o = read(spark, d, "orders")
    clusters = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft").alias("status"))
    tables = {
        "bookmarks": o.select(F.col("o_custkey").cast("string").alias("user_id")), "news_clusters": clusters,
        "news_cluster_articles": read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster_id")), "raw_articles": o,
    }
    see = lambda who, *how: warehouse_rules.readable(tables, *how).agg(F.count("*").alias("n")).select(F.lit(who).alias("who"), "n")
    seen = [see("own", "bookmarks", "7"), see("published", "news_clusters"), see("admin", "news_clusters", None, True), see("links", "news_cluster_articles"), see("nobody", "raw_articles", "7")]
    out = seen[0]
    for s in seen[1:]:
        out = out.unionAll(s)
    return out
