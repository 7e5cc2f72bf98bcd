"""Queries over matches, standings, the warehouse and the limiter, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import scoring
from newsloom.functions.timeparse import normalize_timestamp
from newsloom.operators import dedupe, ratelimit, warehouse
from newsloom.operators.ranking import with_rank
from newsloom.sources import sports
from newsloom.sources.articles import read

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# Unions


@query("""WITH u AS (SELECT 1 AS l, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 2, o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT 3, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
w AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l DESC) AS n, min(l) OVER (PARTITION BY o_orderkey) AS first_list FROM u)
SELECT o_orderkey, o_orderstatus, o_totalprice, l AS list, first_list FROM w WHERE n = 1""")
def union_merge_dedupe(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    lists = [o.where("o_orderstatus = 'P'"), o, o.where("o_orderstatus = 'F'")]
    u = None
    for n, df in enumerate(lists, 1):
        df = df.withColumn("list", F.lit(n))
        u = df if u is None else u.unionByName(df)
    return dedupe.last_wins(u, "o_orderkey", "list").withColumnRenamed("first_seq", "first_list")


@query("""(SELECT c_name AS label, '/team/' || c_custkey AS href, 'team' AS kind FROM customer WHERE contains(lower(c_name), '0001') ORDER BY c_custkey LIMIT 5)
UNION ALL (SELECT p_name, '/news/' || p_partkey, 'news' FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_partkey LIMIT 3)
UNION ALL (SELECT o_orderpriority, '/match/' || o_orderkey, 'match' FROM orders WHERE contains(lower(o_orderpriority), 'urgent') ORDER BY o_orderkey LIMIT 2)""")
def search_hits_union(spark, d):
    def hits(table, label, key, kind, q, n):
        t = read(spark, d, table).where(F.contains(F.lower(label), F.lit(q))).orderBy(key).limit(n)
        return t.select(F.col(label).alias("label"), F.concat(F.lit(f"/{kind}/"), F.col(key).cast("string")).alias("href"), F.lit(kind).alias("kind"))

    return hits("customer", "c_name", "c_custkey", "team", "0001", 5).unionByName(hits("part", "p_name", "p_partkey", "news", "a", 3)).unionByName(hits("orders", "o_orderpriority", "o_orderkey", "match", "urgent", 2))


# Limiter


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, us + 86400000000 AS reset, CAST(1 AS BIGINT) AS n FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.us >= r.reset THEN e.us + 86400000000 ELSE r.reset END, CASE WHEN e.us >= r.reset THEN 1 ELSE r.n + 1 END
FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, user_id, n, n <= 3 AS allowed, greatest(0, 3 - n) AS remaining FROM r""")
def rate_limit_fixed_window(spark, d):
    return ratelimit.rate_limit(read(spark, d, "events"), "user_id", "ts", "event_id", 3, 86400)


# Matches and standings


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'live' ELSE 'scheduled' END"


@query(f"SELECT o_orderkey, {_STATUS} AS status, {_STATUS} AS status_text FROM orders")
def status_map(spark, d):
    s = F.col("o_orderstatus")
    short = F.when(s == "F", "FT").when(s == "P", "2H").otherwise("NS")
    words = F.when(s == "F", "FINISHED").when(s == "P", "IN_PLAY").otherwise("TIMED")
    return read(spark, d, "orders").select("o_orderkey", scoring.match_status(short).alias("status"), scoring.match_status_text(words).alias("status_text"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P'")
def match_by_status(spark, d):
    return read(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")


@query("SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first_key, array_to_string((list(o_orderkey ORDER BY o_orderkey))[1:5], ',') AS head FROM orders GROUP BY o_orderpriority")
def grouped_by_competition(spark, d):
    from pyspark.sql import Window

    o = read(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    g = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))
    head = o.withColumn("r", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))).where("r <= 5")
    head = head.groupBy("o_orderpriority").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("head"))
    return g.join(head, "o_orderpriority")


@query("""WITH o AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'W' WHEN 'O' THEN 'D' ELSE 'X' END AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n,
o_orderdate, o_orderkey FROM orders)
SELECT o_custkey, coalesce(string_agg(r, '' ORDER BY o_orderdate, o_orderkey) FILTER (WHERE n <= 5 AND r <> 'X'), '') AS form FROM o GROUP BY o_custkey""")
def form_last5(spark, d):
    from pyspark.sql import Window

    r = F.when(F.col("o_orderstatus") == "F", "W").when(F.col("o_orderstatus") == "O", "D").otherwise("X")
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    o = read(spark, d, "orders").withColumn("place", newest).where("place <= 5").select("o_custkey", F.struct("o_orderdate", "o_orderkey", r.alias("r")).alias("x"))
    form = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]), "")
    return o.groupBy("o_custkey").agg(form.alias("last")).select("o_custkey", F.array_join(sports.form_of_letters(F.col("last")), "").alias("form"))


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS position, (row_number() OVER (ORDER BY n_nationkey) * 7) % 30 + 1 AS shirt FROM nation")
def standings_row_number(spark, d):
    n = with_rank(read(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    position = F.col("rank") + 1
    return n.select("n_nationkey", "n_name", position.alias("position"), (position * 7 % 30 + 1).alias("shirt"))


# Warehouse


@query("""SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_mktsegment = 'BUILDING'""")
def upsert_do_nothing(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    known, loaded = c.where("c_mktsegment <> 'BUILDING'"), c.where("c_mktsegment IN ('BUILDING', 'MACHINERY')")
    return warehouse.insert_new(known.drop("c_mktsegment"), loaded.select("c_custkey", F.lit("new").alias("c_name")), "c_custkey")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'new' ELSE c_name END AS c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT c_custkey, 'new', c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'""")
def upsert_do_update(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    known, loaded = c.where("c_mktsegment <> 'BUILDING'"), c.where("c_mktsegment IN ('BUILDING', 'MACHINERY')")
    return warehouse.upsert(known, loaded.withColumn("c_name", F.lit("new")), "c_custkey", ["c_name"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')")
def fk_orphans(spark, d):
    return warehouse.orphans(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", read(spark, d, "customer").where("c_mktsegment <> 'BUILDING'"), "c_custkey")


@query("""SELECT l_orderkey, l_linenumber, 'quantity_range' AS rule FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 45
UNION ALL SELECT l_orderkey, l_linenumber, 'discount_below_tax' FROM lineitem WHERE NOT l_discount <= 0.09
UNION ALL SELECT l_orderkey, l_linenumber, 'flag_known' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT l_orderkey, l_linenumber, 'part_not_supplier' FROM lineitem WHERE NOT l_partkey <> l_suppkey""")
def check_violations(spark, d):
    rules = {
        "quantity_range": F.col("l_quantity").between(1, 45), "discount_below_tax": F.col("l_discount") <= 0.09,
        "flag_known": F.col("l_returnflag").isin("A", "N"), "part_not_supplier": F.col("l_partkey") != F.col("l_suppkey"),
    }
    return warehouse.violations(read(spark, d, "lineitem"), rules).select("l_orderkey", "l_linenumber", "rule")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'F'
OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = 7 AND c_mktsegment = 'ADMIN')""")
def rls_view(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    admin = not read(spark, d, "customer").where("c_custkey = 7 AND c_mktsegment = 'ADMIN'").limit(1).isEmpty()
    return warehouse.visible(o, F.col("o_custkey") == 7, F.col("o_orderstatus") == "F", F.lit(admin))


@query("SELECT c_custkey, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS country FROM customer")
def scalar_subquery_lookup(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    return read(spark, d, "customer").join(n, "c_nationkey", "left").select("c_custkey", "country")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_semi(spark, d):
    o = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, d.lang) AS topic, l.doc_id IS NOT NULL AS translated FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def enrichment_left_overlay(spark, d):
    given = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("given"), F.lit(True).alias("hit"))
    docs = read(spark, d, "documents").select("doc_id", "lang")
    return docs.join(given, "doc_id", "left").select("doc_id", F.coalesce("given", "lang").alias("topic"), F.coalesce("hit", F.lit(False)).alias("translated"))


# JSON, generated rows, times


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_prop_extract(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_FORMS = (  # nine ways to write a time, by order
    "CASE o_orderkey % 9 WHEN 0 THEN date_format(t, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 1 THEN date_format(t, 'EEE, dd MMM yyyy HH:mm:ss') || ' EST' WHEN 2 THEN date_format(t, 'EEE, dd MMM yyyy HH:mm:ss') || ' BST' "
    "WHEN 3 THEN date_format(t, 'M/d/yyyy h:mm:ss a') WHEN 4 THEN date_format(t, 'yyyy-MM-dd') WHEN 5 THEN date_format(t, 'EEE, dd MMM yyyy HH:mm:ss') || ' +0700' WHEN 6 THEN date_format(t, 'dd MMM yyyy HH:mm:ss') || ' GMT' "
    "WHEN 7 THEN date_format(t, 'EEE, dd MMM yyyy HH:mm:ss') || ' PDT' ELSE o_orderstatus END"
)


@query("""WITH o AS (SELECT o_orderkey, o_orderdate, o_orderdate + to_minutes(o_orderkey % 1440) AS t FROM orders),
u AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 1 THEN t + to_hours(CASE WHEN month(t) BETWEEN 3 AND 11 THEN 4 ELSE 5 END) WHEN 2 THEN t - INTERVAL 1 HOUR WHEN 3 THEN t - INTERVAL 7 HOURS WHEN 4 THEN date_trunc('day', t)
WHEN 5 THEN t - INTERVAL 7 HOURS WHEN 7 THEN t + INTERVAL 7 HOURS WHEN 8 THEN NULL ELSE t END AS published FROM o)
SELECT o_orderkey, CASE WHEN published > TIMESTAMP '1999-06-01 00:10:00' THEN TIMESTAMP '1999-06-01 00:00:00' ELSE published END AS published FROM u""")
def normalize_timestamps(spark, d):
    t = (F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))).cast("timestamp")
    rows = read(spark, d, "orders").withColumn("t", t).select("o_orderkey", F.expr(_FORMS).alias("given"))
    now = F.lit("1999-06-01 00:00:00").cast("timestamp")
    return rows.select("o_orderkey", normalize_timestamp(F.col("given"), now, F.lit(True)).cast("timestamp_ntz").alias("published"))
