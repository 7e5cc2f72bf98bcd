"""Queries over articles and news items, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import scoring, text
from newsloom.operators import clustering, dedupe, search, similarity
from newsloom.operators import feed as news_feed
from newsloom.plans import sql
from newsloom.sources.articles import articles, items, read

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# Search and filters


@query(f"WITH {sql.ITEMS} SELECT id, title FROM i WHERE contains(search_text, {sql.fold(repr('Ér thán'))})")
def search_text_filter(spark, d):
    return search.filter_items(items(spark, d), "Ér thán").select("id", "title")


@query(f"WITH {sql.ITEMS} SELECT id, hotness FROM i WHERE contains(search_text, 'the') AND competition = 'Bóng đá quốc tế' AND team = 'src3' AND hotness >= 30")
def multi_predicate_filter(spark, d):
    return search.filter_items(items(spark, d), "The", "Bóng đá quốc tế", "src3", 30).select("id", "hotness")


@query(f"WITH {sql.ITEMS} SELECT id, hotness FROM i WHERE hotness >= 50")
def min_hotness_filter(spark, d):
    return search.filter_items(items(spark, d), min_hotness=50).select("id", "hotness")


@query(f"""WITH {sql.ITEMS} SELECT count(*) AS n_all, count(*) FILTER (WHERE language IS DISTINCT FROM 'en') AS n_vi, count(*) FILTER (WHERE language = 'en') AS n_international,
count(*) FILTER (WHERE regexp_matches(lower(team), '\\b(vff|vpf)\\b')) AS n_official, count(*) FILTER (WHERE contains(lower(team), 'youtube')) AS n_youtube FROM i""")
def source_class_counts(spark, d):
    kinds = ("all", "vi", "international", "official", "youtube")
    return items(spark, d).agg(*[F.count_if(search.source_class(k)).alias(f"n_{k}") for k in kinds])


@query(f"""WITH {sql.ITEMS} SELECT (SELECT count(*) FROM i) AS n_items, (SELECT count(DISTINCT team) FROM i) AS n_sources,
count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) AS n_events FROM events""")
def kpi_counts(spark, d):
    i = articles(spark, d).agg(F.count("*").alias("n_items"), F.countDistinct("source").alias("n_sources"))
    e = read(spark, d, "events").agg(F.count_if(F.col("event_type") == "click").alias("n_click"), F.count_if(F.col("event_type") == "view").alias("n_view"), F.count("*").alias("n_events"))
    return i.crossJoin(e)  # one row each


@query(f"WITH {sql.ITEMS}, s AS (SELECT unnest(sources) AS source, seq FROM i) SELECT source, count(*) AS n, min(seq) AS first_seq FROM s GROUP BY source ORDER BY n DESC, first_seq LIMIT 6")
def top_sources(spark, d):
    s = items(spark, d).select(F.explode("sources").alias("source"), "seq")
    return s.groupBy("source").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(6)


# Dedupe and hashes


_LAST = "row_number() OVER (PARTITION BY {k} ORDER BY seq DESC) AS n, min(seq) OVER (PARTITION BY {k}) AS first_seq"


@query(f"WITH {sql.ARTICLES}, w AS (SELECT *, {_LAST.format(k='url')} FROM a) SELECT url, seq, first_seq, title FROM w WHERE n = 1")
def dedupe_by_url_last_wins(spark, d):
    return dedupe.last_wins(articles(spark, d), "url").select("url", "seq", "first_seq", "title")


_HASHED = f"{sql.ARTICLES}, h AS (SELECT *, {sql.fnv(sql.title('title') + " || '|' || url")} AS hash FROM a)"


@query(f"WITH {_HASHED}, w AS (SELECT *, {_LAST.format(k='hash')} FROM h) SELECT hash, seq, first_seq FROM w WHERE n = 1")
def dedupe_by_hash(spark, d):
    a = articles(spark, d).withColumn("hash", text.content_hash(F.col("title"), F.col("url")))
    return dedupe.last_wins(a, "hash").select("hash", "seq", "first_seq")


@query(f"WITH {_HASHED} SELECT count(*) AS fetched, count(DISTINCT hash) AS inserted, count(*) - count(DISTINCT hash) AS skipped, count(DISTINCT hash) AS classified, 'success' AS status FROM h")
def ingestion_summary(spark, d):
    return dedupe.run_log(articles(spark, d).withColumn("hash", text.content_hash(F.col("title"), F.col("url"))), "hash")


@query(f"WITH {_HASHED} SELECT seq, hash FROM h")
def content_hash(spark, d):
    return articles(spark, d).select("seq", text.content_hash(F.col("title"), F.col("url")).alias("hash"))


@query(f"WITH {sql.ARTICLES} SELECT seq, {sql.title('title')} AS folded, {sql.fold('title')} AS search_folded FROM a")
def normalize_title(spark, d):
    return articles(spark, d).select("seq", text.normalize_title(F.col("title")).alias("folded"), text.normalize_search(F.col("title")).alias("search_folded"))


def _slug_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"""SELECT p_partkey, {_slug_sql("replace(strip_accents(lower(p_name)), 'đ', 'd')")} AS slug, {_slug_sql('strip_accents(lower(p_name))')} AS slug_plain,
{_slug_sql('lower(p_name)')} AS slug_ascii FROM part""")
def slugify(spark, d):
    n = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", text.slugify(n).alias("slug"), text.slugify_plain(n).alias("slug_plain"), text.slugify_ascii(n).alias("slug_ascii"))


@query(f"WITH {sql.ARTICLES} SELECT seq, array_to_string(list_sort({sql.tokens('title')}), ' ') AS tok FROM a")
def title_tokens(spark, d):
    return articles(spark, d).select("seq", F.array_join(F.array_sort(text.tokens(F.col("title"))), " ").alias("tok"))


@query()
def clean_html(spark, d):
    return read(spark, d, "pages").select("page_id", text.clean_text(F.col("html")).alias("text"))


# Pairs, clusters and the feed


_PAIRS = """SELECT x.seq AS a, y.seq AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM e x JOIN e y ON x.w = y.w AND x.seq < y.seq
AND abs(epoch(x.published) - epoch(y.published)) <= {hours} * 3600 GROUP BY ALL"""


@query(f"""WITH {sql.ARTICLES}, t AS (SELECT seq, published, {sql.tokens('title')} AS tok FROM a), e AS (SELECT seq, published, len(tok) AS n, unnest(tok) AS w FROM t),
p AS ({_PAIRS.format(hours=72)}) SELECT a, b, shared FROM p WHERE shared >= 3 AND CAST(shared AS DOUBLE) / greatest(1, least(na, nb)) >= CAST(0.52 AS DOUBLE)""")
def same_story_pairs(spark, d):
    return similarity.same_story(articles(spark, d).withColumn("tok", text.tokens(F.col("title"))))


@query(f"""WITH {sql.ARTICLES}, t AS (SELECT seq, published, list_distinct(list_filter(string_split({sql.title('title')}, ' '), lambda w: length(w) > 2)) AS tok FROM a),
e AS (SELECT seq, published, len(tok) AS n, unnest(tok) AS w FROM t),
p AS ({_PAIRS.format(hours=48)}) SELECT a, b, shared FROM p WHERE CAST(shared AS DOUBLE) / (na + nb - shared) >= CAST(0.55 AS DOUBLE)""")
def duplicate_pairs_jaccard(spark, d):
    return similarity.likely_duplicates(articles(spark, d).withColumn("tok", text.title_words(F.col("title"))))


#: The first article that links to earlier ones lead to; links in a table, walked to their end.
_CLUSTERS = f"""WITH RECURSIVE {sql.ARTICLES}, t AS (SELECT seq, published, {sql.tokens('title')} AS tok FROM a), e AS (SELECT seq, published, len(tok) AS n, unnest(tok) AS w FROM t),
p AS ({_PAIRS.format(hours=72)}), s AS (SELECT a, b FROM p WHERE shared >= 3 AND CAST(shared AS DOUBLE) / greatest(1, least(na, nb)) >= CAST(0.52 AS DOUBLE)),
l AS (SELECT CASE WHEN x.published > y.published OR (x.published = y.published AND x.seq < y.seq) THEN y.seq ELSE x.seq END AS seq,
      CASE WHEN x.published > y.published OR (x.published = y.published AND x.seq < y.seq) THEN x.seq ELSE y.seq END AS before FROM s JOIN t x ON x.seq = s.a JOIN t y ON y.seq = s.b),
r AS (SELECT seq, seq AS head FROM t UNION SELECT r.seq, l.before FROM r JOIN l ON l.seq = r.head),
c AS (SELECT r.seq, arg_max(r.head, (t.published, -r.head)) AS cluster FROM r JOIN t ON t.seq = r.head GROUP BY r.seq)
SELECT c.seq, cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY t.published DESC, c.seq) AS INT) AS pos FROM c JOIN t ON t.seq = c.seq"""


@query(_CLUSTERS)
def story_clusters(spark, d):
    return clustering.story_clusters(articles(spark, d).withColumn("tok", text.tokens(F.col("title"))))


@query()
def news_feed_top60(spark, d):
    return news_feed.feed(articles(spark, d))


# Scores


@query(f"WITH {sql.ITEMS} SELECT seq, hotness FROM i")
def hotness_score(spark, d):
    return items(spark, d).select("seq", "hotness")


@query(f"WITH {sql.ITEMS} SELECT seq, {sql.label('hotness')} AS label FROM i")
def hotness_label(spark, d):
    return items(spark, d).select("seq", scoring.hotness_label(F.col("hotness")).alias("label"))


@query(f"""WITH {sql.ARTICLES} SELECT seq, {sql.reliability('CAST(reliability AS DOUBLE)', sql.d('(1 + seq % 5)'), 'official', sql.speculative('title', 'excerpt'), '(CASE WHEN l.toxic = 1 THEN 10 ELSE 0 END)')} AS reliability
FROM a LEFT JOIN labels l ON l.doc_id = a.seq""")
def reliability_score(spark, d):
    a = articles(spark, d).join(read(spark, d, "labels").select(F.col("doc_id").alias("seq"), "toxic"), "seq", "left")
    penalty = F.when(F.col("toxic") == 1, 10.0).otherwise(0.0)
    n = (1 + F.col("seq") % 5).cast("double")
    return a.select("seq", scoring.reliability(F.col("reliability").cast("double"), n, F.col("official"), scoring.speculative(F.col("title"), F.col("excerpt")), penalty).alias("reliability"))


@query(f"WITH {sql.ITEMS} SELECT seq, {sql.personalization("team IN ('src1', 'src2')", 'hotness', 'reliability', 'age', '90')} AS score FROM i")
def personalization_score(spark, d):
    return items(spark, d).select("seq", scoring.personalization(F.col("team").isin("src1", "src2"), F.col("hotness"), F.col("reliability"), F.col("age"), 90).alias("score"))


# Ranked lists


@query(f"WITH {sql.ITEMS} SELECT seq, hotness + reliability AS score FROM i ORDER BY score DESC, seq LIMIT 60")
def trending_feed(spark, d):
    return items(spark, d).select("seq", (F.col("hotness") + F.col("reliability")).alias("score")).orderBy(F.desc("score"), "seq").limit(60)


@query(f"WITH {sql.ITEMS} SELECT seq, CASE WHEN contains(search_text, 'src3') OR contains(search_text, 'eriner') THEN 120 ELSE 0 END + hotness + reliability AS rank_score FROM i ORDER BY rank_score DESC, seq LIMIT 60")
def for_you_feed(spark, d):
    p = search.personalized(items(spark, d), ["Src3", "Ériner"])
    return p.select("seq", F.col("rank_score").cast("int").alias("rank_score")).orderBy(F.desc("rank_score"), "seq").limit(60)


@query(f"""WITH {sql.ITEMS}, r AS (SELECT *, CASE WHEN contains(search_text, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(search_text, 'thand') THEN 1 ELSE 0 END AS relevance FROM i WHERE id <> 'rss-3')
SELECT id, relevance, hotness, reliability FROM r WHERE relevance > 0 ORDER BY relevance DESC, hotness DESC, reliability DESC, seq LIMIT 5""")
def related_items(spark, d):
    return search.related(items(spark, d), ["The", "Thând", "an"], "rss-3").select("id", "relevance", "hotness", "reliability")


@query(f"WITH {sql.ARTICLES}, w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM a) SELECT source, seq, n FROM w WHERE n <= 16")
def per_feed_first16(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
    return articles(spark, d).select("source", "seq").withColumn("n", n).where("n <= 16")


# Pages, bookmarks, options


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER () AS c FROM orders)
SELECT o_orderkey, o_totalprice, 3 AS page, CAST(ceil(c / 25.0) AS INT) AS total_pages FROM o WHERE n > 50 AND n <= 75""")
def paginate(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return search.paginate(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 25)


@query("""WITH c AS (SELECT CAST(ceil(count(*) / 25.0) AS INT) AS t FROM orders), p AS (SELECT unnest(range(1, t + 1)) AS page, t FROM c),
k AS (SELECT page FROM p WHERE page = 1 OR page = t OR abs(page - 5) <= 1)
SELECT page, coalesce(page - lag(page) OVER (ORDER BY page) > 1, false) AS gap, page = 5 AS active FROM k""")
def page_strip(spark, d):
    return search.page_strip(spark, 5, max(1, -(-read(spark, d, "orders").count() // 25)))


@query("""WITH b AS (SELECT doc_id AS seq FROM documents WHERE lang = 'en'), t AS (SELECT doc_id AS seq FROM documents WHERE source < 'src2')
(SELECT seq FROM b EXCEPT SELECT seq FROM t) UNION ALL (SELECT seq FROM t EXCEPT SELECT seq FROM b)""")
def toggle_bookmark(spark, d):
    docs, seq = read(spark, d, "documents"), F.col("doc_id").alias("seq")
    saved, toggled = docs.where("lang = 'en'").select(seq), docs.where("source < 'src2'").select(seq)
    both = saved.withColumn("side", F.lit(1)).unionAll(toggled.withColumn("side", F.lit(2)))
    return both.groupBy("seq").agg(F.countDistinct("side").alias("n")).where("n = 1").select("seq")  # one shuffle for both differences


@query(f"WITH {sql.ARTICLES} SELECT seq, title FROM a WHERE seq IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def bookmarked_items(spark, d):
    saved = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("seq"))
    return articles(spark, d).join(saved, "seq", "left_semi").select("seq", "title")


@query(f"WITH {sql.ITEMS} SELECT DISTINCT team FROM i WHERE NOT regexp_matches(lower(team), 'thể thao|bóng đá|nhiều đội') ORDER BY team")
def options_list(spark, d):
    return items(spark, d).select("team").distinct().where(~F.col("team").rlike("(?i)thể thao|bóng đá|nhiều đội")).orderBy("team")


_TODAY = f"WITH {sql.ITEMS} SELECT seq, published FROM i WHERE CAST(published + INTERVAL 7 HOURS AS DATE) = DATE '2024-01-20' ORDER BY published DESC, seq LIMIT 5"


@query(_TODAY)
def today_items_local_tz(spark, d):
    local = F.to_date(F.from_utc_timestamp(F.col("published").cast("timestamp"), "Asia/Ho_Chi_Minh"))
    return articles(spark, d).where(local == F.lit("2024-01-20").cast("date")).select("seq", "published").orderBy(F.desc("published"), "seq").limit(5)


@query(f"WITH {sql.ARTICLES} SELECT seq, published FROM a WHERE CAST(published AS DATE) BETWEEN CAST(TIMESTAMP '2024-01-15' AS DATE) - 1 AND CAST(TIMESTAMP '2024-01-15' AS DATE) + 7")
def window_minus1_plus7(spark, d):
    day, now = F.to_date("published"), F.lit("2024-01-15").cast("date")
    return articles(spark, d).where(day.between(F.date_add(now, -1), F.date_add(now, 7))).select("seq", "published")


@query(f"""WITH {sql.ARTICLES}, x AS (SELECT *, lower(title || ' ' || excerpt) AS t FROM a) SELECT seq, CASE WHEN contains(t, 'champions') THEN 'champions-league' ELSE 'premier-league' END AS competition,
CASE WHEN contains(t, 'arsenal') THEN 'Arsenal' || CASE WHEN contains(t, 'liverpool') THEN ',Liverpool' ELSE '' END WHEN contains(t, 'liverpool') THEN 'Liverpool' ELSE '' END AS teams,
CASE WHEN contains(t, 'chuyển nhượng') THEN 'transfer' ELSE 'match-update' END AS topic, CASE WHEN contains(t, 'chấn thương') THEN 'injury' ELSE 'news' END AS article_type, 'vi' AS language FROM x""")
def classify_rules(spark, d):
    t = F.lower(F.concat("title", F.lit(" "), "excerpt"))
    a = articles(spark, d).withColumn("t", t)
    teams = F.filter(F.array(F.lit("Arsenal"), F.lit("Liverpool")), lambda x: F.contains(F.col("t"), F.lower(x)))
    has = lambda w: F.contains(F.col("t"), F.lit(w))
    return a.select(
        "seq", F.when(has("champions"), "champions-league").otherwise("premier-league").alias("competition"), F.array_join(teams, ",").alias("teams"),
        F.when(has("chuyển nhượng"), "transfer").otherwise("match-update").alias("topic"), F.when(has("chấn thương"), "injury").otherwise("news").alias("article_type"), F.lit("vi").alias("language"),
    )


@query(f"WITH {sql.ITEMS} SELECT seq, regexp_matches(search_text, '{search.TRANSFER}') AS transfer FROM i")
def transfer_detection(spark, d):
    return items(spark, d).select("seq", search.is_transfer().alias("transfer"))


