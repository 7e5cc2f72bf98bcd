"""Queries over stored tables, streams and sources that are read one by one, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import asked, incremental, pages, runs, similarity, stored, text_index
from newsloom.operators.shared import materialize, new_path
from newsloom.plans import news, sports, sql
from newsloom.sources import landed
from newsloom.sources.articles import articles, read
from newsloom.streaming import latest, stories

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _slices(df, column: str, n: int):
    """df cut at quantiles of a column (two numbers a cut), the smallest first; rows without it are in none."""
    seconds = F.unix_seconds(F.col(column).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(seconds, [i / n for i in range(1, n)]).alias("c")).first()["c"] or []
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        yield df.where((F.lit(True) if low is None else seconds > low) & (F.lit(True) if high is None else seconds <= high) & seconds.isNotNull())


def _replayed(spark, df, rule, hours: int, kind: str):
    """Three slices of articles by time land one after the other; the stream of pairs starts again for each."""
    df = materialize(df.select("seq", F.col("published").cast("timestamp").alias("published"), "tok"))
    inbox, path, checkpoint = (new_path(spark, f"{kind}-{x}") for x in ("in", "stored", "state"))
    for some in _slices(df, "published", 3):
        some.write.mode("append").parquet(inbox)
        stories.store_pairs(spark.readStream.schema(df.schema).parquet(inbox), path, checkpoint, rule, hours)
    return stories.stored_pairs(spark, path)


@query(news.ORACLES["same_story_pairs"])
def stream_story_pairs(spark, d):
    return _replayed(spark, articles(spark, d).withColumn("tok", text.tokens(F.col("title"))), similarity.same_story, 72, "story")


@query(news.ORACLES["duplicate_pairs_jaccard"])
def stream_duplicate_pairs(spark, d):
    return _replayed(spark, articles(spark, d).withColumn("tok", text.title_words(F.col("title"))), similarity.likely_duplicates, 48, "duplicate")


@query(news.ORACLES["story_clusters"])
def story_clusters_by_slices(spark, d):
    """Five slices by time, the second newest first: each but that has articles that are newer than some that are stored."""
    a, path = materialize(articles(spark, d).select("seq", "published", text.tokens(F.col("title")).alias("tok"))), new_path(spark, "stories")
    slices = list(_slices(a, "published", 5))
    for i in (3, 4, 1, 0, 2):
        incremental.load(spark, path, slices[i])
    return incremental.clusters(spark, path)


@query(sports.ORACLES["upsert_do_update"])
def stored_upsert(spark, d):
    """Two batches, the second one twice: the table is the same after that."""
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = new_path(spark, "customers")
    stored.merge(spark, path, c.where("c_mktsegment <> 'BUILDING'"), "c_custkey")
    loaded = c.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").withColumn("c_name", F.lit("new"))
    for _ in range(2):
        stored.merge(spark, path, loaded, "c_custkey", ["c_name"])
    return stored.table(spark, path)


@query(news.ORACLES["toggle_bookmark"])
def stored_bookmarks(spark, d):
    docs, seq, path = read(spark, d, "documents"), F.col("doc_id").alias("seq"), new_path(spark, "bookmarks")
    stored.toggle(spark, path, docs.where("lang = 'en'").select(seq), "seq")
    stored.toggle(spark, path, docs.where("source < 'src2'").select(seq), "seq")
    return stored.table(spark, path, "seq long")


@query(news.ORACLES["ingestion_summary"])
def logged_ingestion(spark, d):
    """The run log of an ingestion that is counted while it is written."""
    a = articles(spark, d).withColumn("hash", text.content_hash(F.col("title"), F.col("url")))
    return runs.ingest(a, "hash", new_path(spark, "ingested"), "documents").select("fetched", "inserted", "skipped", "classified", "status")


@query("SELECT page_id, url, length(html) AS n FROM pages")
def sources_one_failing(spark, d):
    """Pages landed as JSON files, each a source, beside one source that cannot be read."""
    rows, path = read(spark, d, "pages"), new_path(spark, "pages")
    rows.write.option("maxRecordsPerFile", 2000).json(path)
    good, _ = landed.read_sources(spark, [("missing", f"{path}/no-such-file"), *landed.files_under(spark, path)])
    return landed.json_rows(good, "page_id long, url string, html string").select("page_id", "url", F.length("html").cast("long").alias("n"))


@query(news.ORACLES["paginate"])
def stored_page(spark, d):
    order, path = [F.desc("o_totalprice"), F.col("o_orderkey")], new_path(spark, "pages")
    pages.store(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), path, order)
    return pages.page(spark, path, order, 3, 25)


def _texts(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), text.normalize_search(F.col("text")).alias("text"))


@query(f"""WITH t AS (SELECT DISTINCT split_part(x, ' ', 1) || ' ' || split_part(x, ' ', 2) AS term FROM (SELECT {sql.fold('text')} AS x FROM benchmark) UNION SELECT left(lower(n_name), 2) FROM nation),
x AS (SELECT doc_id AS id, {sql.fold('text')} AS text FROM documents) SELECT term, id FROM t JOIN x ON contains(x.text, t.term) WHERE term <> ''""")
def indexed_search(spark, d):
    """The first two words of every benchmark item, and two letters of every nation, in whole documents."""
    folded = F.split(text.normalize_search(F.col("text")), " ")
    words = read(spark, d, "benchmark").select(F.concat_ws(" ", F.get(folded, F.lit(0)), F.coalesce(F.get(folded, F.lit(1)), F.lit(""))).alias("term"))
    terms = words.unionAll(read(spark, d, "nation").select(F.left(F.lower("n_name"), F.lit(2)).alias("term"))).where("term <> ''")
    texts, path = materialize(_texts(spark, d)), new_path(spark, "index")  # folded once, for the index and for a last look
    text_index.build(texts, path)
    return text_index.holding(texts, path, terms)


@query(f"""WITH w AS (SELECT c_mktsegment AS who, left(lower(n_name), 3) AS term, count(*) AS times FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
x AS (SELECT doc_id AS id, {sql.fold('text')} AS text FROM documents) SELECT who, id, CAST(sum(times) AS BIGINT) AS relevance FROM w JOIN x ON contains(x.text, w.term) GROUP BY who, id""")
def followed_relevance(spark, d):
    """Segments follow the nations of their customers, by three letters, as often as they have customers there."""
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.left(F.lower("n_name"), F.lit(3)).alias("term"))
    wishes = read(spark, d, "customer").join(nations, "c_nationkey").select(F.col("c_mktsegment").alias("who"), "term")
    texts, path = _texts(spark, d), new_path(spark, "index")
    text_index.build(texts, path)
    return text_index.relevance(texts, path, wishes, 3)


def echo(some: list[dict]) -> list[dict]:
    """Stands for a model: says what it is asked, and refuses every title with an x. What it says of titles of over 100 characters breaks the schema of answers."""
    return [{"id": a["id"], "title": "VI " + a["title"], "summary": a["excerpt"][:40], "key_points": [a["title"][:10]], "topic": "echo", "importance": len(a["title"])} for a in some if "x" not in a["title"]]


@query(f"""WITH {sql.ARTICLES} SELECT seq, CASE WHEN ok THEN 'VI ' || title ELSE title END AS title, ok AS translated, CASE WHEN ok THEN 'echo' END AS topic, CASE WHEN ok THEN CAST(length(title) AS INT) END AS importance
FROM (SELECT *, language = 'en' AND NOT contains(title, 'x') AND length(title) BETWEEN 1 AND 100 AND length(left(excerpt, 40)) > 0 AS ok FROM a)""")
def enriched_articles(spark, d):
    """All English articles are put to a model that echoes; the second run finds every answer stored."""
    a, path = articles(spark, d), new_path(spark, "answers")
    english = a.where("language = 'en'")
    asked.enriched(a, english, path, echo)
    return asked.enriched(a, english, path, echo).select("seq", "title", "translated", "topic", "importance")


@query(news.ORACLES["dedupe_by_url_last_wins"])
def stream_last_wins(spark, d):
    """Articles in three slices by a hash of their text, one after the other; a table keeps the last of each url."""
    a = materialize(articles(spark, d).select("url", "seq", "title"))
    inbox, path, checkpoint = (new_path(spark, f"latest-{x}") for x in ("in", "table", "state"))
    for i in range(3):
        a.where(F.pmod(F.xxhash64("title"), F.lit(3)) == i).write.mode("append").parquet(inbox)
        latest.store_latest(spark.readStream.schema(a.schema).parquet(inbox), path, "url", checkpoint)
    return stored.table(spark, path, "url string, seq long, title string, first_seq long").select("url", "seq", "first_seq", "title")
