"""Benchmark decontamination in DataFrame operations only.

The benchmark's word windows are a hash table. While its size in bytes has a proven bound it is broadcast, every window
of every document is looked up in one scan of the texts, and hits are verified word by word. A larger benchmark is joined
by shuffle: windows go as hashes alone, and the words of documents are fetched again for those that were hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.words import PLAIN_SEPARATOR, plain_words
from newsloom.operators.shared import materialize

WINDOW = 10
#: Bytes of windows, their words and the items they stand in, that are still broadcast.
BROADCAST_BYTES = 64 << 20


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, text) -> n, words, items, hash: one row for each different window; items without words have none."""
    w = bench.select("item_id", plain_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(window)))
    each = w.select("item_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("words"))
    return each.groupBy("n", "words").agg(F.collect_set("item_id").alias("items")).withColumn("hash", F.xxhash64("words"))


def _places(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """docs (doc_id, text) -> doc_id, key, w, start, n, hash: every window of each of the lengths, and for each row of docs one of start 0.

    start counts words from 1; key is a hash of doc_id and text, so that rows which share a doc_id but not their text
    stay apart. w, all words, is there for whoever needs it before rows move.
    """
    d = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), plain_words(F.col("text")).alias("w"))
    kinds = F.lit(len(lengths))
    place = d.select("doc_id", "key", "w", F.explode(F.sequence(F.lit(-1), F.size("w") * kinds - 1)).alias("at"))
    n = F.element_at(F.array(*[F.lit(x) for x in lengths]), (F.pmod("at", kinds) + 1).cast("int")) if lengths else F.lit(0)
    start = F.when(F.col("at") < 0, 0).otherwise(F.floor(F.col("at") / kinds).cast("int") + 1) if lengths else F.lit(0)
    place = place.select("doc_id", "key", "w", start.alias("start"), n.alias("n"))
    fits = (F.col("start") > 0) & (F.col("start") + F.col("n") - 1 <= F.size("w"))
    return place.where((F.col("start") == 0) | fits).withColumn("hash", F.when(fits, F.xxhash64(F.slice("w", F.greatest("start", F.lit(1)), F.col("n")))))


def find_hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs (doc_id, text), bench (item_id, text) -> doc_id, key, n_words, start, n, items: the verified windows, and rows of start 0 as in _places."""
    wins = materialize(benchmark_windows(bench, window))
    size = F.sum(F.lit(64) + F.octet_length(F.array_join("words", " ")) + 16 * F.size("words") + 16 * F.size("items"))
    lengths, held = wins.agg(F.sort_array(F.collect_set("n")), F.coalesce(size, F.lit(0))).first()  # at most `window` lengths
    table = wins.select(F.col("hash").alias("b_hash"), F.col("words").alias("b_words"), "items")
    places = _places(docs, lengths)
    if held <= broadcast_bytes:
        met = places.join(F.broadcast(table), F.col("hash") == F.col("b_hash"), "left")
        true = (F.col("start") == 0) | (F.slice("w", F.greatest("start", F.lit(1)), F.col("n")) == F.col("b_words"))
        return met.where(true).select("doc_id", "key", F.size("w").alias("n_words"), "start", "n", "items")
    seen = places.where("start > 0").select("doc_id", "key", "start", "n", "hash").join(table.select(F.col("b_hash").alias("hash")).distinct(), "hash")
    texts = docs.select(F.col("doc_id").alias("t_doc"), F.xxhash64("doc_id", "text").alias("t_key"), "text").distinct()
    words = seen.join(texts, (F.col("key") == F.col("t_key")) & F.col("doc_id").eqNullSafe(F.col("t_doc")))
    words = words.select("doc_id", "key", "start", "n", "hash", F.slice(plain_words(F.col("text")), F.col("start"), F.col("n")).alias("words"))
    hit = words.join(table, (F.col("hash") == F.col("b_hash")) & (F.col("words") == F.col("b_words")))
    hit = hit.select("doc_id", "key", F.lit(0).alias("n_words"), "start", "n", "items")
    return hit.unionAll(places.where("start = 0").select("doc_id", "key", F.size("w").alias("n_words"), "start", "n", F.lit(None).cast(dict(table.dtypes)["items"]).alias("items")))


def contamination(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """One row for each row of docs: doc_id, key, n_words, n_hit, items (as sorted strings), hit_words (1-based places).

    Null or empty text has no words and no hits. Items without words match nothing; an empty
    benchmark gives zero hits. Rows with equal doc_id and text get equal results.
    """
    hit = F.col("start") > 0
    spans = F.transform(F.collect_set(F.when(hit, F.struct("start", "n"))), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))
    found = find_hits(docs, bench, **how).groupBy("doc_id", "key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if(~hit).alias("rows"), F.array_sort(F.array_distinct(F.flatten(spans))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items").cast("array<string>")))))).alias("items"),
    )
    each = found.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "key", "n_words", F.size("hit_words").cast("long").alias("n_hit"), "items", "hit_words")


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", **how) -> DataFrame:
    """docs without what occurs in the benchmark, in the same columns.

    remove="documents" drops documents with a hit; remove="spans" keeps them and cuts the hit
    words, with what separates them from the next word, out of their text.
    """
    hits = contamination(docs, bench, **how).where("n_hit > 0").select(F.col("doc_id").alias("h_doc"), F.col("key").alias("h_key"), F.col("hit_words").alias("h_words")).distinct().alias("h")
    mine = [F.col(f"d.`{c}`") for c in docs.columns]
    same = (F.xxhash64("d.doc_id", "d.text") == F.col("h.h_key")) & F.col("d.doc_id").eqNullSafe(F.col("h.h_doc"))
    if remove == "documents":
        return docs.alias("d").join(hits, same, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    word = PLAIN_SEPARATOR.replace("[", "[^", 1)
    pieces = F.regexp_extract_all("d.text", F.lit(f"({word})({PLAIN_SEPARATOR})?"), F.lit(0))
    places = F.array_except(F.sequence(F.lit(1), F.size(pieces)), F.col("h.h_words"))
    cut = F.concat(F.regexp_extract("d.text", f"^({PLAIN_SEPARATOR})?", 0), F.array_join(F.transform(places, lambda i: F.element_at(pieces, i)), ""))
    text = F.when(F.col("h.h_key").isNull(), F.col("d.text")).otherwise(cut)
    return docs.alias("d").join(hits, same, "left").select(*[text.alias("text") if c == "text" else x for c, x in zip(docs.columns, mine)])


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    c = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return c.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM bi),
ns AS (SELECT DISTINCT n FROM bn),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM di),
hit AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(nh.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.xs, '')) AS items_sha256,
       coalesce(nh.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
