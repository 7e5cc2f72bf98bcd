"""Stupid-backoff language-model scores, computed relationally.

Documents are put into batches of bounded size. A batch's different n-grams (words and pairs of words, as 64-bit hashes)
are a table of a row each with their number, partitioned by hash; summed over batches they are the count table of the
whole corpus, which is joined back to the n-grams of the batches. There the scores of the words of each document are
looked up and summed. A word that stands in every document is a row for each batch, not for each document.

A document is scored by the counts of all others: its own are taken off, so that a text cannot vouch for itself.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.substrings import _M, _mix, _per_document
from newsloom.operators.shared import materialize

BACKOFF = 0.4
#: Bytes of text that a batch is closed at; a longer text is a batch of its own. A task holds one batch.
BATCH_BYTES = 4 << 20
#: N-grams are counted, and batches scored, in so many parts, one after the other; the shuffle files of one are gone before the next begins.
PARTS = 2
#: Stands among the hashes for the number of all words.
ALL_WORDS = np.uint64(0)


def grams(h: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the runs of `order` words, of which h has the hashes. None is 0."""
    g = h.copy()
    for i in range(1, order):
        g = _mix((g[:-1] ^ np.uint64(i)) * _M + h[i:])
    return np.maximum(g, np.uint64(1))


def _batched(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """docs (doc_id, text) -> batch, doc_id, text: neighbouring rows, until a batch has so many bytes. Written once, for both uses must agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batch, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            which = np.empty(b.num_rows, np.int64)
            for i, size in enumerate(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
                if held and held + size > batch_bytes:
                    batch, held = batch + 1, 0
                held += size
                which[i] = batch
            yield pa.RecordBatch.from_arrays([pa.array(which), *b.columns], ["batch", "doc_id", "text"])

    kind = dict(docs.dtypes)["doc_id"]
    bare = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return materialize(bare.mapInArrow(run, f"batch long, doc_id {kind}, text binary"))


def _positions(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, text after text, and the number of the text of each."""
    words = list(_per_document(texts))
    return np.concatenate([np.empty(0, np.uint64), *words]), np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])


def _all_grams(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The batch's n-grams, all words and then all pairs of words of one text, and the place of each one's last word."""
    second = (np.flatnonzero(doc[1:] == doc[:-1]) + 1).astype(np.int32)
    return np.concatenate([grams(h, 1), grams(h, 2)[second - 1]]), np.concatenate([np.arange(len(h), dtype=np.int32), second])


def _exploded(batched: DataFrame, part: int) -> DataFrame:
    """batch, gram, n: the different n-grams, of one part, of each batch and how often they stand in it; ALL_WORDS counts its words."""

    def rows(batch: int, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        h, doc = _positions(texts)
        g = _all_grams(h, doc)[0]
        g, n = np.unique(g[g % np.uint64(PARTS) == part], return_counts=True)
        if ALL_WORDS % PARTS == part:
            g, n = np.append(g, ALL_WORDS), np.append(n, len(h))
        for a in range(0, len(g), 1 << 16):
            some = g[a : a + (1 << 16)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), batch)), pa.array(some), pa.array(n[a : a + len(some)])], ["batch", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            of = b.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            for a, z in zip(edges, [*edges[1:], len(of)]):
                if held and of[a] != now:
                    yield from rows(now, held)
                    held = []
                now = int(of[a])
                held += b.column(1).slice(a, z - a).to_pylist()
        if held:
            yield from rows(now, held)

    return batched.select("batch", "text").mapInArrow(run, "batch long, gram long, n long")


def counts_elsewhere(batched: DataFrame) -> DataFrame:
    """batch, gram, total: corpus counts of the batch's n-grams that other batches have too; what a batch lacks here is its own alone."""
    def part(i: int) -> DataFrame:  # the same columns and filters on either side of the join: so the exchange is the same, and made once
        mine = _exploded(batched, i).where("gram IS NOT NULL AND n IS NOT NULL").repartition("gram")
        table = mine.groupBy("gram").agg(F.sum("n").alias("total"), F.count("batch").alias("rows")).where("rows > 1")
        return materialize(mine.join(table.drop("rows"), "gram").where("total > n").select("batch", "gram", "total"))

    return functools.reduce(DataFrame.unionAll, [part(i) for i in range(PARTS)])


def log_scores(texts: list[bytes | None], known: np.ndarray, totals: np.ndarray, backoff: float = BACKOFF) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text of a batch, and the sum over them of log S(word | word before).

    known and totals are what counts_elsewhere has of the batch. The document's own counts are taken off. S is
    c(v w) / c(v) where that pair is known, else backoff * c(w) / total; a word that is unknown too counts as if it had
    been seen once. The first word has no word before it: c(w) / total.
    """
    h, doc = _positions(texts)
    words = np.bincount(doc, minlength=len(texts))
    if not len(h):
        return words, np.zeros(len(texts))
    g, last = _all_grams(h, doc)
    order = np.argsort(g, kind="stable")  # equal n-grams stay in order of their texts
    g, of = g[order], doc[last][order]
    differs = np.append(True, g[1:] != g[:-1])
    starts = np.flatnonzero(differs)
    count = np.diff(np.append(starts, len(g)))
    own = np.diff(np.append(np.flatnonzero(differs | np.append(True, of[1:] != of[:-1])), len(g)))  # in the document itself
    by_hash = np.argsort(known)
    known, totals = known[by_hash], totals[by_hash]
    whole = int(totals[0]) if len(known) and known[0] == ALL_WORDS else len(h)
    known, totals = known[known != ALL_WORDS], totals[known != ALL_WORDS]
    count[np.searchsorted(g[starts], known)] = totals
    others = np.empty(len(g))
    others[order] = np.repeat(count, np.diff(np.append(starts, len(g)))) - np.repeat(own, own)
    del g, of, order, differs
    c, both = np.maximum(others[: len(h)], 1), others[len(h) :]
    s = np.log(c / np.maximum(whole - words, 1)[doc])
    at = last[len(h) :]
    with np.errstate(divide="ignore"):
        s[at] = np.where(both > 0, np.log(both) - np.log(c[at - 1]), math.log(backoff) + s[at])
    return words, np.bincount(doc, s, minlength=len(texts))


def lm_scores(docs: DataFrame, backoff: float = BACKOFF, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, log_score, mean_log_score: bigram stupid backoff over blank-separated words.

    Every row is a document of its own, so rows that repeat count like copies. Null and empty texts have no words,
    log_score 0 and mean null; other columns are left out; an empty table gives an empty result.
    """
    batched = _batched(docs, batch_bytes)
    counts = counts_elsewhere(batched)
    kind = dict(docs.dtypes)["doc_id"]

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        n, s = log_scores(texts["text"].to_pylist(), known["gram"].to_numpy().view(np.uint64), known["total"].to_numpy(), backoff)
        mean = pa.array(s / np.maximum(n, 1), pa.float64(), mask=n == 0)
        return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(n, pa.int64()), "log_score": pa.array(s, pa.float64()), "mean_log_score": mean})

    def part(i: int) -> DataFrame:
        texts, known = (x.where(F.pmod(F.xxhash64("batch"), F.lit(PARTS)) == i).groupBy("batch") for x in (batched, counts))
        return materialize(texts.cogroup(known).applyInArrow(score, f"doc_id {kind}, n_words long, log_score double, mean_log_score double"))

    return functools.reduce(DataFrame.unionAll, [part(i) for i in range(PARTS)])


def op6_lm_scores(spark, sf_dir: str) -> DataFrame:
    s = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return s.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT k, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT k, i, w, lag(w) OVER (PARTITION BY k ORDER BY i) AS v FROM e),
all_words AS (SELECT count(*) AS t FROM e),
c1 AS (SELECT w, count(*) AS c FROM e GROUP BY w), o1 AS (SELECT k, w, count(*) AS c FROM e GROUP BY k, w),
c2 AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w), o2 AS (SELECT k, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY k, v, w),
x AS (
  SELECT p.k, p.i, CAST(greatest(cw.c - ow.c, 1) AS DOUBLE) AS cw, CAST(greatest(cv.c - ov.c, 1) AS DOUBLE) AS cv, coalesce(cvw.c - ovw.c, 0) AS cvw,
         CAST(greatest((SELECT t FROM all_words) - len(d.w), 1) AS DOUBLE) AS total
  FROM p JOIN d USING (k) JOIN c1 cw ON cw.w = p.w JOIN o1 ow ON ow.k = p.k AND ow.w = p.w
  LEFT JOIN c1 cv ON cv.w = p.v LEFT JOIN o1 ov ON ov.k = p.k AND ov.w = p.v
  LEFT JOIN c2 cvw ON cvw.v = p.v AND cvw.w = p.w LEFT JOIN o2 ovw ON ovw.k = p.k AND ovw.v = p.v AND ovw.w = p.w),
s AS (
  SELECT k, sum(CASE WHEN i = 1 THEN ln(cw / total) WHEN cvw > 0 THEN ln(CAST(cvw AS DOUBLE)) - ln(cv)
                     ELSE ln(CAST(0.4 AS DOUBLE)) + ln(cw / total) END) AS s FROM x GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(s.s, CAST(0 AS DOUBLE)), 3) AS log_score, round(s.s / len(d.w), 6) AS mean_log_score
FROM d LEFT JOIN s USING (k)
"""
