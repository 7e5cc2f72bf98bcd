"""Toxicity by class-conditional Kneser-Ney bigram models.

Two models over words, one of toxic and one of ordinary text, give every word a log-likelihood under each, given the
word before it; a document's score is the difference of the two, divided by its number of words, put through a
logistic curve. The bigram order has raw discounted counts, the order below continuation counts (in how many contexts,
words before it, a word was seen in a class); what is discounted goes to shared rates of both classes. A class's own
counts weigh as much as they are likely to tell of a difference of the classes rather than of chance: the rest backs
off, for a bigram to its last word and for a word to the shared rates, where both models are equal and cancel. So
little evidence counts for little instead of for nothing, and unknown words say nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.shared import materialize

#: Labelled rows of either class that a model is fitted on; those whose hashed doc_id is smallest.
MAX_ROWS = 2000
DISCOUNT = 0.75
#: How often, before anything is counted, the classes are taken to differ in a word, and in a bigram beyond its last word.
WORDS, BIGRAMS = 1e-3, 1e-4
#: Standard deviations of the log ratio of a word's rates where the classes do not differ (topics, languages) and where they do.
ALIKE, APART = 0.5, 3.0
#: Ratios and weights below this stay out of the model; each would move the mean of a text by at most as much.
NEGLIGIBLE = 1e-3
THRESHOLD = 0.7
#: The curve from ratios to scores is fitted to rows that the model behind the ratio has not seen.
FOLDS = 4
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


@dataclass
class Model:
    """ratio: log of toxic over ordinary probability of a word, over that of words that back off. after: the same by
    word and word before it, in place of ratio, where bigrams tell more. slope and middle turn a document's mean into a score."""

    ratio: dict[bytes, float]
    after: dict[bytes, dict[bytes, float]] = field(default_factory=dict)
    slope: float = 1.0
    middle: float = 0.0

    def mean(self, words: list[bytes]) -> float:
        xs = [self.ratio.get(w, 0.0) for w in words]
        for i, w in enumerate(words) if self.after else ():
            if w in self.after:
                xs[i] = self.after[w].get(words[i - 1] if i else b"", xs[i])
        return math.fsum(xs) / len(words) if words else 0.0


def weights(c0: np.ndarray, c1: np.ndarray, t0: int, t1: int, prior: float) -> np.ndarray:
    """How likely the classes differ in what was counted c0 of t0 and c1 of t1 times, if `prior` is taken to differ beforehand."""
    kinds, place = np.unique(np.stack([c0, c1], 1), axis=0, return_inverse=True)
    theta, out = np.linspace(-8, 8, 129), np.empty(len(kinds))
    odds = theta + math.log(t1 / t0)
    alike, apart = (np.exp(-0.5 * (theta / s) ** 2) for s in (ALIKE, APART))
    for a in range(0, len(kinds), 10_000):
        k = kinds[a : a + 10_000]
        fit = -k[:, 1:] * np.logaddexp(0, -odds) - k[:, :1] * np.logaddexp(0, odds)
        fit = np.exp(fit - fit.max(1, keepdims=True))
        yes, no = prior * (fit @ apart) / apart.sum(), (1 - prior) * (fit @ alike) / alike.sum()
        out[a : a + 10_000] = yes / (yes + no)
    return out[place.ravel()]


def word_ratios(c0: np.ndarray, c1: np.ndarray, t0: int, t1: int) -> np.ndarray:
    """Log ratios of words from their continuation counts in both classes, and the classes' totals."""
    shared = np.maximum(c0 + c1, 1) / (t0 + t1)
    p0, p1 = (np.maximum(c - DISCOUNT, 0) / t + DISCOUNT * shared for c, t in ((c0, t0), (c1, t1)))
    return np.where(c0 + c1 > 0, weights(c0, c1, t0, t1, WORDS) * np.log(p1 / p0), 0.0)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, fold, text -> toxic, fold, v, w, n: every different pair of words of a text, the first after an empty one."""
    for b in batches:
        for toxic, fold, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            words = _WORD.findall((text or b"").lower())
            if words:
                g = Counter(zip([b"", *words], words))
                v, w = zip(*g)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([toxic] * len(g), pa.int32()), pa.array([fold] * len(g), pa.int32()), pa.array(v, pa.binary()), pa.array(w, pa.binary()), pa.array(g.values(), pa.int64())],
                    ["toxic", "fold", "v", "w", "n"],
                )


def _models(sample: DataFrame) -> list[Model] | None:
    """Models of sample (toxic, fold, text) without each fold, and of all of it as the last; None without words of both classes."""
    sides = [(k, i) for k in (0, 1) for i in range(FOLDS + 1)]

    def without(c: str, k: int, i: int):
        return sum((F.col(f"{c}{k}{f}") for f in range(FOLDS) if f != i), F.lit(0))

    def kinds(name: str) -> list:
        return [F.sum((without("d", k, i) > 0).cast("long")).alias(f"{name}{k}{i}") for k, i in sides]

    pairs = sample.select("toxic", "fold", F.col("text").cast("binary").alias("text")).mapInArrow(_by_document, "toxic int, fold int, v binary, w binary, n long")
    here = lambda k, f, x: F.sum(F.when((F.col("toxic") == k) & (F.col("fold") == f), x).otherwise(0))
    cells = [(k, f) for k in (0, 1) for f in range(FOLDS)]
    pairs = materialize(pairs.groupBy("v", "w").agg(*(here(k, f, F.lit(1)).alias(f"d{k}{f}") for k, f in cells), *(here(k, f, F.col("n")).alias(f"n{k}{f}") for k, f in cells)))
    words = materialize(pairs.groupBy("w").agg(*kinds("c")))
    totals = pairs.agg(*kinds("t"), *(F.sum(without("d", k, i)).alias(f"s{k}{i}") for k, i in sides)).first().asDict()
    known = [i for i in range(FOLDS + 1) if totals[f"t0{i}"] and totals[f"t1{i}"]]
    if FOLDS not in known:
        return None

    def ratios(c: dict[str, np.ndarray]) -> list[np.ndarray]:
        return [word_ratios(c[f"c0{i}"], c[f"c1{i}"], totals[f"t0{i}"], totals[f"t1{i}"]) for i in known]

    def of_pairs(d: dict[str, np.ndarray]) -> list[np.ndarray]:
        return [weights(d[f"s0{i}"], d[f"s1{i}"], totals[f"s0{i}"], totals[f"s1{i}"], BIGRAMS) for i in known]

    def telling(values):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.stack(values({c: b.column(j).to_numpy() for j, c in enumerate(b.schema.names) if c not in "vw"}), 1)
                    keep = np.abs(x).max(1) >= NEGLIGIBLE
                    x = pa.array(list(x[keep]), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).filter(pa.array(keep)) for c in b.schema.names if c in "vw"), x], [*(c for c in b.schema.names if c in "vw"), "x"])

        return run

    models = [Model({}) for _ in range(FOLDS + 1)]
    for r in words.mapInArrow(telling(ratios), "w binary, x array<double>").toLocalIterator():
        for i, x in zip(known, r["x"]):
            if abs(x) >= NEGLIGIBLE:
                models[i].ratio[bytes(r["w"])] = x
    seen = pairs.select("v", "w", *(without("d", k, i).alias(f"s{k}{i}") for k, i in sides)).mapInArrow(telling(of_pairs), "v binary, w binary, x array<double>")
    seen = materialize(seen.join(pairs.select("v", "w", *(without("n", k, i).alias(f"n{k}{i}") for k, i in sides)), ["v", "w"]))
    contexts = pairs.groupBy("v").agg(*(F.sum(without("n", k, i)).alias(f"a{k}{i}") for k, i in sides), *kinds("k"))
    for r in seen.join(contexts, "v").join(words, "w").toLocalIterator():
        v, w = bytes(r["v"]), bytes(r["w"])
        for i, x in zip(known, r["x"]):
            if x < NEGLIGIBLE or not r[f"n0{i}"] + r[f"n1{i}"]:
                continue
            alone, q = models[i].ratio.get(w, 0.0), []
            shared = (r[f"c0{i}"] + r[f"c1{i}"]) / (totals[f"t0{i}"] + totals[f"t1{i}"])
            for k in (0, 1):
                lower, n = shared * math.exp((k - 0.5) * alone), r[f"a{k}{i}"]
                q.append((max(r[f"n{k}{i}"] - DISCOUNT, 0.0) + DISCOUNT * r[f"k{k}{i}"] * lower) / n if n else lower)
            models[i].after.setdefault(w, {})[v] = x * math.log(q[1] / q[0]) + (1 - x) * alone
    return models


def _mean_ratio(spark, models: list[Model]):
    """(text, number of a model) -> mean log ratio over the words of the whole text; without words 0. Only these two columns go to Python."""
    shared = spark.sparkContext.broadcast(models)  # bounded: they come from at most 2 * MAX_ROWS rows

    def run(texts: pa.Array, which: pa.Array) -> pa.Array:
        models, out = shared.value, []
        for a in range(0, len(texts), 256):
            for t, k in zip(texts.slice(a, 256).to_pylist(), which.slice(a, 256).to_pylist()):
                out.append(models[k].mean(_WORD.findall((t or b"").lower())))
        return pa.array(out, pa.float64())

    udf = F.arrow_udf(run, "double")
    return lambda text, which: udf(text.cast("binary"), which)


def _curve(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[float, float]:
    """Slope and middle of a logistic curve that reaches the threshold at the cut with the best balanced accuracy."""
    if len(x) == 0 or y.min() == y.max():
        return 1.0, 0.0
    values = np.unique(x)
    cuts = np.append((values[1:] + values[:-1]) / 2, values[-1] + 1e-6)
    caught = np.array([[(x[y == k] > c).mean() for c in cuts] for k in (0, 1)])
    cut = float(cuts[(caught[1] - caught[0]).argmax()])
    slope = 4.0 / max(float(np.median(x[(y == 1) & (x > cut)])) - cut, 1e-6) if (x[y == 1] > cut).any() else 1.0
    return slope, cut - math.log(threshold / (1 - threshold)) / slope


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Model from labels (doc_id, toxic) and docs (doc_id, text).

    Rows whose label is neither 0 nor 1 are left out. Of either class the max_rows doc_ids
    with the smallest hashes are used, so the model and its broadcast are bounded however
    large the tables are. Without rows of both classes every text scores 0.5.
    """
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = marked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_rows).drop("n")
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # at most 2 * max_rows rows
    models = _models(sample)
    if models is None:
        return Model({})
    xy = sample.select("toxic", _mean_ratio(sample.sparkSession, models[:FOLDS])(F.col("text"), F.col("fold")).alias("x")).toPandas()
    fitted = models[FOLDS]
    fitted.slope, fitted.middle = _curve(xy.x.to_numpy(), xy.toxic.to_numpy(), THRESHOLD)
    return fitted


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs and the score of each row's text: whole texts; null and empty texts score as a mean of 0."""
    x = F.lit(model.slope) * (_mean_ratio(docs.sparkSession, [model])(F.col("text"), F.lit(0)) - F.lit(model.middle))
    return docs.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def held_out(doc_id):
    """crc32 of the id as text leaves 1 over 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted: one row for each row of docs.

    Labels of held-out ids are not looked at. Repeated rows score alike; an empty table gives an empty result.
    """
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), max_rows)
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, in their columns, without those that score threshold or more."""
    name = "score" + "_" * max(map(len, docs.columns))
    return scored(docs, model, name).where(F.col(name) < threshold).drop(name)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
