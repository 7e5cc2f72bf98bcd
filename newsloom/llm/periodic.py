"""Periodic runs of words, by Karp-Miller-Rosenberg naming.

A name of level k stands for the 2^k words from a place on: level 0 names words, and a pair of names of level k - 1, 2^(k-1)
words apart, gets a name of level k, by sorting the pairs. Names are told apart by text, so a pair that occurs once in its
text needs no sorting. Two places agree for as long as their names do, taken from the highest level down. A run of period p
and 4p words covers three places of the grid of multiples of p, so for every period only neighbours on its grid are
compared; those that agree are extended both ways. No hashes, no suffix sorting.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.words import BLANK_WORD

MIN_WORDS, MIN_PERIODS = 6, 4
#: Words whose names are made at once: a task holds them, or one longer text.
GROUP_WORDS = 1 << 18
#: Texts taken from an Arrow batch at once.
_TEXTS = 512


class Names:
    """names[k][i] stands for the 2^k words from i on: equal exactly if those are. Texts stand one after the other, a separator
    after each, the longest first; level k covers the texts that have `least` times 2^k words."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, sizes: np.ndarray, least: int):
        """words: level 0, different for every text and for every separator; ends: places after each text and its separator."""
        self.names = [words]
        while True:
            half = 1 << (len(self.names) - 1)
            far = int(np.searchsorted(-sizes, -least * 2 * half, "right"))  # texts that are long enough
            if not far:
                return
            below = self.names[-1]
            places = min(int(ends[far - 1]), len(below) - half)
            left, right = below[:places], below[half : half + places]
            often = np.bincount(below) > 1
            both = np.flatnonzero(often[left] & often[right])
            out = np.empty(places, np.int64)
            _, some = np.unique(left[both].astype(np.int64) * (int(below.max()) + 1) + right[both], return_inverse=True)
            alone = np.ones(places, bool)
            alone[both] = False
            first = int(some.max()) + 1 if len(some) else 0
            out[both], out[alone] = some, first + np.arange(places - len(both))
            self.names.append(out)

    def equal(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the 2^k words from a and from b on are equal; False where a level has no name."""
        names = self.names[k]
        fine = (a >= 0) & (b >= 0) & (a < len(names)) & (b < len(names))
        return fine & (names[np.where(fine, a, 0)] == names[np.where(fine, b, 0)])

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on agree."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            while (same := self.equal(k, a + n, b + n)).any():
                n += same.astype(np.int64) << k
        return n

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words that end before a and before b agree."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            while (same := self.equal(k, a - n - (1 << k), b - n - (1 << k))).any():
                n += same.astype(np.int64) << k
        return n


def find_runs(texts: list[list[bytes]], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[np.ndarray]:
    """For each list of words its runs (start, length, smallest period), by start, then period."""
    none = np.empty((0, 3), np.int64)
    out = [none] * len(texts)
    some = sorted((i for i, w in enumerate(texts) if len(w) >= min_words), key=lambda i: -len(texts[i]))
    if not some:
        return out
    sizes = np.array([len(texts[i]) for i in some])
    ends = np.cumsum(sizes + 1)
    words, base = np.empty(int(ends[-1]), np.int64), 0
    for i, end in zip(some, ends.tolist()):
        number = dict.fromkeys(texts[i])
        number.update(zip(number, count(base)))
        words[end - 1 - len(texts[i]) : end - 1] = np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i]))
        words[end - 1] = base + len(number)
        base += len(number) + 1
    names = Names(words, ends, sizes, min_periods)
    at, period = [], []
    for p in range(1, int(sizes[0]) // min_periods + 1):
        k = p.bit_length() - 1
        level, rest = names.names[k], p - (1 << k)
        grid = level[: int(ends[np.searchsorted(-sizes, -min_periods * p, "right") - 1]) : p]
        hit = grid[:-1] == grid[1:]
        if hit.any():
            at.append(np.flatnonzero(hit) * p)
            if rest:  # the words of a period that its first name leaves out
                at[-1] = at[-1][names.equal(k, at[-1] + rest, at[-1] + rest + p)]
            if len(at[-1]):  # of neighbours on the grid the first stands for all: they lie in one stretch
                at[-1] = at[-1][np.diff(at[-1], prepend=-2 * p) != p]
            period.append(np.full(len(at[-1]), p))
    if not at:
        return out
    at, period = np.concatenate(at), np.concatenate(period)
    start = at - names.before(at, at + period)
    length = at + period + names.after(at, at + period) - start
    long = length >= np.maximum(min_words, min_periods * period)
    found = np.stack([start, length, period], 1)[long]
    # A stretch with the period of a shorter one also has its multiples: the smallest stands first and is kept.
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    found = found[np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(1)))] if len(found) else found
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    text = np.searchsorted(ends, found[:, 0], "right")
    cuts = np.searchsorted(text, np.arange(len(some) + 1))
    for j, i in enumerate(some):
        if cuts[j] < cuts[j + 1]:
            out[i] = found[cuts[j] : cuts[j + 1]] - [ends[j] - 1 - sizes[j], 0, 0]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not len(runs):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def _grouped(texts: Iterator[bytes | None], group_words: int) -> Iterator[list[list[bytes]]]:
    """Words of neighbouring texts, until they are so many."""
    some, held = [], 0
    for t in texts:
        words = (t or b"").split()  # bytes: splits at ASCII blanks only
        if some and held + len(words) > group_words:
            yield some
            some, held = [], 0
        some.append(words)
        held += len(words)
    if some:
        yield some


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, group_words: int = GROUP_WORDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, runs (start, length, period; by start, then period), collapsed: one row for each row of docs.

    Words are what ASCII blanks part. A run is a stretch of words in which words `period` apart are equal, for no smaller
    period, of min_words words and min_periods periods or more, that no neighbouring word extends. collapsed is the text,
    its words joined by one space, without the words that any run holds after its first period. Null and empty texts have no
    runs and collapse to "". Rows stand for themselves, so repeated ids and rows and null ids go through; further columns
    are left out. An empty table gives an empty result. A task holds group_words words, or one text, if that is longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, kept = [], []
            texts = (t for a in range(0, b.num_rows, _TEXTS) for t in b.column(1).slice(a, _TEXTS).to_pylist())
            for some in _grouped(texts, group_words):
                runs = find_runs(some, min_words, min_periods)
                found += runs
                kept += [b" ".join(collapse(w, r)) for w, r in zip(some, runs)]
            flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            each = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            edges = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(edges), each)
            yield pa.RecordBatch.from_arrays([b.column(0), runs, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    kind = "array<struct<start: long, length: long, period: long>>"
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, runs {kind}, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """Every tenth text, by the CRC-32 of its id, with its end replaced by repetitions of the words before."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({BLANK_WORD})"), 1)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.concat(F.slice(w, 1, a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, a + i % p))), " ")

    one = F.filter(F.array(words), lambda w: F.size(w) > 0)  # as an argument of a lambda the words are made once
    return F.when((h % 10 == 0) & text.rlike(BLANK_WORD), F.get(F.transform(one, repeated), F.lit(0))).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    # Runs come by start, then period: the first of the longest ones is the one asked for.
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda acc, r: F.when(acc.isNull() | (r["length"] > acc["length"]), r).otherwise(acc))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
