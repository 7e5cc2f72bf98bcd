"""Substring dedup by seed and extend.

Seeds: winnowing picks, in every run of MIN_WORDS words, the smallest hash of its SEED-word grams, so two
equal runs pick the same gram at the same offset. An anchor is a picked place; its zone is the text of all
windows (runs of MIN_WORDS words) that picked it. Documents are joined on anchors. Extension goes from an anchor both
ways by hashes: where all zones around an anchor are equal, a match reaches over the whole zone, and so on to the next
anchor's, as far as neighbouring zones are repeated too; where zones differ, which windows around the anchor an earlier
document shares is settled by a join on (anchor, window). A match to one earlier document alone, word by word, would not
do: which of the earlier ones reaches furthest differs from window to window, and pairing with all of them is quadratic.
The union of all repeated windows is the union of the maximal repeats of MIN_WORDS words and more. Hashes have 64 bits and
go by two (anchor and zone, or anchor and window).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.shared import materialize

MIN_WORDS = 20
SEED = 6
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words up to so many bytes are hashed eight bytes at a time, longer ones each on its own.
_LONG = 64


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all blank-separated words of all texts, and how many words each text has."""
    raw = b" ".join(texts) + b" " * 9
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edges = edges if blank[0] else np.append(0, edges)
    first, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # the eight bytes from every byte on
    h = _mix((eight[first] & _LOW_BYTES[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * _M))
    more, at = np.flatnonzero((sizes > 8) & (sizes <= _LONG)), 8
    while len(more):
        h[more] = _mix(h[more] * _M + (eight[first[more] + at] & _LOW_BYTES[np.minimum(sizes[more] - at, 8)]))
        at += 8
        more = more[sizes[more] > at]
    for i in np.flatnonzero(sizes > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : first[i] + sizes[i]], digest_size=8).digest(), "little")
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(first, text_ends), prepend=0)


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words that follow each other."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _M
        out ^= out >> np.uint64(29)
    return _mix(out)


class Anchors:
    """Anchors of one document: at (word where the gram begins), first and last window that picked it, hash, zone hash."""

    def __init__(self, h: np.ndarray, min_words: int = MIN_WORDS, seed: int = SEED):
        self.n, self.min_words, self.h = len(h), min_words, h
        if self.n < min_words:
            self.at = self.first = self.last = np.empty(0, np.int64)
            self.hash = self.zone = self.windows = np.empty(0, np.uint64)
            return
        grams, wide = _runs(h, seed), min_words - seed + 1
        picked = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(1) + np.arange(len(grams) - wide + 1)
        self.first = np.flatnonzero(np.concatenate(([True], picked[1:] != picked[:-1])))
        self.last = np.append(self.first[1:], len(picked)) - 1
        self.at, self.hash = picked[self.first], grams[picked[self.first]]
        # Windows are all of one length: a zone is known by its first and last window and the offsets they have.
        self.windows = _runs(h, min_words)
        ends = self.windows[self.first] * _M ^ self.windows[self.last] ^ _mix((self.last - self.first).astype(np.uint64))
        inner = np.add.reduceat(self.windows, self.first)
        self.zone = _mix(ends + inner * np.uint64(3))

    def windows_of(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that picked these anchors."""
        if not len(anchors):
            return np.empty(0, np.int64)
        n = self.last[anchors] - self.first[anchors] + 1
        return np.repeat(self.first[anchors] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _per_document(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, int]]:
    """Word hashes of each text, hashed many texts at a time."""
    at, step = 0, 1 << 22
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size < step):
            some.append(texts[at] or b"")
            size += len(some[-1])
            at += 1
        h, counts = word_hashes(some)
        ends = np.cumsum(counts)
        for a, z in zip((ends - counts).tolist(), ends.tolist()):
            yield h[a:z]


def _bytes(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *more)


def anchors(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, hash, zone: the different ones of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, which = [np.empty((0, 2), np.uint64)], []
            for k, words in enumerate(_per_document(b.column(1).to_pylist())):
                a = Anchors(words, min_words, seed)
                pairs = np.stack([a.hash, a.zone], 1)
                pairs = pairs[np.unique(a.zone ^ a.hash * _M, return_index=True)[1]]
                found.append(pairs), which.append(np.full(len(pairs), k))
            if which:
                both = np.concatenate(found).view(np.int64)
                ids = b.column(0).take(pa.array(np.concatenate(which)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "hash", "zone"])

    return _bytes(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, hash long, zone long")


def open_windows(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, open: hashes of anchors) -> doc_id, anchor, hash: the different windows that picked these anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, which = [np.empty((0, 2), np.uint64)], []
            for k, (words, some) in enumerate(zip(_per_document(b.column(1).to_pylist()), b.column(2))):
                a = Anchors(words, min_words, seed)
                opened = np.flatnonzero(np.isin(a.hash, _hashes(some)))
                windows, first = np.unique(a.windows[a.windows_of(opened)], return_index=True)
                of = np.repeat(a.hash[opened], a.last[opened] - a.first[opened] + 1)[first]
                found.append(np.stack([of, windows], 1)), which.append(np.full(len(windows), k))
            if which:
                both = np.concatenate(found).view(np.int64)
                ids = b.column(0).take(pa.array(np.concatenate(which)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "anchor", "hash"])

    return _bytes(docs, "open").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, anchor long, hash long")


def _hashes(values: pa.ListScalar) -> np.ndarray:
    return values.values.to_numpy().view(np.uint64) if values.is_valid else np.empty(0, np.uint64)


def covered(a: Anchors, closed: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which words lie in a maximal repeat: in windows that picked a closed anchor, in the windows given (both by hash),
    or in windows that stand earlier in the document itself."""
    if a.n < a.min_words:
        return np.zeros(a.n, bool)
    begins = np.ones(len(a.windows), bool)
    begins[np.unique(a.windows, return_index=True)[1]] = False
    whole = a.windows[a.windows_of(np.flatnonzero(np.isin(a.hash, closed)))] if len(closed) else closed
    if len(whole) or len(windows):
        begins |= np.isin(a.windows, np.concatenate([whole, windows]))
    steps = np.zeros(a.n + 1, np.int64)
    steps[: len(begins)] += begins
    steps[a.min_words : a.min_words + len(begins)] -= begins
    return np.cumsum(steps[:-1]) > 0


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, closed, windows: what of each document another one has earlier, as hashes of the
    anchors all of whose windows are repeated, and of further windows."""
    docs = docs.select("doc_id", "text")
    found = materialize(anchors(docs, min_words, seed))  # read for the groups and for the join: texts are hashed once for both
    # Partial sums before the shuffle: a passage that a third of all documents share is one row a task.
    groups = found.groupBy("hash").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min("zone").alias("low"), F.max("zone").alias("high")
    )
    groups = groups.where("first_doc <> last_doc").select("hash", "first_doc", (F.col("low") != F.col("high")).alias("mixed"))
    met = found.drop("zone").join(groups, "hash").where("mixed OR doc_id > first_doc")
    closed, opened = F.when(~F.col("mixed"), F.col("hash")), F.when(F.col("mixed"), F.col("hash"))
    marks = materialize(met.groupBy("doc_id").agg(F.collect_set(closed).alias("closed"), F.collect_set(opened).alias("open")))
    texts = docs.join(marks.where(F.size("open") > 0).select("doc_id", "open"), "doc_id")
    windows = materialize(open_windows(texts, min_words, seed))
    earliest = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc")
    later = windows.join(earliest.select("anchor", "hash", "first_doc"), ["anchor", "hash"]).where("doc_id > first_doc")
    return marks.select("doc_id", "closed").join(later.groupBy("doc_id").agg(F.collect_set("hash").alias("windows")), "doc_id", "full_outer")


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED, digest: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept (the words that stay, joined by a space; with digest
    their SHA-256 as kept_sha256).

    A word goes if it lies in a window of min_words words whose sequence also starts earlier: in a document of smaller
    doc_id, or further up in its own. All windows are judged on the input. Texts shorter than a window lose nothing; null
    text has no words. doc_id tells documents apart: a row without one is compared with itself alone, rows that share
    one are not compared with each other. Further columns are left out. An empty table gives an empty result.
    """
    last, docs = "kept_sha256" if digest else "kept", docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            n, gone, kept = [], [], []
            for text, h, closed, windows in zip(texts, _per_document(texts), b.column(2), b.column(3)):
                c = covered(Anchors(h, min_words, seed), _hashes(closed), _hashes(windows))
                words = text.split()
                left = b" ".join([w for w, x in zip(words, c.tolist()) if not x] if c.any() else words)
                n.append(len(words)), gone.append(int(c.sum())), kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", last])

    marked = docs.join(repeats(docs, min_words, seed), "doc_id", "left")
    return _bytes(marked, "closed", "windows").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, {last} string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, digest=True)
