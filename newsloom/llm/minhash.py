"""MinHash near-duplicates: many universal hash minima, bands, verified signatures, confirmed sets, components by stars.

A text's signature holds the minima of BANDS * ROWS universal hash functions over its shingles. Texts that agree on all rows of
a band meet in a bucket; two of similarity 0.85 miss each other in all buckets with a chance of 2.3e-8. In a bucket all
signatures are compared, in tiles of bounded size that return a spanning forest, not their pairs; the components of these
forests, found by alternating stars, hold all links that there can be. Whole sets are then compared inside such a component,
to which each text goes once. A component too large for that is first thinned: in a few rounds each member is confirmed
against one leader, and what is linked counts as one from there on. No link between components is lost to any bound.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.stars import star_components
from newsloom.llm.substrings import _per_document, _runs
from newsloom.operators.shared import materialize

SHINGLE, PERCENT = 5, 85
BANDS, ROWS, SEED = 30, 5, 20260101
#: Members of a bucket that are compared in one tile; a larger bucket than LARGE becomes one component to be confirmed, unseen.
TILE, LARGE = 1024, 1 << 15
#: Members and shingles of a component that are confirmed in one task, and texts that are confirmed beside one copy of a leader's.
MEMBERS, SHINGLES, CHUNK = 8192, 1 << 20, 256
#: Rounds with leaders while more than so many pairs a member are open.
ROUNDS, FEW = 4, 4096
#: Bytes of a minimum that a signature keeps: two texts agree on one by chance once in 65,536 times.
WIDTH = 2
_CELLS = 1 << 15


def hash_functions(count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of multiply-add-shift: x -> (a * x + b mod 2^64) >> 32, strongly universal on 32-bit x."""
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 1 << 64, count, np.uint64) for _ in range(2))
    return a, b


def shingle_set(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of the runs of `shingle` words; of fewer words, the hash of all; of none, nothing."""
    return np.unique(_runs(words, min(shingle, len(words)))) if len(words) else np.empty(0, np.uint64)


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each set, none of them empty, the minimum of every hash function."""
    out = np.empty((len(a), len(sets)), np.uint32)
    at = 0
    while at < len(sets):
        end, cells = at, 0
        while end < len(sets) and (end == at or cells + len(sets[end]) <= _CELLS):
            cells += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end]) >> np.uint64(32)
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        h = np.empty_like(x)
        for k in range(len(a)):
            np.multiply(x, a[k], out=h)
            np.add(h, b[k], out=h)
            out[k, at:end] = np.minimum.reduceat(h, starts) >> np.uint64(32)
        at = end
    return np.ascontiguousarray(out.T)


def least_agreeing(count: int, percent: int = PERCENT, chance: float = 1e-9) -> int:
    """Fewest equal minima of a pair at the similarity asked, but for a chance of so much."""
    s, below = percent / 100, 0.0
    for m in range(count + 1):
        below += math.comb(count, m) * s**m * (1 - s) ** (count - m)
        if below > chance:
            return m
    return count


def _lowered(texts: pa.Array) -> list[bytes]:
    return [(t or b"").lower() for t in texts.to_pylist()]  # bytes: lowers A-Z only


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_id, n, digest (of the set; null if it is empty), signature."""
    a, b = hash_functions(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(w, shingle) for w in _per_document(_lowered(part.column(2)))]
                full = [i for i, s in enumerate(sets) if len(s)]
                digest, signature = [None] * len(sets), [None] * len(sets)
                for i, m in zip(full, minima([sets[i] for i in full], a, b)):
                    digest[i], signature[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), m.astype(f"<u{WIDTH}").tobytes()
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], ["doc_id", "text_id", "n", "digest", "signature"])

    rows_in = docs.select("doc_id", F.unhex(F.md5("text")).alias("text_id"), F.col("text").cast("binary").alias("text"))
    return rows_in.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_id binary, n long, digest binary, signature binary")


class _Joined:
    """Components of rows 0 to n - 1: each has the smallest row as its label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> None:
        labels = np.unique(self.label[np.append(others, x)])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def edges(self, ids: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """A star for each component of several rows: its other rows, and its smallest id."""
        rows = np.flatnonzero(np.bincount(self.label, minlength=len(ids))[self.label] > 1)
        least: dict[int, bytes] = {}
        for i in rows.tolist():
            k = int(self.label[i])
            least[k] = min(ids[i], least.get(k, ids[i]))
        out = [(ids[i], least[int(self.label[i])]) for i in rows.tolist() if ids[i] != least[int(self.label[i])]]
        return [x[0] for x in out], [x[1] for x in out]


def _edges(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _alike_signatures(least: int, percent: int):
    """Over rows sorted by tile (band, key, i, j, mine, digest, n, signature): a forest of the pairs that may be similar."""

    def forest(t: pa.Table) -> pa.RecordBatch:
        key = np.stack([t.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
        mine, n, ids = t.column(4).to_numpy(), t.column(6).to_numpy(), t.column(5).to_pylist()
        sig = np.frombuffer(b"".join(t.column(7).to_pylist()), f"<u{WIDTH}").reshape(len(ids), -1)
        cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True])))
        a, b = [], []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            (i, j), found = key[s, 2:], _Joined(e - s)
            for x in range(s, e):
                if mine[x] != i:
                    continue
                others = np.arange(x + 1, e) if i == j else s + np.flatnonzero(mine[s:e] == j)
                low, high = np.minimum(n[others], n[x]), np.maximum(n[others], n[x])
                others = others[(found.label[others - s] != found.label[x - s]) & (100 * low >= percent * high)]
                if len(others):
                    found.join(x - s, others[(sig[others] == sig[x]).sum(1) >= least] - s)
            more = found.edges(ids[s:e])
            a += more[0]
            b += more[1]
        return _edges(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.table(b) if held is None else pa.concat_tables([held, pa.table(b)])
            key = np.stack([held.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
            same = (key == key[-1]).all(1)
            whole = len(key) - int((~same[::-1]).argmax()) if not same.all() else 0
            if whole:  # the last tile may go on in the next batch
                yield forest(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield forest(held.combine_chunks())

    return run


def _alike_sets(percent: int, shingle: int):
    """Over rows sorted by tile (node, i, j, mine, digest, component, text): a forest of the links of its different components."""

    def forest(i: int, j: int, rows: list[tuple]) -> pa.RecordBatch:
        mine = np.array([r[0] for r in rows])
        ids, sets = [r[1] for r in rows], [r[3] for r in rows]
        n = np.array([len(s) for s in sets])
        word = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(n)
        starts, marked, found = ends - n, np.zeros(int(word.max()) + 1, bool), _Joined(len(rows))
        known: dict[bytes, int] = {}
        for x, r in enumerate(rows):  # what is linked already
            found.join(known.setdefault(r[2], x), np.array([x]))
        for x in range(len(rows)):
            if mine[x] != i:
                continue
            others = np.arange(x + 1, len(rows)) if i == j else np.flatnonzero(mine == j)
            low, high = np.minimum(n[others], n[x]), np.maximum(n[others], n[x])
            others = others[(found.label[others] != found.label[x]) & (100 * low >= percent * high)]
            if not len(others):
                continue
            marked[word[starts[x] : ends[x]]] = True
            size, first = n[others], np.cumsum(n[others]) - n[others]
            each = np.repeat(starts[others] - first, size) + np.arange(int(size.sum()))
            both = np.add.reduceat(marked[word[each]].astype(np.int64), first)
            marked[word[starts[x] : ends[x]]] = False
            found.join(x, others[100 * both >= percent * (size + n[x] - both)])
        return _edges(*found.edges(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = (part.column(k).to_pylist() for k in range(6))
                for node, i, j, mine, digest, component, words in zip(*columns, _per_document(_lowered(part.column(6)))):
                    if tile != (node, i, j):
                        if len(rows) > 1:
                            yield forest(*tile[1:], rows)
                        tile, rows = (node, i, j), []
                    rows.append((mine, digest, component, shingle_set(words, shingle)))
        if len(rows) > 1:
            yield forest(*tile[1:], rows)

    return run


def _confirmed(percent: int, shingle: int):
    """Over rows sorted by group (b, chunk, role, digest, text), in each group b's own text first: a, b, linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, center = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b, linked = [], [], []
                columns = (part.column(i).to_pylist() for i in range(4))
                for which, chunk, role, digest, words in zip(*columns, _per_document(_lowered(part.column(4)))):
                    mine = shingle_set(words, shingle)
                    if role == 0:
                        group, center = (which, chunk), mine
                    elif group == (which, chunk):
                        both = len(np.intersect1d(mine, center, assume_unique=True))
                        a.append(digest), b.append(which), linked.append(100 * both >= percent * (len(mine) + len(center) - both))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(linked)], ["a", "b", "linked"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """pairs (a, b), texts (digest, text) -> a, b, linked, by their whole sets. b's text goes to its partners' tasks, once for each chunk of them."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    named = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).alias("chunk"))
    members = named.select("b", "chunk", F.lit(1).alias("role"), F.col("a").alias("digest"))
    centers = named.select("b", "chunk", F.lit(0).alias("role"), F.col("b").alias("digest")).distinct()
    rows = members.unionAll(centers).join(texts, "digest").select("b", "chunk", "role", "digest", F.col("text").cast("binary").alias("text"))
    rows = rows.repartition("b", "chunk").sortWithinPartitions("b", "chunk", "role")
    return materialize(rows.mapInArrow(_confirmed(percent, shingle), "a binary, b binary, linked boolean"))


def _tiled(rows: DataFrame, key: list[str], tiles: Column, *columns: str) -> DataFrame:
    """rows once for every pair of tiles of its key that it takes part in, sorted by pair: key, i, j, mine, columns."""
    cut = rows.withColumn("tiles", tiles.cast("int")).withColumn("mine", F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int"))
    each = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = each.select(*key, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", *columns)
    return placed.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")


def candidates(classes: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, tile: int = TILE, large: int = LARGE) -> DataFrame:
    """classes (digest, n, signature) -> node, component: components that hold all classes that may be linked, of two and more."""
    wide = WIDTH * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.substring("signature", i * wide + 1, F.lit(wide))).alias("key")))
    keyed = classes.select("digest", F.explode(keys).alias("k")).select("k.band", "k.key", "digest")
    crowded = keyed.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("digest").alias("lead")).where("size > 1")
    members = materialize(keyed.join(crowded, ["band", "key"]))
    signed = members.where(F.col("size") <= large).join(classes, "digest")
    tiled = _tiled(signed, ["band", "key"], F.ceil(F.col("size") / tile), "digest", "n", "signature")
    alike = tiled.mapInArrow(_alike_signatures(least_agreeing(bands * rows, percent), percent), "a binary, b binary")
    return star_components(alike.unionAll(members.where(F.col("size") > large).select(F.col("digest").alias("a"), F.col("lead").alias("b"))))


def _sizes(members: DataFrame) -> DataFrame:
    """members (node, component, n) of the nodes that have several components, with size, shingles and open: their pairs of different ones."""
    each = members.groupBy("node", "component").agg(F.count("*").alias("c"), F.sum("n").alias("words"))
    squares = F.sum(F.col("c").cast("double") * F.col("c"))
    g = each.groupBy("node").agg(F.sum("c").alias("size"), F.sum("words").alias("shingles"), squares.alias("squares"), F.count("*").alias("parts")).where("parts > 1")
    g = g.select("node", "size", "shingles", ((F.col("size").cast("double") * F.col("size") - F.col("squares")) / 2).alias("open"))
    return members.join(g, "node")


def linked(
    members: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, rounds: int = ROUNDS, most: int = MEMBERS, shingles: int = SHINGLES, few: int = FEW
) -> DataFrame:
    """members (node, digest, n), texts (digest, text) -> node, component of digests: those linked inside a node, by whole sets."""
    members = materialize(_sizes(members.withColumn("component", F.col("digest"))))
    edges = members.select(F.col("digest").alias("a"), F.col("digest").alias("b")).where("false")
    whole = lambda: members.agg(F.max("open"), F.max(F.greatest(F.col("size") / most, F.col("shingles") / shingles)), F.max(F.col("open") / F.col("size"))).first()
    (pairs_left, tiles_most, per_member), thinned = whole(), False
    for turn in range(rounds):
        if not pairs_left or per_member <= few:
            break
        thinned = True
        order = F.xxhash64("digest", F.lit(turn))
        crowd = members.where(F.col("open") > few * F.col("size"))
        leaders = crowd.groupBy("node").agg(F.min(F.struct(order.alias("order"), "digest", "n", "component")).alias("lead"))
        met = crowd.join(leaders, "node").where(F.col("component") != F.col("lead.component"))
        met = met.where(100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n"))
        said = confirm(materialize(met.select(F.col("digest").alias("a"), F.col("lead.digest").alias("b"))), texts, percent, shingle)
        found = star_components(edges.unionAll(said.where("linked").select("a", "b")))
        edges = found.where("node <> component").toDF("a", "b")
        renamed = found.withColumnRenamed("node", "digest").withColumnRenamed("component", "now")
        now = members.select("node", "digest", "n", "component").join(renamed, "digest", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
        members = materialize(_sizes(now))
        pairs_left, tiles_most, per_member = whole()
    if pairs_left:
        tiles = F.ceil(F.greatest(F.col("size") / most, F.col("shingles") / shingles))
        tiled = _tiled(members.join(texts, "digest").withColumn("text", F.col("text").cast("binary")), ["node"], tiles, "digest", "component", "text")
        more = materialize(tiled.mapInArrow(_alike_sets(percent, shingle), "a binary, b binary"))
        if tiles_most <= 1 and not thinned:  # each component was seen whole: its star is there
            return more.toDF("node", "component").unionAll(more.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        edges = edges.unionAll(more)
    return star_components(edges)


def minhash_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, **bounds: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Texts are linked if 100 * intersection >= percent * union holds for their sets of different word shingles (64-bit hashes
    of A-Z lower-cased words that ASCII blanks part). Fewer words than a shingle are one shingle; null and empty texts have
    an empty set and no links. component_id is the smallest doc_id reachable, itself included, and kept says whether it is
    the row's own. Texts of equal sets are one class, linked as such. Rows that share a doc_id are linked by their own
    texts; a row without doc_id takes the smallest of its component, and is kept if that has none. Repeated rows stay;
    further columns are left out; an empty table gives an empty result. bounds are those of `linked`; none changes results.
    """
    docs = docs.select("doc_id", "text")
    prints = materialize(signatures(docs, shingle, bands, rows))
    full = prints.where("digest IS NOT NULL").groupBy("digest")
    classes = materialize(full.agg(F.min("doc_id").alias("first"), F.min("text_id").alias("text_id"), F.min("n").alias("n"), F.min("signature").alias("signature")))
    maybe = candidates(classes.select("digest", "n", "signature"), percent, bands, rows)
    members = materialize(maybe.toDF("digest", "node").join(classes.select("digest", "n", "text_id"), "digest"))
    # A list of texts that grows with the table is never broadcast: both sides are shuffled at every size.
    texts = docs.withColumn("text_id", F.unhex(F.md5("text"))).join(members.select("text_id", "digest").hint("merge"), "text_id")
    texts = materialize(texts.groupBy("digest").agg(F.first("text").alias("text")))
    found = linked(members.select("node", "digest", "n"), texts, percent, shingle, **bounds)
    named = classes.select("digest", "first").join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(named.join(smallest, "component").select("digest", "component_id"))
    out = prints.select("doc_id", "n", "digest").join(named, "digest", "left")
    home = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), home.alias("component_id"), F.col("doc_id").eqNullSafe(home).alias("kept"))


def op13_minhash(spark, sf_dir: str) -> DataFrame:
    return minhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
