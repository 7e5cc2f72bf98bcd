"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.components import connected_components
from newsloom.operators.shared import materialize

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints of one block that are compared in one tile; larger blocks become pairs of tiles.
TILE = 1024
#: Chance partners a fingerprint may meet in a block before more, narrower blocks are used.
PER_BLOCK = 2.0


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half the hashes of the text's word shingles."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z only, splits at ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - shingle, 0)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[: last + 1].tolist(), ends[len(words) - last - 1 :].tolist())), np.uint64, last + 1)
    ones, steps = np.zeros((8, 8), np.int64), np.arange(0, len(h), 255)
    for i in range(8):  # byte lanes: eight counters in a word, emptied before they overflow
        lanes = np.add.reduceat((h >> np.uint64(i)) & np.uint64(0x0101010101010101), steps)
        ones[:, i] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    bits = ones.reshape(64) * 2 > len(h)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, further columns to keep, fp (the 64 bits as a signed long). Null text is empty text: fp 0."""

    def run(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(a, 256).to_pylist() for a in range(0, len(texts), 256))
        return pa.array(np.array([fingerprint(t) for part in parts for t in part], np.uint64).view(np.int64))

    return docs.select("doc_id", *keep, F.arrow_udf(run, "long")(F.col("text").cast("binary")).alias("fp"))


def block_masks(distance: int, blocks: int) -> list[int]:
    """Bit masks, one for each choice of blocks - distance blocks: a pair within the distance agrees on one of them."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(x) for x in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def choose_blocks(n: int, distance: int = DISTANCE, per_block: float = PER_BLOCK) -> int:
    """Fewest blocks for which n random fingerprints meet at most per_block others under a key. Every choice is exact."""
    blocks = distance + 2
    while n > per_block * 2.0 ** (64 * (blocks - distance) / blocks) and blocks < 4 * distance:
        blocks += 1
    return blocks


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent after the edges a-b; every entry points at its root, the smallest index."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def _tile_links(distance: int):
    """Over rows sorted by tile: a spanning forest of the pairs within the distance, tile by tile."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        n = len(fp)
        new = np.concatenate(([True], (key[1:] != key[:-1]).any(1)))
        group = np.cumsum(new) - 1
        end = np.append(np.flatnonzero(new)[1:], n)[group]
        parent, at, lag = np.arange(n), np.arange(n), 1
        while len(at := at[at + lag < end[at]]):
            near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= distance]
            parent = _join(parent, near, near + lag)
            lag += 1
        child = np.flatnonzero(parent != np.arange(n))
        pairs = np.unique(np.stack([fp[child], fp[parent[child]]], 1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty((0, 4), np.int64), np.empty(0, np.uint64)
        for b in batches:
            k = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            f = b.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            held_k, held_f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            if not len(held_k):
                continue
            whole = len(held_k) - int((held_k[::-1] != held_k[-1]).any(1).argmax()) if (held_k != held_k[-1]).any() else 0
            if whole:  # the last tile may go on in the next batch
                yield links(held_k[:whole], held_f[:whole])
                held_k, held_f = held_k[whole:], held_f[whole:]
        if len(held_k):
            yield links(held_k, held_f)

    return run


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Distinct fp -> a, b: pairs that connect, directly or over others, all that are within the distance of each other.

    Pigeonhole: with `blocks` blocks, two fingerprints that differ in at most `distance` bits agree
    on blocks - distance of them, so every choice of so many is a join key. All fingerprints of a
    key are compared, in tiles of bounded size: a hot key becomes many pairs of tiles in as many
    tasks, and a tile returns its spanning forest, not its pairs. No link between components is lost.
    """
    if blocks is None:
        blocks = choose_blocks(prints.count(), distance)
    masks = block_masks(distance, blocks)
    keyed = prints.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "key")
    )
    shared = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, ["choice", "key"])
    met = met.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = met.select("choice", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    tiled = tiled.repartition("choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j")
    return tiled.mapInArrow(_tile_links(distance), "a long, b long")


def _components(prints: DataFrame, distance: int, blocks: int | None, tile: int) -> DataFrame:
    """(doc_id, fp) -> fp, component (a fingerprint), component_id: the smallest doc_id of the fingerprints reachable over links."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = connected_components(links(classes.select("fp"), distance, blocks, tile))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.select("fp", "component").join(smallest, "component")


def simhash_components(docs: DataFrame, distance: int = DISTANCE, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id: one row for each row of docs.

    component_id is the smallest doc_id reached over links of at most `distance` bits, itself
    included. Equal fingerprints are one class, linked only as such. Null and empty texts have
    fingerprint 0 and link like any other; a null doc_id is never a component_id unless its
    whole component has none; repeated rows stay; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs))
    return prints.join(_components(prints, distance, blocks, tile), "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, distance: int = DISTANCE, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """docs, in their columns, with one row of each group of near copies; rows without doc_id all stay.

    Groups are of rows: of two rows that share a doc_id but not their text each belongs to its own text's group. The row
    of the smallest doc_id stays; of several such rows the one with the smallest hash over all columns that can be hashed.
    """
    named = docs.where("doc_id IS NOT NULL")
    name = "row" + "_" * max(map(len, docs.columns))
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    prints = materialize(fingerprints(named.withColumn(name, row), name))
    group = _components(prints.select("doc_id", "fp"), distance, blocks, tile)
    first = prints.join(group, "fp").groupBy("component").agg(F.min(F.struct("doc_id", name)).alias("x"))
    keep = first.select(F.col("x.doc_id").alias("doc_id"), F.col(f"x.{name}").alias(name))
    one = named.withColumn(name, row).join(keep, ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return one.select([F.col(f"`{c}`") for c in docs.columns]).unionAll(docs.where("doc_id IS NULL"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
