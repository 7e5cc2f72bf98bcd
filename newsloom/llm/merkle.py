"""Merkle manifest of a dataset, with proofs by coordinate lookup.

Rows are leaves. In every group they stand in order, and each ARITY neighbours (the last ones may be fewer) become one node,
level by level, until one node remains; the groups' tops form one more tree of the same kind. The node table keeps a row for
each run of siblings: group, level, number of the run, and the run's digests one after the other. To prove a leaf, its place
and the size of its group give the coordinates of all siblings that are needed; leaves explode them, join the node table,
put what they get in order, concatenate it and fold. Levels whose number of nodes is bounded are broadcast, so the few runs
near a top, which every leaf asks for, are no hot join keys; the others are joined by shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.words import ascii_lower
from newsloom.operators.ranking import with_rank
from newsloom.operators.shared import materialize

ARITY = 8
#: Levels of a tree that together have at most so many nodes (of 32 bytes) are broadcast.
BROADCAST_NODES = 1 << 16
_DIGEST = 32


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon, value; integers in decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values' fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out


@dataclass
class Tree:
    """levels[i] (grp, run, digests): the runs of siblings of level i; nodes[i]: how many nodes they hold; tops (grp, digest)."""

    levels: list[DataFrame]
    nodes: list[int]
    tops: DataFrame
    arity: int


def build(leaves: DataFrame, arity: int = ARITY) -> Tree:
    """leaves (grp, idx: place in its group from 0, n: size of the group, digest: 32 bytes) -> all nodes.

    A lone leaf is its group's top. Every group of the aggregation holds at most `arity` rows; each level is `arity` times
    smaller than the one before. Only counts reach the driver.
    """
    now, levels, nodes, tops = leaves.select("grp", "idx", "n", "digest"), [], [], []
    while True:
        tops.append(now.where("n = 1").select("grp", "digest"))
        members = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        runs = now.where("n > 1").groupBy("grp", "n", F.expr(f"idx DIV {arity}").alias("run")).agg(members.alias("members"))
        digests = F.aggregate("members", F.lit(b""), lambda acc, x: F.concat(acc, x["digest"]))
        runs = materialize(runs.select("grp", "n", "run", digests.alias("digests")))
        held = runs.agg(F.sum(F.octet_length("digests"))).first()[0]
        if not held:
            return Tree(levels, nodes, materialize(_union(tops)), arity)
        levels.append(runs.select("grp", "run", "digests"))
        nodes.append(held // _DIGEST)
        up = F.unhex(F.sha2(_hex(F.col("digests")), 256))
        now = runs.select("grp", F.col("run").alias("idx"), F.ceil(F.col("n") / arity).alias("n"), up.alias("digest"))


def coordinates(leaves: DataFrame, arity: int, height: int) -> DataFrame:
    """leaves (grp, idx, n) -> grp, idx, level, run, place: where the siblings of a leaf and of each node above it stand.

    A group of n leaves has a level i while arity^i < n. Place is the leaf's (or node's) own place in the run.
    """
    power = F.array(*[F.lit(arity**i).cast("long") for i in range(height + 1)])
    levels = F.filter(F.sequence(F.lit(0), F.lit(height - 1)), lambda i: F.get(power, i) < F.col("n"))
    each = leaves.select("grp", "idx", F.explode(levels).alias("level")).withColumn("at", F.expr("idx").cast("long"))
    below, above = F.get(power, F.col("level")), F.get(power, F.col("level") + 1)
    run = (F.col("at") - F.col("at") % above) / above
    place = (F.col("at") % above - F.col("at") % below) / below
    return each.select("grp", "idx", "level", run.cast("long").alias("run"), place.cast("int").alias("place"))


def paths(tree: Tree, leaves: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """leaves (grp, idx, n) -> grp, idx, path: for each level, from the leaf up, the own place in the run of siblings and the
    run's digests. Lone leaves have no row."""
    height = len(tree.levels)
    if not height:
        kind = "array<struct<level:int,place:int,digests:binary>>"
        return leaves.where("false").select("grp", "idx", F.lit(None).cast(kind).alias("path"))
    each = coordinates(leaves, tree.arity, height)
    low = next(i for i in range(height + 1) if sum(tree.nodes[i:]) <= broadcast_nodes)
    table = [t.withColumn("level", F.lit(i)) for i, t in enumerate(tree.levels)]
    key, met = ["grp", "level", "run"], []
    if table[:low]:
        met.append(each.where(F.col("level") < low).join(_union(table[:low]), key))
    if table[low:]:
        met.append(each.where(F.col("level") >= low).join(F.broadcast(_union(table[low:])), key))
    step = F.struct("level", "place", "digests")
    return _union(met).groupBy("grp", "idx").agg(F.array_sort(F.collect_list(step)).alias("path"))


def _before(step: Column) -> Column:
    return _hex(F.substring(step["digests"], F.lit(1), step["place"] * _DIGEST))


def _after(step: Column) -> Column:
    """What follows the own digest in the run."""
    return _hex(F.substring(step["digests"], step["place"] * _DIGEST + _DIGEST + 1, F.octet_length(step["digests"])))


def siblings(path: Column) -> Column:
    """All siblings of a path as hex, level by level, left to right, in one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(_before(s), _after(s))), "")


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf (hex) and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(_before(s), acc, _after(s)), 256))


@dataclass
class Manifest:
    """leaves (grp, idx, n, leaf and the columns kept); groups (grp, group, n); trees: one over each group's leaves, one over the tops."""

    leaves: DataFrame
    groups: DataFrame
    lower: Tree
    upper: Tree
    root: str | None


def manifest(rows: DataFrame, arity: int = ARITY) -> Manifest:
    """rows (group, key, leaf: hex, further columns) -> the trees.

    In a group leaves ascend by key, nulls first and ties by digest, so repeated rows may stand in any order; groups ascend
    by their value, null first. Places come from a range sort, so a group that holds most rows is sorted in many tasks.
    An empty table has no root.
    """
    placed = with_rank(rows, [F.asc_nulls_first("group"), F.asc_nulls_first("key"), F.col("leaf")], "place")
    sizes = placed.groupBy("group").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    groups = with_rank(sizes, [F.asc_nulls_first("group")], "grp")
    mine = groups.withColumnRenamed("group", "its_group")
    leaves = placed.join(mine, F.col("group").eqNullSafe(F.col("its_group"))).drop("its_group")
    leaves = materialize(leaves.withColumn("idx", F.col("place") - F.col("start")).drop("place", "start"))
    lower = build(leaves.withColumn("digest", F.unhex("leaf")), arity)
    count = groups.count()
    tops = lower.tops.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), F.lit(count).cast("long").alias("n"), "digest")
    upper = build(tops, arity)
    root = upper.tops.select(_hex(F.col("digest"))).first()
    return Manifest(leaves, groups.drop("start"), lower, upper, root and root[0])


def proofs(m: Manifest, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """m -> its leaves with subroot and path: all steps from the leaf over its group's top to the root."""
    count = F.lit(m.groups.count()).cast("long")
    tops = m.lower.tops.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("idx"), count.alias("n"), "digest")
    above = tops.drop("digest").transform(lambda t: paths(m.upper, t, broadcast_nodes)).select(F.col("idx").alias("grp"), F.col("path").alias("above"))
    subroots = materialize(m.lower.tops.select("grp", _hex(F.col("digest")).alias("subroot")).join(above, "grp", "left"))
    own = paths(m.lower, m.leaves.select("grp", "idx", "n"), broadcast_nodes)
    none = F.array().cast("array<struct<level:int,place:int,digests:binary>>")
    path = F.concat(F.coalesce("path", none), F.coalesce("above", none))
    return m.leaves.join(own, ["grp", "idx"], "left").join(subroots, "grp").withColumn("path", path).drop("above")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every leaf, its proof, and the root that it, or its tampered form, folds to with its original siblings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hashed = lambda text: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, hashed(ascii_lower(F.col("text"))))
    rows = materialize(docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"), hashed(F.col("text")).alias("leaf"), tampered.alias("tampered")))
    m = manifest(rows)
    p = proofs(m).withColumn("root", F.lit(m.root)).withColumn("folded_root", fold(F.col("path"), F.coalesce("tampered", "leaf")))
    return p.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql(levels: int = 10) -> str:
    """Trees of up to 8^levels leaves a group, level by level; CRC-32 by its table of bytes."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        "bits AS (SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b))",
        "tab AS (SELECT list(c ORDER BY b) AS t FROM bits)",
        "crc AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS crc FROM documents, tab)",
        f"leaves AS (SELECT d.doc_id, lang, {leaf('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS acc FROM documents d LEFT JOIN crc USING (doc_id))",
        "g0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, '' AS proof FROM leaves)",
        "n0 AS (SELECT lang, idx, leaf AS digest FROM g0)",
    ]

    def climb(n: str, f: str, group: str, keep: str, last: int) -> None:
        for i in range(last):
            ctes.append(f"{n}r{i} AS (SELECT {group} AS grp, idx // 8 AS run, list(digest ORDER BY idx) AS d, any_value(sum_n) AS sum_n FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS sum_n FROM {n}{i}) GROUP BY {group}, idx // 8)")
            ctes.append(f"{n}{i + 1} AS (SELECT grp AS {group}, run AS idx, CASE WHEN sum_n = 1 THEN d[1] ELSE sha256(array_to_string(d, '')) END AS digest FROM {n}r{i})")
            before, after = "array_to_string(d[1:idx % 8], '')", "array_to_string(d[idx % 8 + 2:], '')"
            ctes.append(
                f"{f}{i + 1} AS (SELECT {keep}, idx // 8 AS idx, CASE WHEN sum_n = 1 THEN proof ELSE proof || {before} || {after} END AS proof, CASE WHEN sum_n = 1 THEN acc ELSE sha256({before} || acc || {after}) END AS acc "
                f"FROM {f}{i} x JOIN {n}r{i} r ON x.{group} IS NOT DISTINCT FROM r.grp AND x.idx // 8 = r.run)"
            )

    climb("n", "g", "lang", "doc_id, lang, leaf", levels)
    ctes.append(f"s AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM n{levels})")
    ctes.append("m0 AS (SELECT 0 AS one, place AS idx, subroot AS digest FROM s)")
    ctes.append(f"h0 AS (SELECT doc_id, leaf, subroot, 0 AS one, place AS idx, proof, acc FROM g{levels} g JOIN s ON g.lang IS NOT DISTINCT FROM s.lang)")
    climb("m", "h", "one", "doc_id, leaf, subroot, one", 3)
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = digest AS verified FROM h3 JOIN m3 USING (one)"
    )


OP11_SQL = _sql()
