"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs.

Distinct vectors are dealt to shards of bounded size; each shard gets a graph of its own, built by inserting
vectors in blocks: a greedy search from the middle proposes neighbours, pruning with a relaxed distance keeps
diverse ones, and edges are returned. Queries go through every shard by beam search; their best are merged.

Inner products become distances by one more coordinate, sqrt(longest^2 - length^2), which is 0 for queries.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.shared import materialize

K = 20
#: Vectors of a shard and queries of a block: what one task holds.
SHARD, BLOCK = 8192, 16384
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX, EXPAND = 32, 64, 112, 1.2, 4


def _distances(x: np.ndarray, sq: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances, less each query's own length, of q[i] to x[ids[i]]; id -1 is infinitely far."""
    d = sq[ids] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0]
    d[ids < 0] = np.inf
    return d


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam nearest vectors met from start, for every query: ids (-1: none) and distances, nearest first."""
    n, b = len(x), len(q)
    sq = (x * x).sum(1)
    seen = np.zeros((b, n + 1), bool)  # the last column is for id -1
    rows = np.arange(b)[:, None]
    ids = np.full((b, beam), -1)
    ids[:, 0] = start
    dist = np.full((b, beam), np.inf, np.float32)
    dist[:, :1] = _distances(x, sq, q, ids[:, :1])
    done = ids < 0
    seen[:, start] = True
    live = np.arange(b)
    while len(live):
        r = rows[: len(live)]
        first = np.argsort(done[live], axis=1, kind="stable")[:, :EXPAND]
        fresh = ~done[live[:, None], first]
        done[live[:, None], first] = True
        new = np.where(fresh[:, :, None], graph[ids[live[:, None], first]], -1).reshape(len(live), -1)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[live[:, None], new]] = -1
        seen[live[:, None], new] = True
        seen[:, n] = False
        d = _distances(x, sq, q[live], new)
        all_d = np.concatenate([dist[live], d], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[live] = np.concatenate([ids[live], new], 1)[r, order]
        dist[live] = all_d[r, order]
        done[live] = np.concatenate([done[live], new < 0], 1)[r, order]
        live = live[~done[live].all(1)]
    return ids, dist


def robust_prune(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int = DEGREE, relax: float = RELAX) -> np.ndarray:
    """For each row of candidates, nearest first: up to `degree`, of which none is much nearer to a kept one than to the row's own vector."""
    v = x[ids]
    sq = (v * v).sum(2)
    between = np.maximum(sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
    alive, out = ids >= 0, np.full((len(ids), degree), -1)
    r = np.arange(len(ids))
    for t in range(degree):
        p = alive.argmax(1)
        some = alive[r, p]
        if not some.any():
            break
        out[:, t] = np.where(some, ids[r, p], -1)
        alive &= ~((relax * relax * between[r, p] <= dist) & some[:, None])
        alive[r, p] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """Neighbours (n, degree; -1: none) and the node where searches start. Deterministic."""
    n = len(x)
    graph = np.full((n, degree), -1)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = order[order != start]
    at, step = 0, 1
    while at < len(order):
        batch = order[at : at + step]
        at, step = at + step, min(2 * step, 512)
        ids, dist = beam_search(x, graph, start, x[batch], beam)
        dist = np.maximum(dist + (x[batch] ** 2).sum(1)[:, None], 0)
        graph[batch] = robust_prune(x, ids, dist, degree, relax)
        to, by = graph[batch].ravel(), np.repeat(batch, degree)
        by, to = by[to >= 0], to[to >= 0]
        o = np.argsort(to, kind="stable")
        to, by = to[o], by[o]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        wide = np.full((len(nodes), degree + int(count.max(initial=0))), -1)
        wide[:, :degree] = graph[nodes]
        wide[np.repeat(np.arange(len(nodes)), count), degree + np.arange(len(to)) - np.repeat(first, count)] = by
        held = (wide >= 0).sum(1)
        wide = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)
        fits = held <= degree
        graph[nodes[fits]] = wide[fits][:, :degree]
        for full in np.array_split(np.flatnonzero(~fits), max(1, -(-int((~fits).sum()) // 512))):
            if len(full):
                c = wide[full]
                d = ((x[c] - x[nodes[full]][:, None, :]) ** 2).sum(2)
                d[c < 0] = np.inf
                o = np.argsort(d, axis=1, kind="stable")[:, : 3 * degree]
                graph[nodes[full]] = robust_prune(x, np.take_along_axis(c, o, 1), np.take_along_axis(d, o, 1), degree, relax)
    return connected(graph, start), start


def connected(graph: np.ndarray, start: int) -> np.ndarray:
    """The graph with an edge more to each node that pruning cut off from start, from its nearest neighbour that is reached."""
    reached, more = np.zeros(len(graph) + 1, bool), []
    reached[-1] = True  # stands for -1: no neighbour

    def walk(front: np.ndarray) -> None:
        while len(front):
            reached[front] = True
            front = np.unique(graph[front])
            front = front[~reached[front]]

    walk(np.array([start]))
    while len(lost := np.flatnonzero(~reached)):
        near = reached[graph[lost]] & (graph[lost] >= 0)
        can = np.flatnonzero(near.any(1))
        child = int(lost[can[0]]) if len(can) else int(lost[0])
        more.append((int(graph[child, near[can[0]].argmax()]) if len(can) else start, child))
        walk(np.array([child]))
    if not more:
        return graph
    wide = np.full((len(graph), max(Counter(p for p, _ in more).values())), -1)
    held: Counter = Counter()
    for parent, child in more:
        wide[parent, held[parent]] = child
        held[parent] += 1
    return np.concatenate([graph, wide], 1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (as doubles) of the rows that take part: an id, and components that are all there, finite and not all 0."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select("vec_id", e.alias("embedding")).where(F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda v: v != 0))


def build_index(vectors: DataFrame, shard: int = SHARD, per_class: int = K + 1) -> DataFrame:
    """valid vectors -> dim, shard, embedding, members, neighbours, start: graphs of the distinct vectors of all shards.

    Equal vectors are one node. members holds its smallest ids, enough for any query to take its
    k and leave out itself; a graph over thousands of equal points would lead nowhere. Vectors of
    different lengths are in different shards.
    """
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = vectors.distinct().withColumn("rank", rank).where(F.col("rank") <= per_class)
    nodes = materialize(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).withColumn("dim", F.size("embedding")))
    shards = max(1, math.ceil(nodes.count() / shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by([("first", "ascending")])
        x = _matrix(t["embedding"])
        length = (x * x).sum(1)
        x = np.concatenate([x, np.sqrt(np.maximum(length.max() - length, 0))[:, None]], 1).astype(np.float32)
        graph, start = build_graph(x)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * graph.shape[1]), pa.array(graph.ravel().astype(np.int32)))
        more = {"neighbours": flat, "node": pa.array(np.arange(len(x), dtype=np.int32)), "start": pa.array(np.full(len(x), start, np.int32))}
        return pa.table({c: more[c] if c in more else t[c] for c in ("dim", "shard", "node", "start", "embedding", "members", "neighbours")})

    kind = "dim int, shard int, node int, start int, embedding array<double>, members array<long>, neighbours array<int>"
    dealt = dealt.withColumn("first", F.get("members", F.lit(0)))
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(build, kind))


def nearest_ids(nodes: np.ndarray, scores: np.ndarray, members: list[list[int]], most: int) -> list[tuple[int, float]]:
    """The `most` best different ids of nodes given by score, best first (-1: none), as (id, score); ties go to the smaller id."""
    got: dict[int, float] = {}
    last = None
    for node, score in zip(nodes.tolist(), scores.tolist()):
        if node < 0 or len(got) >= most and score < last:
            break
        last = score
        for v in members[node]:
            got.setdefault(v, score)
    return sorted(got.items(), key=lambda g: (-g[1], g[0]))[:most]


def search(index: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM, block: int = BLOCK) -> DataFrame:
    """index, queries (query_id, embedding) -> query_id, rank, vec_id, score: the k nearest found of other ids, nearest first.

    Distinct query vectors go, in blocks, through every shard of their length; a task holds one
    shard and one block. Scores are inner products of the original vectors in double precision.
    """
    asked = materialize(queries.groupBy("embedding").agg(F.min("query_id").alias("q")).withColumn("dim", F.size("embedding")))
    blocks = max(1, math.ceil(asked.count() / block))
    shards = index.select(F.col("dim").alias("d"), F.col("shard").alias("s")).distinct()  # one row a shard
    each = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    each = each.join(F.broadcast(shards), F.col("dim") == F.col("d")).select("q", "embedding", "dim", F.col("s").alias("shard"), "block")
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(nodes: pa.Table, some: pa.Table) -> pa.Table:
        qs, vs, ss = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if nodes.num_rows and some.num_rows:
            nodes = nodes.sort_by([("node", "ascending")])
            x, graph = _matrix(nodes["embedding"]), _matrix(nodes["neighbours"]).astype(np.int64)
            length = (x * x).sum(1)
            wide = np.concatenate([x, np.sqrt(np.maximum(length.max() - length, 0))[:, None]], 1).astype(np.float32)
            members = nodes["members"].to_pylist()
            q, q_ids = _matrix(some["embedding"]), some["q"].to_numpy()
            for a in range(0, len(q), 512):
                part = q[a : a + 512]
                ids, _ = beam_search(wide, graph, int(nodes["start"][0].as_py()), np.pad(part, ((0, 0), (0, 1))).astype(np.float32), beam)
                exact = np.matmul(x[ids], part[:, :, None])[:, :, 0]
                exact[ids < 0] = -np.inf
                best = np.argsort(-exact, axis=1, kind="stable")
                for i in range(len(part)):
                    got = nearest_ids(ids[i, best[i]], exact[i, best[i]], members, k + 1)
                    if len(got) <= k and beam < len(x):  # ids that repeat fill the beam: the whole shard is looked at
                        every = x @ part[i]
                        order = np.argsort(-every, kind="stable")
                        got = nearest_ids(order, every[order], members, k + 1)
                    qs.append(np.full(len(got), q_ids[a + i])), vs.append(np.array([g[0] for g in got], np.int64)), ss.append(np.array([g[1] for g in got]))
        return pa.table({"q": pa.array(np.concatenate(qs)), "vec_id": pa.array(np.concatenate(vs)), "score": pa.array(np.concatenate(ss))})

    found = copies.groupBy("dim", "shard", "block").cogroup(each.groupBy("dim", "shard", "block")).applyInArrow(find, "q long, vec_id long, score double")
    # An id counts once, by its best vector, before anything is cut: one that repeats takes no other's place.
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    who = queries.select("query_id", F.col("embedding").alias("e")).join(asked.select("q", F.col("embedding").alias("e")), "e").select("query_id", "q")
    own = found.join(who, "q").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = K, shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score, for the rows whose id is divisible by `every`.

    Rows without id, and vectors that are null, zero, or hold a null or non-finite component, take
    no part. An id that is repeated is asked with each of its different vectors, found once, by the best pair of vectors,
    and never finds itself. Ties go to the smaller
    id; queries without candidates have no rows; an empty table gives an empty result.
    """
    v = materialize(valid_vectors(vectors))
    queries = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    return search(build_index(v, shard, k + 1), queries, k, beam)


def op2_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
