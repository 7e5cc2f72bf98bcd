"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.words import count_words
from newsloom.operators.shared import materialize

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    Sources in code-point order, null last, take the weights in turn and share `share` times
    the whole size. No target passes cap * source_size; the excess goes to the others by
    weight until none is above. That fixed point is target = least(cap * size, level * weight)
    and the level follows from prefix sums over sources sorted by cap * size / weight, so no
    loop is needed. The two unpartitioned windows see one row a source, some 50 bytes each: a million sources are 50 MB.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("turn", turn).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    )
    w = w.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("full_at", F.col("most") / F.col("weight"))
    before = Window.orderBy("full_at", "turn").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    w = w.withColumn(
        "level",
        (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    level = w.where("level <= full_at").agg(F.min(F.struct("full_at", "turn", "level")).alias("x")).select(F.col("x.level").alias("fill"))
    return w.crossJoin(F.broadcast(level)).select(  # one row: the level
        "source", "source_size",
        F.coalesce(F.least("most", F.col("fill") * F.col("weight")), F.col("most")).alias("target"),
    )


def offset(source, seed: str = "mix"):
    """The source's random offset in [0, 1): fixed by the seed, so reruns agree."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("(null)"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """docs (source, doc_id, size in words) -> all its columns plus source_size, target, copies.

    Within a source, documents stand in order of size, then doc_id, then a hash of the row; each expects
    target / source_size copies, a document is emitted once for every integer that the running
    sum of these passes after one random offset is added. Sorting by size makes the taken words,
    not just the copies, follow the target.

    The running sum needs each row's rank in its source. Rows are range-partitioned by
    (source, size, doc_id, hash), so a source with a third of all rows spreads over many tasks; ranks
    are the row's place in its partition plus the rows of its source in earlier partitions,
    taken from a table of one row for each partition and source. The partitioned rows are
    written once, since their places must not change between the two uses.

    Null source is a source of its own, last; documents of size 0 are taken like others of
    their source; a source whose size is 0 takes nothing; repeated rows are rows of their own;
    columns of docs named like the new ones are replaced; an empty table gives an empty result.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # whatever columns come, ours cannot clash
    tie = F.xxhash64(*[F.col(names[f.name]) for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    place = (
        docs.withColumnsRenamed(names)
        .withColumns({"source": F.col(names["source"]), "size": F.col(names["size"]), "id": F.col(names["doc_id"]), "tie": tie})
        .repartitionByRange(F.col("source").asc_nulls_last(), "size", "id", "tie")
        .sortWithinPartitions(F.col("source").asc_nulls_last(), "size", "id", "tie")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", _ROW_BITS))
    )
    placed = materialize(place)
    runs = placed.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    runs = runs.select(F.col("source").alias("s"), F.col("part").alias("p"), "first", "before").join(
        targets.withColumn("u", offset(F.col("source"), seed)), F.col("s").eqNullSafe(F.col("source"))
    ).drop("source")
    # One row for each partition and each source that begins in it; Spark broadcasts it while it is small.
    ranked = placed.drop("size").join(runs, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rank = (F.col("before") + F.col("at") - F.col("first")).cast("double")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor((rank + 1.0) * each + F.col("u")) - F.floor(rank * each + F.col("u"))
    out = ranked.select(*names.values(), "source_size", "target", copies.cast("long").alias("copies"))
    clash = [c for c in docs.columns if c in ("source_size", "target", "copies")]
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in clash], "source_size", "target", "copies")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """docs (doc_id, source, text) in its columns, every row as often as the mix takes it. Null text has size 0."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mixed = mix_sources(docs.select(row, "source", "doc_id", count_words(F.col("text")).alias("size")), **how)
    n = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return mixed.where("copies > 0").select("row", F.explode(n).alias("copy")).select("row.*")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", count_words(F.col("text")).alias("size"))
    return mix_sources(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
t AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s),
w AS (SELECT *, CAST(CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight,
             CAST(source_size AS DOUBLE) * CAST(2 AS DOUBLE) AS most FROM t),
r AS (SELECT *, most / weight AS full_at FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
               - coalesce(sum(most) OVER b, CAST(0 AS DOUBLE)))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER b, CAST(0 AS DOUBLE))) AS lev
      FROM r WINDOW b AS (ORDER BY full_at, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT lev AS fill FROM l WHERE lev <= full_at ORDER BY full_at, turn LIMIT 1),
g AS (SELECT source, source_size, coalesce(least(most, (SELECT fill FROM f) * weight), most) AS target,
             CAST(CAST('0x' || substr(md5('mix:' || coalesce(source, '(null)')), 1, 8) AS BIGINT) AS DOUBLE)
               / CAST(4294967296 AS DOUBLE) AS u
      FROM l),
k AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.u, d.source,
             CASE WHEN g.source_size > 0 THEN g.target / CAST(g.source_size AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS each_,
             CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS DOUBLE) AS rnk
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CAST(floor((rnk + CAST(1 AS DOUBLE)) * each_ + u) - floor(rnk * each_ + u) AS BIGINT) AS copies FROM k)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
"""
