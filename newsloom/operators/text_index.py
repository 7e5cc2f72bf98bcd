"""F01, J06, J07 by an inverted index: which texts hold a term, without reading those that cannot.

The index has a row for each different run of one, two or three characters of a text. A term's rarest such runs name the
texts that may hold it, and only those are read and looked through. Many terms are one join, so users with their terms are
a table and not a list of literals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.shared import apart

GRAM, RAREST = 3, 2
BUCKETS = 64


def grams(text: Column, sizes: tuple[int, ...] = (1, 2, GRAM)) -> Column:
    """The different runs of so many characters."""

    def runs(c: Column, n: int) -> Column:
        last = F.size(c) - n + 1
        each = lambda i: F.concat(*[F.element_at(c, i + F.lit(k)) for k in range(n)])
        return F.transform(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), each)

    characters = F.filter(F.split(text, ""), lambda c: c != "")  # an array, since a place in a string is found by counting from its start
    one = F.transform(F.array(characters), lambda c: F.array_distinct(F.concat(*[runs(c, n) for n in sizes])))
    return F.get(one, F.lit(0))  # as an argument of a lambda the text is made once


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of id, text -> gram, ids: those of a batch that hold it, once each. A gram is a number of 21 bits a character while it is sorted."""
    for batch in batches:
        each = [np.empty(0, np.uint64)]
        for text in batch.column(1).to_pylist():
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
            runs = [c]
            for k in range(1, GRAM):
                runs.append(runs[-1][: max(0, len(c) - k)] | (c[k:] << np.uint64(21 * k)))
            each.append(np.unique(np.concatenate(runs)))
        grams_, rows = np.concatenate(each), np.repeat(np.arange(-1, len(each) - 1), [len(e) for e in each])
        order = np.argsort(grams_, kind="stable")
        found, starts = np.unique(grams_[order], return_index=True)
        points = np.stack([(found >> np.uint64(21 * k)) & np.uint64(0x1FFFFF) for k in range(GRAM)], 1).tolist()
        names = pa.array(["".join(chr(p - 1) for p in ps if p) for ps in points], pa.string())
        for low in range(0, len(names), 4096):  # bounded batches on the way back
            high = min(low + 4096, len(names))
            ends = np.append(starts, len(order))[low : high + 1]
            ids = batch.column(0).take(pa.array(rows[order[ends[0] : ends[-1]]]))
            offsets = pa.array((ends - ends[0]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([names[low:high], pa.ListArray.from_arrays(offsets, ids)], ["gram", "ids"])


def build(texts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """texts (id, text) -> the index at path: postings (gram, ids) in buckets of grams, sorted, and how many texts hold a gram.

    A row has the ids of one Arrow batch of texts, so a frequent gram has many rows, which are dealt over its bucket's tasks.
    Null texts hold nothing.
    """
    kind = texts.schema["id"].dataType.simpleString()
    each = texts.where(F.col("text").isNotNull()).select("id", "text").mapInArrow(_postings, f"gram string, ids array<{kind}>")
    each = each.withColumns({"n": F.size("ids").cast("long"), "bucket": F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")})
    dealt = each.repartition(F.col("bucket"), F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(8)))
    dealt.sortWithinPartitions("bucket", "gram").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    each.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum("n").alias("texts")).write.parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """terms (term) -> term, id: the texts that hold the term's RAREST rarest grams. Terms are different and not empty."""
    parts = F.filter(grams(F.col("term")), lambda g: F.length(g) == F.least(F.length(F.col("term")), F.lit(GRAM)))
    each = terms.select("term", F.explode(parts).alias("gram"))
    known = each.join(spark.read.parquet(f"{path}/counts"), "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))  # a gram that no text holds is the rarest
    rare = known.groupBy("term").agg(F.slice(F.array_sort(F.collect_list(F.struct("texts", "gram"))), 1, RAREST).alias("rare"))
    wanted = rare.select("term", F.size("rare").alias("needed"), F.explode("rare").alias("r")).select("term", "needed", F.col("r.gram").alias("gram"))
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    met = spark.read.parquet(f"{path}/postings").join(wanted, ["bucket", "gram"])  # both sides say the bucket, so it can be pruned
    met = met.select("term", "needed", F.explode("ids").alias("id"))
    return met.groupBy("term", "id").agg(F.count("*").alias("held"), F.max("needed").alias("needed")).where("held = needed").select("term", "id")


def holding(texts: DataFrame, path: str, terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """texts (id, text), the index of them at path, terms (term) -> term, id: every text that holds the term.

    The empty term is in every text that is not null; a null term in none; terms that repeat count once.
    """
    asked = terms.select("term").where(F.col("term").isNotNull()).distinct()
    short = F.length("term") <= GRAM  # a gram itself, so the index alone tells who holds it
    found = candidates(texts.sparkSession, path, asked.where("term <> ''").where(short), buckets)
    if asked.where(~short).limit(1).count():
        may = candidates(texts.sparkSession, path, asked.where(~short), buckets)
        found = found.unionAll(apart(may).join(texts.select("id", "text"), "id").where(F.contains("text", "term")).select("term", "id"))
    if asked.where("term = ''").limit(1).count():
        found = found.unionAll(texts.where(F.col("text").isNotNull()).select(F.lit("").alias("term"), "id"))
    return found


def relevance(texts: DataFrame, path: str, wishes: DataFrame, least: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Wishes (who, term; folded) -> who, id, relevance: how many of one's terms a text holds; repeated terms count as often.

    Terms shorter than `least` do not count; texts that hold none have no row. Terms are looked up once for all who share them.
    """
    mine = wishes.where((F.length("term") >= least) & F.col("who").isNotNull()).groupBy("who", "term").agg(F.count("*").alias("times"))
    found = holding(texts, path, mine.select("term"), buckets)
    return mine.join(found, "term").groupBy("who", "id").agg(F.sum("times").alias("relevance"))
