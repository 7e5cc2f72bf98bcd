"""Last rows of keys on a stream, and reads of a database that leave work to it."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from newsloom.operators import dedupe, stored
from newsloom.sources import database
from newsloom.streaming import latest


def test_last_rows_after_every_order_of_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), f"v{i}") for i in range(24)]
    df = spark.createDataFrame(rows, "seq long, k string, v string")
    want = sorted((r.k, r.seq, r.v, r.first_seq) for r in dedupe.last_wins(df.where("k IS NOT NULL"), "k").collect())
    batches = [rows[:8], rows[8:16], rows[16:]]
    for n, order in enumerate(itertools.islice(itertools.permutations(range(3)), 1, 6, 2)):
        inbox, path, ck = (str(tmp_path / f"{n}-{x}") for x in ("in", "t", "ck"))
        for i in order:  # the stream starts anew, from its checkpoint, for each
            spark.createDataFrame(batches[i], df.schema).coalesce(1).write.mode("append").parquet(inbox)
            assert latest.store_latest(spark.readStream.schema(df.schema).parquet(inbox), path, "k", ck, parts=2).exception() is None
        assert sorted((r.k, r.seq, r.v, r.first_seq) for r in stored.table(spark, path).collect()) == want


def test_only_changes_are_given_and_idle_keys_leave(spark, tmp_path):
    """The stream polls, as a state with a time to live wants it; a key that nothing came for begins anew."""
    inbox, heard, until = str(tmp_path / "in"), [], time.time() + 180
    write = lambda *r: spark.createDataFrame(list(r), "seq long, k string").coalesce(1).write.mode("append").parquet(inbox)

    def settled(n):
        while len(heard) < n and time.time() < until:
            time.sleep(0.2)
        time.sleep(1)
        return sorted(heard, key=str)

    write((5, "a"), (3, "a"), (1, None))
    with latest.rocksdb(spark):
        out = latest.last_wins_stream(spark.readStream.schema("seq long, k string").parquet(inbox), "k", ttl_seconds=30)
        q = out.writeStream.outputMode("update").foreachBatch(lambda b, n: heard.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    try:
        assert settled(2) == [(1, None, 1), (5, "a", 3)]
        write((4, "a"), (None, "a"), (2, "b"))
        assert settled(3) == [(1, None, 1), (2, "b", 2), (5, "a", 3)]  # 4 is neither first nor last
        time.sleep(34)
        write((1, "a"))
        assert (1, "a", 1) in settled(4)
    finally:
        q.stop()


@pytest.fixture(scope="module")
def notes(spark):
    """A database in this JVM's memory, with notes."""
    url, n = "jdbc:derby:memory:notes;create=true", 300
    rows = spark.range(n).select(F.col("id").alias("note_id"), F.pmod(F.xxhash64("id"), F.lit(40)).alias("made"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"))
    rows.write.format("jdbc").options(url=url, dbtable="notes").mode("overwrite").save()
    return url, rows


def test_database_does_its_part(spark, notes):
    url, rows = notes
    want = sorted(((r.note_id, r.made, r.title) for r in rows.collect()), key=lambda r: (-r[1], -r[0]))[:20]
    got = database.newest(spark, url, "notes", ["made", "note_id"])
    assert [tuple(r) for r in got.collect()] == want
    assert [tuple(r) for r in database.newest(spark, url, "notes", ["made", "note_id"], 3).collect()] == want[:3]
    assert database.one(spark, url, "notes", "note_id", 7, "title") == ("t7",)
    for key, value in (("note_id", 999), ("made", want[0][1])):
        with pytest.raises(ValueError, match="rows of notes"):
            database.one(spark, url, "notes", key, value, "title")
    plan = database.table(spark, url, "notes").where("note_id = 7").select("title")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(note_id), *EqualTo(note_id,7)]" in plan and "ReadSchema: struct<title:string>" in plan


def test_database_is_read_in_ranges(spark, notes):
    url, rows = notes
    got = database.table(spark, url, "notes", "note_id", 5)
    assert got.rdd.getNumPartitions() == 5 and sorted(r.note_id for r in got.collect()) == list(range(300))
    assert database.table(spark, url, "(SELECT * FROM notes WHERE \"note_id\" < 0) x", "note_id", 5).collect() == []


def test_the_table_is_the_state(spark, tmp_path):
    """Keys are combined and joined, none is handled alone; a batch may come again."""
    inbox, path, schema = str(tmp_path / "in"), str(tmp_path / "t"), "seq long, k string, v string"
    for n, rows in enumerate([[(5, "a", "new"), (9, "b", None), (4, None, "x")], [(2, "a", "old"), (12, "b", "last"), (None, "a", "y")], [(2, "a", "old"), (7, "c", "one")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        q = latest.store_latest(spark.readStream.schema(schema).parquet(inbox), path, "k", str(tmp_path / "ck"), parts=2)
        assert not q.lastProgress["stateOperators"]
    assert sorted(tuple(r) for r in stored.table(spark, path).select("k", "seq", "v", "first_seq").collect()) == [("a", 5, "new", 2), ("b", 12, "last", 9), ("c", 7, "one", 7)]
