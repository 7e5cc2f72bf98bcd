"""Stored merges, counted runs, sources that fail, and feeds from landed XML to news items."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from newsloom.operators import feed, runs, stored
from newsloom.sources import feeds, landed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merge_inserts_updates_and_deletes(spark, tmp_path):
    path, columns = str(tmp_path / "t"), "k long, v string, w int"
    df = lambda *r: spark.createDataFrame(list(r), columns)
    first = stored.merge(spark, path, df((1, "a", 1), (2, "b", 2), (2, "a", 9), (None, "x", 0)), "k", parts=4)
    assert first["inserted"] == 2 and rows(stored.table(spark, path)) == [(1, "a", 1), (2, "b", 2)]  # of repeated keys the greatest
    before = files(path)
    assert stored.merge(spark, path, df((1, "z", 5), (2, "z", 5)), "k", parts=4) == {"inserted": 0, "updated": 0, "deleted": 0, "written": 0}
    assert files(path) == before
    done = stored.merge(spark, path, df((2, "new", 7), (3, None, None)), "k", ["v"], parts=4)
    assert (done["inserted"], done["updated"]) == (1, 1) and rows(stored.table(spark, path)) == [(1, "a", 1), (2, "new", 2), (3, None, None)]
    again = files(path)
    assert stored.merge(spark, path, df((2, "new", 7), (3, None, 1)), "k", ["v"], parts=4)["written"] == 0 and files(path) == again
    gone = stored.merge(spark, path, df((1, "", 0), (8, "", 0), (3, "c", 3)).withColumn("d", F.col("k") != 3), "k", ["v"], F.col("d"), parts=4)
    assert (gone["deleted"], gone["updated"], gone["inserted"]) == (1, 1, 0) and rows(stored.table(spark, path)) == [(2, "new", 2), (3, "c", None)]
    assert stored.merge(spark, path, df(), "k", ["v"])["written"] == 0


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.create(spark.range(500).select(F.col("id").alias("k"), F.lit("old").alias("v")), path, "k", 16)
    before = files(path)
    done = stored.merge(spark, path, spark.createDataFrame([(7, "new"), (9, "old")], "k long, v string"), "k", ["v"], parts=16)
    assert done == {"inserted": 0, "updated": 1, "deleted": 0, "written": 1} and len(before - files(path)) == 1
    assert stored.table(spark, path).where("v = 'new'").count() == 1 and stored.table(spark, path).count() == 500


def test_toggle(spark, tmp_path):
    path, ids = str(tmp_path / "b"), lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert stored.table(spark, path, "id long").count() == 0
    stored.toggle(spark, path, ids(1, 2, 2, 3), "id", 4)
    stored.toggle(spark, path, ids(2, 4), "id", 4)
    assert rows(stored.table(spark, path)) == [(1,), (3,), (4,)]
    stored.toggle(spark, path, ids(1, 3, 4), "id", 4)
    assert rows(stored.table(spark, path, "id long")) == []


def test_batches_of_a_stream_are_merged_once(spark, tmp_path):
    inbox, path, heard = str(tmp_path / "in"), str(tmp_path / "t"), []
    write = lambda *r: spark.createDataFrame(list(r), "k long, v string").coalesce(1).write.mode("append").parquet(inbox)

    def run(checkpoint):
        stream = spark.readStream.schema("k long, v string").parquet(inbox)
        q = stored.merge_stream(stream, path, "k", ["v"], str(tmp_path / checkpoint), 4, lambda n, c: heard.append((n, c["inserted"], c["updated"])))
        q.awaitTermination()
        assert q.exception() is None

    write((1, "a"), (2, "b"))
    run("ck")
    write((2, "c"), (3, "d"))
    run("ck")
    assert heard == [(0, 2, 0), (1, 1, 1)] and rows(stored.table(spark, path)) == [(1, "a"), (2, "c"), (3, "d")]
    before = files(path)
    run("lost")  # the checkpoint is gone: batch 0 comes again, with everything, and is passed over
    assert len(heard) == 2 and files(path) == before


def test_runs_are_counted_while_they_are_written(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    a = spark.createDataFrame([(0, "x", "1"), (1, "y", "2"), (2, "x", "3"), (3, None, "4")], "seq long, hash string, title string")
    r = runs.ingest(a, "hash", out, "mock", log).first()
    assert (r.provider, r.fetched, r.inserted, r.skipped, r.classified, r.status, r.error) == ("mock", 4, 3, 1, 3, "success", None)
    assert r.started_at <= r.completed_at and rows(spark.read.parquet(out).select("hash", "title")) == sorted([("x", "3"), ("y", "2"), (None, "4")], key=str)
    broken = a.withColumn("title", F.when(F.col("seq") == 2, F.raise_error(F.lit("cannot be read"))).otherwise(F.col("title")))
    r = runs.ingest(broken, "hash", out, "mock", log).first()
    assert (r.status, r.fetched, r.inserted) == ("failed", 0, 0) and r.error and spark.read.parquet(out).count() == 3
    assert sorted(x.status for x in runs.log_of(spark, log).collect()) == ["failed", "success"]


def test_runs_of_a_stream_are_logged(spark, tmp_path):
    inbox, heard = str(tmp_path / "in"), []
    listener = runs.RunListener(heard.append)
    spark.streams.addListener(listener)
    try:
        for n in (3, 2):
            spark.range(n).write.mode("append").parquet(inbox)
            q = runs.ingest_stream(spark.readStream.schema("id long").parquet(inbox), str(tmp_path / "out"), str(tmp_path / "ck"), "pages")
            q.awaitTermination()
        bad = spark.readStream.schema("id long").parquet(inbox).where(F.raise_error(F.lit("no")).cast("boolean"))
        with pytest.raises(Exception, match="no"):
            runs.ingest_stream(bad, str(tmp_path / "bad"), str(tmp_path / "ck2"), "broken").awaitTermination()
        until = time.time() + 20
        while len(heard) < 3 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [(r[0], r[1], r[7]) for r in heard] == [("pages", 3, "success"), ("pages", 2, "success"), ("broken", 0, "failed")]
    assert spark.createDataFrame(heard, runs.LOG).count() == 3


def test_sources_that_fail_are_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1}\n{"n": 2}\n')
    (tmp_path / "b.json").write_bytes(b"\xff\xfe broken")
    sources = [("a", str(tmp_path / "a.json")), ("b", str(tmp_path / "b.json")), ("c", str(tmp_path / "none.json")), ("d", "http://127.0.0.1:9/")]
    good, bad = landed.read_sources(spark, sources, timeout=5)
    assert rows(landed.json_rows(good, "n int")) == [("a", 0, 1), ("a", 0, 2)]
    failed = {r.source: (r.place, r.attempts, r.error) for r in bad.collect()}
    assert sorted(failed) == ["b", "c", "d"] and all(f[1] == 2 and f[2] for f in failed.values()) and "Decode" in failed["b"][2]
    with pytest.raises(RuntimeError, match="no source could be read"):
        landed.read_sources(spark, sources[1:3])
    assert landed.read_sources(spark, [])[0].count() == 0


def test_a_slow_source_is_left_after_its_time(monkeypatch):
    monkeypatch.setattr(landed, "_bytes", lambda url, timeout: time.sleep(1))
    began = time.time()
    got = landed.fetch(landed.OneSource(3, "slow", "x"), 2, 0.1)
    assert got == ("slow", 3, 0, None, "no answer within 0.1 s", 2) and time.time() - began < 0.9


def test_sources_are_polled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    stream = landed.poll_sources(spark, [("a", str(tmp_path / "a.txt")), ("b", str(tmp_path / "b.txt"))], polls=3)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
    until = time.time() + 60
    while time.time() < until and (q.lastProgress is None or (q.lastProgress["sources"][0]["endOffset"] or {}) != {"polls": 3}):
        (tmp_path / "b.txt").write_text("late")
        time.sleep(0.2)
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.where("source = 'a'").select("poll", "body")) == [(0, "one"), (1, "one"), (2, "one")]
    assert got.where("source = 'b'").count() == 3


def test_feeds_from_xml_to_news_items(spark, tmp_path):
    """Three feeds, one of which cannot be read: articles in feed order, then clusters and news items of them."""
    day = "<pubDate>Mon, 13 Jul 2026 {:02}:00:00 GMT</pubDate>"
    item = lambda t, u, h, more="": f"<item><title>{t}</title><link>{u}</link>{day.format(h)}{more}</item>"
    many = "".join(item(f"Other topic number {n} entirely", f"https://a/{n}", 1) for n in range(20))
    vi = item("Đội tuyển Việt Nam thắng đậm", "https://a/x", 9, "<description>Chi tiết &lt;b&gt;đầy&lt;/b&gt; đủ</description><guid>g-1</guid>") + item("", "https://a/none", 9) + many
    (tmp_path / "vi.xml").write_text(f"<rss><channel>{vi}</channel></rss>")
    (tmp_path / "one.xml").write_text(f"<rss><channel>{item('Doi tuyen Viet Nam thang dam that', 'https://b/1', 10)}</channel></rss>")
    atom = '<entry><title>Lone entry</title><link href="https://c/1"/><updated>2026-07-13T08:00:00Z</updated></entry>'
    (tmp_path / "atom.xml").write_text(f"<feed>{atom}</feed>")
    names = ["vi", "gone", "one", "atom"]
    registry = spark.createDataFrame([(n, f"https://{n}.example", 90 - i, "en" if n == "one" else "vi", None) for i, n in enumerate(names)], "name string, url string, reliability int, language string, official boolean")
    good, bad = landed.read_sources(spark, [(n, str(tmp_path / f"{n}.xml")) for n in names])
    assert [r.source for r in bad.collect()] == ["gone"]
    now = F.lit("2026-07-14 00:00:00").cast("timestamp")
    arts = feeds.feed_articles(good, registry, now)
    got = {r.seq: r for r in arts.collect()}
    assert sorted(got) == [0, *range(2, 16), 32, 48] and got[0].excerpt == "Chi tiết đầy đủ" and got[48].title == "Lone entry" and got[0].source == "vi"
    items = {r.title: r for r in feed.news_items(arts, "2026-07-14 00:00:00").collect()}
    lead = items["Doi tuyen Viet Nam thang dam that"]
    assert lead.sources == ["one", "vi"] and lead.id == f"rss-{got[32].id}" and lead.key_points == [feeds.NO_EXCERPT, "Đội tuyển Việt Nam thắng đậm"]
    assert (lead.category, lead.competition, lead.team) == ("Thể thao · Quốc tế", "Bóng đá quốc tế", "Bóng đá quốc tế")
    given = arts.where("seq = 32").withColumns({"topic": F.lit("AFF Cup"), "key_points": F.array(F.lit("p" * 200), F.lit("q"), F.lit("r"), F.lit("s")), "importance": F.lit(95)})
    r = feed.news_items(given, "2026-07-14 00:00:00").first()
    assert (r.category, r.competition, r.team) == ("AFF Cup · Quốc tế", "AFF Cup", "Bóng đá quốc tế") and r.key_points == ["p" * 200, "q", "r"]
    plain = feed.news_items(arts.where("seq = 32"), "2026-07-14 00:00:00").first()
    assert r.hotness > plain.hotness


def test_registry_of_an_object_is_a_list(spark):
    assert feeds.feed_registry(spark, '{"name": "A", "url": "https://a"}').count() == 0  # its parts between commas are no addresses
    assert dt.datetime(2026, 1, 1) and feeds.feed_registry(spark, "3, https://b.example").first().url == "https://b.example"
