"""Enrichment behind its interface, the inverted index, stored pages and write policies."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom import warehouse_rules
from newsloom.operators import asked, pages, search, text_index


def files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_nothing_is_asked_twice(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def ask(some):
        if any(a["title"] == "down" for a in some):
            raise OSError("no answer")
        (calls / str(random.random())).write_text("\n".join(sorted(a["title"] for a in some)))
        good = [{"id": a["id"], "title": "T " + a["title"], "summary": "S", "key_points": ["p"], "topic": "cup", "importance": 70} for a in some]
        return [*good, {"id": "nobody", "title": "x", "summary": "y", "key_points": ["p"], "topic": "", "importance": 1}, {**good[0], "title": ""}, "noise"]

    def said():
        return sorted(t for f in calls.iterdir() for t in f.read_text().split("\n"))

    rows = [(0, "a", "e"), (1, "b", "e"), (2, "a", "e"), (3, None, None), (4, "left", "e")]
    df, path = spark.createDataFrame(rows, "seq long, title string, excerpt string").coalesce(1), str(tmp_path / "answers")
    assert [(r.title, r.translated, r.topic) for r in asked.enriched(df, df, path).orderBy("seq").collect()] == [(t, False, None) for _, t, _ in rows] and not said()
    some = df.where("seq < 4")
    for _ in range(2):
        got = {r.seq: (r.title, r.excerpt, r.translated, r.topic, r.key_points, r.importance) for r in asked.enriched(df, some, path, ask).collect()}
        assert got[0] == got[2] == ("T a", "S", True, "cup", ["p"], 70) and got[3][0] == "T " and got[4] == ("left", "e", False, None, None, None)
        assert said() == ["", "a", "b"]
    more = df.unionByName(spark.createDataFrame([(5, "down", "e"), (6, "c", "e")], df.schema)).coalesce(1)
    assert [r.translated for r in asked.enriched(more, more.where("seq IN (1, 5)"), path, ask).orderBy("seq").collect()] == [False, True, False, False, False, False, False]
    assert [r.translated for r in asked.enriched(more, more.where("seq IN (5, 6)"), path, ask, batch=1).orderBy("seq").collect()][5:] == [False, True]
    assert said() == ["", "a", "b", "c"]


def test_answers_keep_to_their_schema():
    fine = {"id": "1", "title": "t", "summary": "s", "key_points": ["p"], "topic": "c", "importance": 0}
    assert asked.accepted_answer(fine, {"1"}) == ("1", "t", "s", ["p"], "c", 0)
    for wrong in ({"id": "2"}, {"title": ""}, {"summary": None}, {"key_points": []}, {"key_points": ["p"] * 4}, {"key_points": [1]}, {"importance": 101}, {"importance": True}, {"importance": "9"}, {"topic": None}, {"title": 3}):
        assert asked.accepted_answer({**fine, **wrong}, {"1"}) is None


def test_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(2)
    words = ["doi", "tuyen", "viet", "nam", "cup", "a", "ab", "abc", "goal", "thang"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 6, 30])))) for i in range(300)] + [(900, None), (901, ""), (902, "x" * 5000), (903, "zz")]
    df, path = spark.createDataFrame(texts, "id long, text string").repartition(4), str(tmp_path / "index")
    text_index.build(df, path, 8)
    terms = {"".join(rng.choice("abcdeghilmnoptuvwxyz ") for _ in range(rng.choice([1, 2, 3]))) for _ in range(40)} | {t[a : a + n] for _, t in texts[:60] for a, n in ((0, 5), (3, 9), (1, 14)) if t} | {"", "xxxx", "viet nam cup", "qqq"}
    asked_for = spark.createDataFrame([(t,) for t in terms] + [(None,), ("cup",), ("cup",)], "term string")
    got = sorted(tuple(r) for r in text_index.holding(df, path, asked_for, 8).collect())
    assert got == sorted((t, i) for t in terms | {"cup"} for i, x in texts if x is not None and t in x)
    may = text_index.candidates(spark, path, spark.createDataFrame([("viet nam cup",), ("qqq",)], "term string"), 8)
    assert may.count() < 304 and may.where("term = 'qqq'").count() == 0
    wishes = [("u", "cup"), ("u", "cup"), ("u", "ab"), ("v", "goal"), ("v", "a"), (None, "cup"), ("w", "nowhere")]
    got = sorted(tuple(r) for r in text_index.relevance(df, path, spark.createDataFrame(wishes, "who string, term string"), 2, 8).collect())
    want = [(u, i, sum(t in x for w, t in wishes if w == u and len(t) >= 2)) for u in "uvw" for i, x in texts if x is not None]
    assert got == sorted(r for r in want if r[2])


@pytest.mark.parametrize("near", [10_000, 0])
def test_pages_by_seeking_equal_pages_by_sorting(spark, tmp_path, monkeypatch, near):
    monkeypatch.setattr(search, "NEAR", near)
    df = spark.range(1003).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("x"), "id").repartition(5)
    order, path = [F.desc("x"), F.col("id")], str(tmp_path / "p")
    pages.store(df, path, order, 16)
    want = sorted(((r.x, r.id) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    for number, at in ((1, 1), (3, 3), (41, 41), (99, 41), (-2, 1)):
        for got in (pages.page(spark, path, order, number, 25), search.paginate(df, order, number, 25)):
            assert [(r.x, r.id, r.page, r.total_pages) for r in got.collect()] == [(*r, at, 41) for r in want[(at - 1) * 25 : at * 25]]
    plan = pages.page(spark, path, order, 20, 25)._jdf.queryExecution().executedPlan().toString()
    ranges = re.findall(r"PartitionFilters: \[[^]]*_range#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert len(ranges) == 1 and len((ranges[0][0] or ranges[0][1]).split(",")) <= 2 < len(files(f"{path}/rows"))
    pages.store(df.where("false"), str(tmp_path / "none"), order, 4)
    assert pages.page(spark, str(tmp_path / "none"), order, 1, 25).count() == 0 and search.paginate(df.where("false"), order, 1, 25).count() == 0


def test_who_may_write(spark):
    rows = spark.createDataFrame([("1", "u", "x"), ("2", "v", "x")], "id string, user_id string, role string")
    n = lambda *a, **k: warehouse_rules.writable(rows, *a, **k).count()
    assert [n("bookmarks", how, "u") for how in ("insert", "delete", "update")] == [1, 1, 0] and n("bookmarks", "insert") == 0
    assert n("teams", "insert", "u") == 0 and n("teams", "delete", admin=True) == 2 and n("ai_jobs", "insert", admin=True) == 0
    stored = spark.createDataFrame([("1", "v", "x"), ("2", "v", "x")], rows.schema)
    assert n("telegram_connections", "update", "u", stored=stored) == 0 and n("telegram_connections", "update", "v", stored=stored) == 1  # a row of another's stays theirs
    p = spark.createDataFrame([("u", "user"), ("v", "admin")], "id string, role string")
    change = lambda role: warehouse_rules.writable(spark.createDataFrame([("u", role)], p.schema), "profiles", "update", "u", stored=p).count()
    assert change("user") == 1 and change("admin") == 0
    with pytest.raises(ValueError):
        n("teams", "drop")
    for table in ("ai_jobs", "ingestion_logs", "admin_audit_logs"):
        assert warehouse_rules.readable({table: rows}, table, "u").count() == 0 and warehouse_rules.readable({table: rows}, table, "u", True).count() == 2


def test_postings_are_gathered_and_short_terms_need_no_texts(spark, tmp_path):
    df, path = spark.createDataFrame([(i, "ab cd" if i % 2 else "ab 𝄞é") for i in range(400)] + [(400, ""), (401, None)], "id long, text string").coalesce(1), str(tmp_path / "index")
    text_index.build(df, path, 2)
    stored = spark.read.parquet(f"{path}/postings")
    assert stored.count() < 100  # a row for each gram of a batch, not for each text that holds it
    assert {r.gram: r.n for r in stored.groupBy("gram").agg(F.sum("n").alias("n")).collect()} == {r.gram: r.n for r in df.select(F.explode(text_index.grams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    terms = spark.createDataFrame([("ab",), ("𝄞é",), ("zz",)], "term string")
    got = text_index.holding(df.withColumn("text", F.lit("gone")), path, terms, 2)
    assert {r.term: r.n for r in got.groupBy("term").agg(F.count("*").alias("n")).collect()} == {"ab": 400, "𝄞é": 200}
