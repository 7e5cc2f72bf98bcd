"""Stories by classes, on streams and in slices, against plain Python and the batch query."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from newsloom.operators import clustering, feed, incremental, similarity
from newsloom.streaming import stories

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "seq long, published timestamp_ntz, tok array<string>"


def written(n=90, seed=5, hours=400, words=14, repeat=0.4):
    """Articles over some days, many with titles that others have, some at the same time."""
    rng = random.Random(seed)
    vocabulary, out = [f"w{i:02d}" for i in range(words)], []
    for i in range(n):
        tok = list(rng.choice(out)[2]) if out and rng.random() < repeat else rng.sample(vocabulary, rng.randint(0, 6))
        out.append((i, T0 + dt.timedelta(hours=rng.randrange(hours)), tok))
    return out


def same(x, y):
    shared = len(set(x[2]) & set(y[2]))
    return abs((x[1] - y[1]).total_seconds()) <= 72 * 3600 and shared >= 3 and shared / max(1, min(len(x[2]), len(y[2]))) >= 0.52


def alike(x, y):
    shared, both = len(set(x[2]) & set(y[2])), len(set(x[2]) | set(y[2]))
    return abs((x[1] - y[1]).total_seconds()) <= 48 * 3600 and both > 0 and shared / both >= 0.55


def greedy(arts):
    found = []
    for a in sorted(arts, key=lambda a: (-a[1].timestamp(), a[0])):
        home = next((c for c in found if any(same(a, b) for b in c)), None)
        home.append(a) if home else found.append([a])
    return sorted((a[0], c[0][0], n) for c in found for n, a in enumerate(c, 1))


def pairs(arts, rule):
    return sorted((x[0], y[0], len(set(x[2]) & set(y[2]))) for x in arts for y in arts if x[0] < y[0] and rule(x, y))


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def test_pairs_and_clusters_of_repeated_titles(spark):
    arts = written()
    df = spark.createDataFrame(arts, SCHEMA)
    assert listed(similarity.same_story(df)) == pairs(arts, same)
    assert listed(similarity.likely_duplicates(df)) == pairs(arts, alike)
    assert listed(clustering.story_clusters(df)) == greedy(arts)


def test_many_equal_titles_are_chained(spark):
    """20,000 equal titles: all pairs would be 2 * 10^8."""
    n = 20_000
    arts = spark.range(n).selectExpr("id AS seq", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id % 5000 AS INT)) AS published", "array('one', 'two', 'three') AS tok")
    began = time.time()
    got = clustering.story_clusters(arts)
    assert {r.cluster for r in got.select("cluster").distinct().collect()} == {4999} and got.count() == n
    assert time.time() - began < 60


def joins(df):
    """The joins of a plan that is not run."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]


@pytest.mark.parametrize("rule", [similarity.same_story, similarity.likely_duplicates, clustering.story_clusters])
def test_no_join_of_stories_is_gathered_by_the_driver(spark, rule):
    found = joins(rule(spark.createDataFrame(written(30), SCHEMA)))
    assert found and not [line for line in found if "Broadcast" in line]


def test_alike_classes_have_no_more_links_than_members(spark):
    """Two titles alike, 400 articles each within three days: all pairs would be 160,000."""
    arts = [(i, T0 + dt.timedelta(minutes=5 * i), ["one", "two", "three", "four" if i % 2 else "five"]) for i in range(800)]
    df = spark.createDataFrame(arts, SCHEMA)
    assert similarity.story_links(df).count() <= 2 * len(arts)
    assert {r.cluster for r in clustering.story_clusters(df).collect()} == {799}


def test_long_titles_meet_as_numbers(spark):
    """Titles of 200 words go by number and outline; before, each of their words carried all the others."""
    arts = [(i, T0, [f"w{j}" for j in range(i, i + 200)]) for i in range(0, 120, 20)]
    s = similarity.Stories(spark.createDataFrame(arts, SCHEMA), 72)
    assert dict(s.sets.dtypes)["ids"] == "array<bigint>" and "tok" not in s.sets.columns
    assert listed(similarity.same_story(spark.createDataFrame(arts, SCHEMA))) == pairs(arts, same)


@pytest.mark.parametrize("seed", [1, 2])
def test_slices_in_any_order_equal_one_run(spark, tmp_path, seed):
    arts = written(70, seed, 500)
    order = sorted(arts, key=lambda a: -a[1].timestamp()) if seed == 1 else random.Random(seed).sample(arts, len(arts))
    path, seen = str(tmp_path / "stories"), []
    for i in range(5):
        some = order[i * 14 : (i + 1) * 14]
        seen += some
        done = incremental.load(spark, path, spark.createDataFrame(some, SCHEMA))
        assert done["articles"] == 14
        if i in (1, 4):
            assert listed(incremental.clusters(spark, path)) == greedy(seen)


def test_a_slice_touches_the_days_around_it(spark, tmp_path):
    path, tok = str(tmp_path / "stories"), ["one", "two", "three"]
    old = [(i, T0 + dt.timedelta(days=10 * i), tok) for i in range(6)]
    incremental.load(spark, path, spark.createDataFrame(old, SCHEMA))

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/labels") for f in names if f.endswith(".parquet")}

    before = files()
    again = incremental.load(spark, path, spark.createDataFrame(old[:2], SCHEMA))
    assert again == {"articles": 0, "links": 0, "labels": 0, "days": 0} and files() == before
    done = incremental.load(spark, path, spark.createDataFrame([(9, T0 + dt.timedelta(days=21), tok), (9, T0 + dt.timedelta(days=21), tok), (10, None, tok), (11, T0, None)], SCHEMA))
    assert done == {"articles": 2, "links": 1, "labels": 3, "days": 3}
    assert len(before & files()) == 4  # those of days 0 and 20 are new: an article without tokens, and one that got a newer head
    assert [(s, c) for s, c, _ in listed(incremental.clusters(spark, path))] == [(0, 0), (1, 1), (2, 9), (3, 3), (4, 4), (5, 5), (9, 9), (11, 11)]
    assert incremental.load(spark, path, spark.createDataFrame([], SCHEMA))["articles"] == 0


def replay(spark, tmp_path, slices, rule):
    """Slices come one after the other; the stream starts anew for each."""
    inbox, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), []
    for some in slices:
        spark.createDataFrame(some, SCHEMA.replace("timestamp_ntz", "timestamp")).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SCHEMA.replace("timestamp_ntz", "timestamp")).parquet(inbox)
        q = stories.append(rule(stream), out, str(tmp_path / "ck"))
        progress += q.recentProgress
    return listed(spark.read.parquet(out)), progress


def test_stream_of_pairs_equals_batch(spark, tmp_path):
    arts = sorted(written(60, 7), key=lambda a: a[1])
    slices = [arts[:20], arts[20:40], arts[40:]]
    got, progress = replay(spark, tmp_path / "story", slices, stories.same_story_stream)
    assert got == pairs(arts, same) and got
    held = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]]
    assert held[-1] < max(held)  # what lies further back than the interval leaves the state
    got, _ = replay(spark, tmp_path / "dup", slices, stories.likely_duplicates_stream)
    assert got == pairs(arts, alike) and got


def test_late_rows_are_dropped_by_rule(spark, tmp_path):
    tok = ["one", "two", "three"]
    first = [(1, T0, tok), (2, T0 + dt.timedelta(hours=100), tok)]
    late = [(3, T0 + dt.timedelta(hours=1), tok), (4, T0 + dt.timedelta(hours=99, minutes=30), tok)]
    got, _ = replay(spark, tmp_path, [first, late], stories.same_story_stream)
    assert got == [(2, 4, 3)]  # 3 is further back than the delay, so it meets nothing; 4 is not


@pytest.mark.parametrize("rule, hours, brute", [(similarity.same_story, 72, same), (similarity.likely_duplicates, 48, alike)])
def test_stored_pairs_need_no_state(spark, tmp_path, rule, hours, brute):
    arts = sorted(written(60, 7), key=lambda a: a[1])
    late = (90, arts[-1][1] - dt.timedelta(hours=2), arts[-1][2])
    inbox, path, schema = str(tmp_path / "in"), str(tmp_path / "stored"), SCHEMA.replace("timestamp_ntz", "timestamp")
    for some in (arts[:30], arts[30:], [late]):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(inbox)
        q = stories.store_pairs(spark.readStream.schema(schema).parquet(inbox), path, str(tmp_path / "ck"), rule, hours)
        assert not q.lastProgress["stateOperators"]
    got = listed(stories.stored_pairs(spark, path))
    assert got == pairs(arts, brute) and got


def test_labels_of_long_chains_take_few_steps(spark, tmp_path, monkeypatch):
    """A late article is linked to the second newest of a chain only: all older ones change, 12 links far."""
    one, other = ["one", "two", "three"], ["p", "q", "r"]
    arts = [(i, T0 + dt.timedelta(hours=60 * i), one + other if i == 11 else one) for i in range(13)]
    late, steps, step = (20, T0 + dt.timedelta(hours=726), other), [], incremental._handed_on
    monkeypatch.setattr(incremental, "_handed_on", lambda *a: steps.append(1) or step(*a))
    for some in (arts, [late]):
        incremental.load(spark, str(tmp_path / "s"), spark.createDataFrame(some, SCHEMA))
    assert listed(incremental.clusters(spark, str(tmp_path / "s"))) == greedy([*arts, late])
    assert len(steps) <= incremental.HOPS


def late_way():
    """Articles 0 to 50 reach 600 by 70 and the long chain after it alone, which is known when they all have 60, the newest of their own class."""
    first, last = ["one", "two", "three"], ["p", "q", "r"]
    own = [(i, T0 + dt.timedelta(hours=i), first) for i in range(61)]
    chain = [(100 + i, T0 + dt.timedelta(hours=52, minutes=i), last) for i in range(500)]
    return own, [(70, T0 + dt.timedelta(hours=51), first + last), *chain, (600, T0 + dt.timedelta(hours=100), last)]


def test_labels_go_along_a_class_in_one_round(spark, monkeypatch):
    """Before, they went link by link, 50 rounds."""
    arts, written_, write = sum(late_way(), []), [], clustering.materialize
    monkeypatch.setattr(clustering, "materialize", lambda df: written_.append(1) or write(df))
    got = listed(clustering.story_clusters(spark.createDataFrame(arts, SCHEMA)))
    assert got == greedy(arts) and {c for _, c, _ in got} == {60, 600}
    assert len(written_) <= 12


def test_slices_go_along_a_class_in_one_round(spark, tmp_path, monkeypatch):
    """The same in a slice that is loaded; then all stored labels change by a newer article."""
    own, others = late_way()
    late = [(601, T0 + dt.timedelta(hours=150), others[-1][2])]
    written_, write, path = [], clustering.materialize, str(tmp_path / "s")
    monkeypatch.setattr(clustering, "materialize", lambda df: written_.append(1) or write(df))
    for some in (own + others, late):
        incremental.load(spark, path, spark.createDataFrame(some, SCHEMA))
    assert listed(incremental.clusters(spark, path)) == greedy(own + others + late)
    assert len(written_) <= 30


def test_short_titles_meet_few_long_ones(spark):
    """Titles of 150 words seemed to hold most words of short ones, so nearly all that have one in common were compared as sets."""
    rng = random.Random(3)
    words = [f"v{i}" for i in range(600)]
    arts = [(i, T0, rng.sample(words, 150 if i % 2 else 8)) for i in range(120)]
    s = similarity.Stories(spark.createDataFrame(arts, SCHEMA), 72)
    met = s.met(lambda n: n - similarity.needed(n, 0.52, 3) + 1, lambda n: n, similarity._smaller(), similarity.needed(F.col("na"), 0.52, 3))
    assert met.where("na = 8 AND nb = 150").count() < 600  # of 3600
    assert listed(similarity.same_story(spark.createDataFrame(arts, SCHEMA))) == pairs(arts, same)


def test_a_batch_of_pairs_frees_its_shuffles(spark, tmp_path):
    schema, seen = SCHEMA.replace("timestamp_ntz", "timestamp"), []
    spark.createDataFrame(written(20), schema).write.parquet(str(tmp_path / "in"))

    def rule(df, hours):
        seen.append(df.sparkSession.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false"))
        return similarity.same_story(df, hours)

    stories.store_pairs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "stored"), str(tmp_path / "ck"), rule, 72)
    assert seen == ["true"]


def test_feed_takes_few_rounds(spark, monkeypatch):
    rows = [(i, " ".join(w * 3 for w in tok), "", f"u{i}", at, "en", "src1", 80, True) for i, at, tok in sum(late_way(), [])]
    articles = spark.createDataFrame(rows, "seq long, title string, excerpt string, url string, published timestamp_ntz, language string, source string, reliability int, official boolean")
    written_, write = [], clustering.materialize
    monkeypatch.setattr(clustering, "materialize", lambda df: written_.append(1) or write(df))
    assert sorted((r.seq, len(r.source_details)) for r in feed.feed(articles).collect()) == [(60, 10), (600, 553)]
    assert len(written_) <= 12
