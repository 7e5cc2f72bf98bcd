"""Neighbours, licenses, toxicity and language-model scores against brute force or held-out rows."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import licenses, lmscore, neighbours, toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def brute_nearest(rows, k=20):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    return {
        q: sorted(((-float(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q])))[:k] for q in fine if q % 20 == 0
    }


@tables
@pytest.mark.parametrize("shard", [8192, 120])
def test_recall(spark, shard):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in neighbours.nearest(vectors, shard=shard).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute_nearest([(r.vec_id, r.embedding) for r in vectors.collect()])
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        exact = {i: -s for s, i in brute_nearest([(r, v) for r, v in []]).get(q, [])} or {i: -s for s, i in best}
        assert sorted(got[q]) == list(range(1, 21))
        order = [got[q][r] for r in range(1, 21)]
        assert order == sorted(order, key=lambda x: (-x[1], x[0]))
        assert all(math.isclose(s, exact[i], rel_tol=1e-12) for i, s in order if i in exact)
        hits += len({i for i, _ in order} & set(exact))
    assert hits >= 0.95 * 20 * len(want)


def test_ids_that_repeat_lose_no_neighbours(spark):
    """58 ids beside one that stands in 31 nearly equal vectors, and another one asked with two vectors that are far apart."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(20, (base + 1e-4 * rng.normal(size=8)).tolist()) for _ in range(31)]
    rows += [(100 + i, (base + 0.3 * rng.normal(size=8)).tolist()) for i in range(58)]
    rows += [(40, base.tolist()), (40, (-base).tolist())]
    want = {}
    for q in {i for i, _ in rows if i % 20 == 0}:
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max([float(np.dot(v, w)) for j, w in rows if j == q] + [best.get(i, -np.inf)])
        want[q] = [i for i, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]]
    for beam in (112, 24):
        got = {}
        for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), beam=beam).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert set(got) == set(want) and len(want) == 5 and all(len(x) == len(set(x)) == 20 and q not in x for q, x in got.items())
        missed = sum(len(set(want[q]) - set(x)) for q, x in got.items())
        assert missed == 0 if beam == 112 else missed <= 10


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, [nan, 1.0]), (60, None), (80, [inf, 1.0]), (100, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(i, [1.0, 0.0]) for i in range(1, 45) if i not in (20, 40)] + [(120, [2.0, 1.0]), (121, [-1.0, 0.0]), (140, [1.0, 2.0, 3.0])]
    got = {}
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, dim int")
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in brute_nearest(rows).items() if x}
    assert neighbours.nearest(df.where("false")).count() == 0


def test_alignment():
    rng = random.Random(4)
    for _ in range(200):
        t = [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
        x = [w for w in t if rng.random() < 0.8] + [rng.choice("abcxyz") for _ in range(rng.randrange(4))]
        pairs = licenses.align(x, t)
        assert all(x[i] == t[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
    t = [f"w{i}" for i in range(50)]
    assert licenses.align(["q"] + t[:20] + ["z"] + t[21:], t) == [(i + 1, i) for i in range(50) if i != 20]


def test_licenses(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0 notice"]
    filler = " ".join(f"word{i}" for i in range(300))
    cut = " ".join(mit.split()[:-8]).upper()
    docs = [(1, f"{filler} {mit} {filler}"), (2, cut), (3, " ".join(mit.split()[:40])), (4, None), (5, ""), (6, f"{apache} {filler} " * 300), (6, filler), (7, "the license of software " * 200)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, licenses string")
    got = sorted((r.doc_id, r.n_words, [(x.license, round(x.coverage, 2)) for x in r.licenses]) for r in licenses.scan_licenses(df).collect())
    found = [(d, names) for d, _, names in got]
    n = len(licenses.words_of(mit.encode()))
    assert found[0] == (1, [("MIT", 1.0)])
    assert found[1] == (2, [("MIT", round(len(licenses.words_of(cut.encode())) / n, 2))])
    assert [names for d, names in found if d in (3, 4, 5, 7)] == [[]] * 4
    assert sorted(names for d, names in found if d == 6) == [[], [("Apache-2.0 notice", 1.0)] * 300]
    begin = next(x for r in licenses.scan_licenses(df.where("doc_id = 1")).collect() for x in r.licenses)
    assert (begin.begin, begin.end) == (300, 300 + n)
    assert licenses.scan_licenses(df.where("false")).count() == 0


def test_every_copy_and_every_template_is_listed():
    filler = [f"word{i}" for i in range(50)]
    everything = licenses.templates_of(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        own = licenses.words_of(text.encode())
        once = licenses.scan(licenses.words_of(" ".join([*filler, text, *filler]).encode()), everything)
        assert once == [(name, 1.0, 50, 50 + len(own))], (name, once)
        for between in (filler, []):  # two copies, apart and one right after the other
            twice = licenses.scan(licenses.words_of(" ".join([text, *between, text]).encode()), everything)
            assert [x[:2] for x in twice] == [(name, 1.0)] * 2, (name, twice)
    nc = licenses.scan(licenses.words_of(b"Licensed under CC BY-NC 4.0."), everything)
    assert [x[0] for x in nc] == ["CC-BY-NC-4.0 notice"]


def test_license_filters_leave_out_nothing():
    """Copies with altered telling words, at random and in one run, against alignment without a filter."""
    rng = random.Random(7)
    filler = [b"word%d" % i for i in range(200)]
    met = Counter()
    for t in licenses.templates_of(licenses.TEMPLATES):
        places = [i for i, w in enumerate(t.words) if w in t.telling]
        for coverage in (0.8, 0.5):
            for n in range(0, len(places), max(1, len(places) // 30)):
                for run in (False, True):
                    a = rng.randrange(len(places) - n + 1)
                    gone = set(places[a : a + n] if run else rng.sample(places, n))
                    words = filler + [b"altered" if i in gone else w for i, w in enumerate(t.words)] + filler
                    whole = len(licenses.align(words, t.words)) / len(t.words)
                    got = [x[1] for x in licenses.scan(words, [t], coverage)]
                    assert got == ([whole] if whole >= coverage else []), (t.name, coverage, n, run)
                    met[bool(got)] += 1
    assert met[True] > 100 and met[False] > 100


@pytest.mark.parametrize("inserted", ["unknown", "common", "of licenses"])
def test_words_put_into_a_copy_hide_it_nowhere(inserted):
    """Copies with 1 to 50 words put in at one place in 20 and one word in 10 left out, against alignment without a filter."""
    rng = random.Random(9)
    everything = licenses.templates_of(licenses.TEMPLATES)
    filler = [b"word%d" % i for i in range(400)]
    pool = {"unknown": filler, "common": filler + sorted(licenses.COMMON) * 8, "of licenses": sorted({w for t in everything for w in t.words})}[inserted]
    met = 0
    for t in everything:
        for _ in range(20):
            copy = []
            for w in t.words:
                copy += [rng.choice(pool) for _ in range(rng.randrange(1, 51))] if rng.random() < 0.05 else []
                copy += [w] if rng.random() < 0.9 else []
            if len(licenses.align(copy, t.words)) >= 0.8 * len(t.words) and len(copy) <= licenses.STRETCH * len(t.words):
                got = licenses.matches(filler[:30] + copy + filler[30:60], t)
                assert len(got) == 1 and 30 <= got[0][1] < got[0][2] <= 30 + len(copy), t.name
                met += 1
    assert met > 200


def test_altered_copies_in_a_row_are_all_found():
    """The copy that ends first leaves the next one its own stretch; a copy wider than STRETCH times its license is none."""
    rng = random.Random(10)
    for t in licenses.templates_of(licenses.TEMPLATES):
        gone = len(t.words) - licenses._bounds(tuple(t.words), t.telling, 0.8).words
        words, keep = [], 0
        for _ in range(100):
            lost = set(rng.sample(range(len(t.words)), gone))
            copy = [b"altered" if i in lost else w for i, w in enumerate(t.words)]
            if len(licenses.align(copy, t.words)) == len(t.words) - gone:
                words, keep = words + copy, keep + 1
        got = licenses.matches(words, t)
        assert len(got) >= keep > 0, t.name
        assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))
        apart = [x for w in t.words for x in (w, *[b"between"] * 2 * licenses.STRETCH)]
        assert licenses.matches(apart, t) == []


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the driver's tables")
def test_toxicity_of_held_out_rows(spark):
    """About 130 held-out toxic rows; the smaller tables hold a dozen, some without any word that other toxic rows have."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    above = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert len(toxic) > 100 and right >= 0.9 and above >= 0.9


def test_toxicity_of_odd_tables(spark):
    rng = random.Random(1)
    mixed = lambda words: " ".join(rng.choice(words) + f" n{rng.randrange(30)}" for _ in range(40))
    docs = [(i, mixed(["vile", "scum", "the", "calm"] if i % 2 else ["garden", "green", "the", "calm"])) for i in range(40)]
    bad, good = docs[1][1], docs[0][1]
    docs += [(50, None), (51, ""), (None, good), (1, bad)]
    d = spark.createDataFrame([(*x, i, "s") for i, x in enumerate(docs)], "doc_id long, text string, score int, x string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(50, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(d, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all((r.score > 0.7) == bool(r.doc_id % 2) for r in rows if r.doc_id is not None and r.doc_id < 40)
    kept = toxicity.drop_toxic(d, toxicity.fit(d, labels))
    assert kept.columns == d.columns and all(r.text != bad for r in kept.collect())
    assert {r.score for r in toxicity.toxicity_scores(d, labels.where("toxic = 0")).collect()} == {0.5}
    assert toxicity.toxicity_scores(d.where("false"), labels.where("false")).count() == 0


def test_held_out_labels_are_not_looked_at(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["bad", "the"] if i % 2 else ["fine", "the"]) + f" n{rng.randrange(30)}" for _ in range(40))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1] and scores[0][0][1] < 0.7 < scores[0][1][1]

def test_toxicity_of_fixed_phrases(spark):
    """Each inner word of a phrase has one context, so that only pairs of words can tell."""
    rng = random.Random(3)
    filler = lambda: " ".join(f"n{rng.randrange(40)}" for _ in range(20))
    docs = [(i, f"{filler()} {'you vile stupid filth' if i % 2 else 'you are so calm'} {filler()}") for i in range(600)]
    docs += [(1000 + i, ("you vile stupid filth " if i % 2 else "the garden is green and calm ") * 5) for i in range(40)]
    for d in (docs[:600], docs[600:]):
        rows = toxicity.toxicity_scores(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in d], "doc_id long, toxic int")).collect()
        assert np.mean([r.predicted == r.doc_id % 2 for r in rows if r.held_out]) == 1.0


def test_rare_words_keep_some_evidence():
    """Two toxic-only contexts tell little where half of all text is toxic, and much where a hundredth is."""
    zero, two = np.array([0]), np.array([2])
    even, small = toxicity.word_ratios(zero, two, 10_000, 10_000)[0], toxicity.word_ratios(zero, two, 99_000, 1000)[0]
    assert 0 < even < 0.1 < 0.5 < small


@tables
def test_toxicity_of_held_out_rows_of_a_small_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    assert len(toxic) > 5 and np.mean([r.predicted == r.toxic for r in rows]) >= 0.9
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) >= 0.9


def brute_scores(docs, backoff=0.4):
    texts = [(t or "").split() for _, t in docs]
    one, two = Counter(), Counter()
    for w in texts:
        one.update(w), two.update(zip(w, w[1:]))
    out = []
    for (d, _), w in zip(docs, texts):
        mine, ours, total = Counter(w), Counter(zip(w, w[1:])), max(sum(map(len, texts)) - len(w), 1)
        c = lambda v: max(one[v] - mine[v], 1)  # noqa: E731, B023
        s = math.log(c(w[0]) / total) if w else 0.0
        for p in zip(w, w[1:]):
            n = two[p] - ours[p]
            s += math.log(n / c(p[0])) if n else math.log(backoff * c(p[1]) / total)
        out.append((d, len(w), s))
    return out


@pytest.mark.parametrize("batch_bytes", [lmscore.BATCH_BYTES, 3000])
def test_language_model_scores(spark, batch_bytes):
    """Batches of all rows, and of so few that words stand in many; repeated rows count like copies."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["aa", "bb", "cc", "Été", "d" * 80, "e"]) for _ in range(rng.choice([0, 1, 2, 50, 4000])))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "unknown words only"), (3, docs[3][1]), (4, "another aa bb"), (None, "aa bb cc")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, batch int, gram int")
    got = sorted((r.doc_id or -1, r.n_words, round(r.log_score, 6)) for r in lmscore.lm_scores(df, batch_bytes=batch_bytes).collect())
    assert got == sorted((d or -1, n, round(s, 6)) for d, n, s in brute_scores(docs))
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in lmscore.lm_scores(df).collect())


def test_language_model_scores_of_odd_tables(spark):
    assert lmscore.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = lmscore.lm_scores(spark.createDataFrame([("a", "x y x")], "doc_id string, text string")).first()
    assert (one.doc_id, one.n_words, round(one.log_score, 6)) == ("a", 3, round(2 * math.log(0.4), 6))
