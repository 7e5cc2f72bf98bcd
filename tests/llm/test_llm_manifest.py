"""Merkle manifest, periodic runs and MinHash components against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from newsloom.llm import merkle, minhash, periodic, stars

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc_id, source, lang, n_chars, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha(*parts)


def brute_tree(digests, arity=8):
    """Top, and for each leaf its siblings: (before, after) a level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // arity * arity : k // arity * arity + arity]
            paths[i].append((run[: k % arity], run[k % arity + 1 :]))
        at = [k // arity for k in at]
        level = [sha(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


def brute_manifest(docs, arity=8):
    """[(doc_id, text, lang, source, n_chars)] -> rows as op11 gives them."""
    langs = sorted({d[2] for d in docs}, key=lambda v: (v is not None, (v or "").encode()))
    tops, found = [], []
    for lang in langs:
        mine = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, brute_leaf(d[0], d[3], d[2], d[4], d[1])))
        leaves = [brute_leaf(d[0], d[3], d[2], d[4], d[1]) for d in mine]
        top, paths = brute_tree(leaves, arity)
        tops.append(top)
        found += [(d, leaf, top, p, len(tops) - 1) for d, leaf, p in zip(mine, leaves, paths)]
    root, above = brute_tree(tops, arity)
    out = []
    for d, leaf, top, path, group in found:
        path = path + above[group]
        acc = leaf
        if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and d[1] is not None:
            acc = brute_leaf(d[0], d[3], d[2], d[4], low(d[1]))
        for before, after in path:
            acc = sha(*before, acc, *after)
        out.append((d[0], leaf, top, root, sha(*[x for b, a in path for x in b + a]), acc, acc == root))
    return out


def saved(spark, path, docs):
    spark.createDataFrame([(*d, "x", 1) for d in docs], DOCUMENT + ", leaf string, grp int").repartition(7).write.parquet(f"{path}/documents.parquet")
    return str(path)


def manifest_corpus(n=700, seed=5):
    rng = random.Random(seed)
    docs = [(i, rng.choice(["Ab cd", "é Ü X", "", "lower only", None, "long " * 3000]), rng.choice(["en", "vi", "vi", "vi", None, "漢"]), rng.choice([None, "s1", ""]), rng.choice([None, 0, 12])) for i in range(n)]
    docs += [(5000, "A", "lone", "s", 1), (None, "B c", "en", "s", 1), (None, None, "en", "s", 1), docs[3], docs[3], (docs[4][0], "other text", docs[4][2], "s", 2)]
    return docs


def key(r):
    return tuple(str(v) for v in r)


def test_manifest_against_brute_force(spark, tmp_path):
    docs = manifest_corpus()
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, saved(spark, tmp_path, docs)).collect()]
    assert sorted(got, key=key) == sorted(brute_manifest(docs), key=key)
    assert len({r[3] for r in got}) == 1 and 0 < sum(r[6] for r in got) < len(got)


def test_proofs_of_other_shapes(spark):
    """Every way to split levels between shuffle and broadcast, other arities, many groups, a changed leaf."""
    rows = [(f"g{i % 40:02}" if i % 3 else "big", i, sha(str(i))) for i in range(400)]
    for arity, small in ((2, 0), (3, 25), (8, 1 << 16)):
        m = merkle.manifest(spark.createDataFrame(rows, "group string, key int, leaf string"), arity)
        tops = []
        for g in sorted({r[0] for r in rows}):
            tops.append(brute_tree([r[2] for r in rows if r[0] == g], arity)[0])
        assert m.root == brute_tree(tops, arity)[0]
        p = merkle.proofs(m, small)
        got = p.select(merkle.fold(p.path, p.leaf).alias("own"), merkle.fold(p.path, merkle.F.lit(sha("changed"))).alias("other")).collect()
        assert len(got) == 400 and {r.own for r in got} == {m.root} and m.root not in {r.other for r in got}


def test_manifest_of_small_tables(spark, tmp_path):
    assert merkle.op11_merkle_manifest(spark, saved(spark, tmp_path / "none", [])).count() == 0
    one = [(7, "A b", None, None, None)]
    got = merkle.op11_merkle_manifest(spark, saved(spark, tmp_path / "one", one)).collect()
    assert [tuple(r) for r in got] == brute_manifest(one) and got[0].root == got[0].leaf


def brute_runs(w, least=6, periods=4):
    seen = {}
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, periods * p):
                seen.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in seen.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def brute_planted(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_op12(doc_id, text):
    w = brute_planted(doc_id, text)
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(brute_collapsed(w, runs)))


def test_runs_of_word_lists():
    rng = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 8)):
            letters, n = rng.choice([1, 2, 3, 20]), rng.choice([0, 1, 5, 6, 7, 20, 60, 150])
            w = [rng.choice("abcdefghijklmnopqrst"[:letters]) for _ in range(n)]
            if n > 20 and rng.random() < 0.6:
                a = rng.randrange(n - 8)
                p = rng.randrange(1, max(2, (n - a) // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] + [rng.choice("xyz") for _ in range(rng.choice([0, 0, 9]))]
            texts.append([x.encode() for x in w])
        for w, r in zip(texts, periodic.find_runs(texts)):
            assert [tuple(x) for x in r.tolist()] == brute_runs(w)


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n, v=60: " ".join(rng.choice([f"w{i}" for i in range(v)] + ["É", "漢字"]) for _ in range(n))
    docs = [(i, say(rng.choice([1, 5, 30, 200])), "en", "s", 1) for i in range(200)]
    docs += [(300, None, "en", "s", 1), (301, "", "en", "s", 1), (302, " \t\n", None, None, None), (303, "same " * 5000, "en", "s", 1), (304, "a b\tc\n" * 700 + "x", "en", "s", 1)]
    docs += [(None, "q " * 9, "en", "s", 1), docs[5], docs[5], (306, say(30000, 5000), "en", "s", 1)]
    assert sum(zlib.crc32(str(d[0]).encode()) % 10 == 0 for d in docs) > 10
    got = [tuple(r) for r in periodic.op12_periodic_runs(spark, saved(spark, tmp_path, docs)).collect()]
    assert sorted(got, key=key) == sorted((brute_op12(d[0], d[1]) for d in docs), key=key)


def test_periodic_runs_of_odd_tables(spark):
    df = spark.createDataFrame([("a", "x y " * 6 + "z", 1), (None, None, 2)], "doc_id string, text string, runs int")
    got = {r.doc_id: (r.runs, r.collapsed) for r in periodic.periodic_runs(df, group_words=3).collect()}
    assert got[None] == ([], "") and [tuple(x) for x in got["a"][0]] == [(0, 12, 2)] and got["a"][1] == "x y z"
    assert periodic.periodic_runs(df.where("false")).count() == 0


def brute_sets(docs):
    out = []
    for _, t in docs:
        w = WORD.findall(low(t))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute_minhash(docs):
    """[(doc_id, text)] -> sorted rows; ids may be missing or repeated."""
    sets, home = brute_sets(docs), list(range(len(docs)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    inverse = {}
    for i, s in enumerate(sets):
        for x in s:
            inverse.setdefault(x, []).append(i)
        for j, n in Counter(j for x in s for j in inverse[x] if j < i).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                home[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            smallest[root(i)] = min(d, smallest.get(root(i), d))
    rows = []
    for i, (d, _) in enumerate(docs):
        c = smallest.get(root(i)) if sets[i] else d
        rows.append((d, len(sets[i]), c, d == c))
    return sorted(rows, key=key)


def near_corpus(seed, most=50):
    """Groups of copies with some words changed, so that many pairs lie around the threshold; odd texts; odd ids."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)] + ["É", "漢字"]
    texts = []
    for copies in (1, 5, 12, most):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 300]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w).upper() if rng.random() < 0.1 else "\t".join(w))
    rng.shuffle(texts)
    docs = list(enumerate(texts)) + [(901, None), (902, ""), (903, " \t"), (904, "a b"), (905, "A  B"), (906, "a b c"), (None, "b a"), (None, texts[0]), (None, None)]
    return docs + [docs[3], (docs[4][0], "another text of the same id, long enough to have shingles"), (907, " ".join(vocabulary * 4))]


@pytest.mark.parametrize("seed, bounds", [(1, {}), (2, {"few": 0, "most": 7}), (3, {"few": 1, "rounds": 1, "shingles": 2000})])
def test_minhash_against_brute_force(spark, seed, bounds):
    docs = near_corpus(seed)
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, n long, digest string").repartition(5)
    got = sorted((tuple(r) for r in minhash.minhash_components(df, **bounds).collect()), key=key)
    assert got == brute_minhash(docs)
    assert len({r[2] for r in got}) < len(docs) - 20


def test_candidates_in_tiles_and_large_buckets(spark):
    """Small tiles find the same components as one tile; buckets taken unseen may only join more."""
    rng = random.Random(6)
    rows = [(bytes([i, g]), 100, b"".join(rng.choice(2 * [g] + [g + 50]).to_bytes(2, "little") for _ in range(150))) for g in range(3) for i in range(25)]
    df = spark.createDataFrame(rows, "digest binary, n long, signature binary")
    some, more, unseen = (sorted((bytes(r.node), bytes(r.component)) for r in minhash.candidates(df, 40, tile=t, large=u).collect()) for t, u in ((1024, 1000), (4, 1000), (4, 5)))
    assert some == more and {n for n, _ in some} <= {n for n, _ in unseen} and len({c for _, c in some}) == 3


def test_minhash_of_an_empty_table(spark):
    assert minhash.minhash_components(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(4)
    a, b = minhash.hash_functions(600)
    words = [rng.getrandbits(64) for _ in range(300)]
    x, y = (minhash.np.unique(minhash.np.array(w, minhash.np.uint64)) for w in (words, words[:225] + [rng.getrandbits(64) for _ in range(75)]))
    m = minhash.minima([x, y, x], a, b)
    assert (m[0] == m[2]).all() and abs((m[0] == m[1]).mean() - 225 / 375) < 0.08
    assert 0.6 < minhash.least_agreeing(150) / 150 < 0.85
    assert (1 - 0.85**minhash.ROWS) ** minhash.BANDS < 1e-7


def test_star_components(spark):
    """Chains, stars, rings and single edges, with repeated and turned edges and self loops."""
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 4), (300, 299), (299, 300), (7, 7), (400, 400), (None, 3)]
    got = {r.node: r.component for r in stars.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 209)} | {299: 299, 300: 299}
    assert got == want
    assert stars.star_components(spark.createDataFrame([], "a long, b long")).count() == 0
