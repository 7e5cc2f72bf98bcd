"""Substring dedup and SimHash near-duplicates against brute force."""

import random
import re

import xxhash

from newsloom.llm import simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1):
    """Shared passages, self repeats, exact and near copies, null, empty, blank, very long and very short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "漢字", "x" * 90]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [say(n) for n in (20, 21, 35, 80)]
    docs = []
    for i in range(60):
        words = say(rng.choice([3, 19, 20, 40, 120]))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 10)
            at = rng.randrange(len(words) + 1)
            words[at:at] = p[a:] if rng.random() < 0.5 else p
        docs.append((i, " ".join(words)))
    long = say(3000)
    docs += [(100, " ".join(long)), (101, " ".join(long[:1500] + ["new"] + long[1500:])), (102, " ".join(["a", "b"] * 60)), (103, "same " * 50)]
    docs += [(104, None), (105, ""), (106, " \t\n"), (107, docs[5][1]), (108, docs[5][1]), (109, docs[7][1].replace(" ", "\n\t"))]
    return docs


def brute_substrings(docs, n=20):
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), (d, i))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (d, i):
                gone.update(range(i, i + n))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substrings_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id long, text string, closed string, first_doc int").repartition(5)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(df).collect()}
        assert got == brute_substrings(docs)
        assert sum(n > 0 for _, n, _ in got.values()) > 20


def test_substrings_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert substrings.dedup_substrings(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"t{i}" for i in range(30))
    rows = substrings.dedup_substrings(spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 30)]
    for kind, ids in (("int", [1, 2]), ("string", ["a", "b"])):
        df = spark.createDataFrame([(i, text) for i in ids], f"doc_id {kind}, text string")
        assert sorted((r.doc_id, r.n_removed) for r in substrings.dedup_substrings(df).collect()) == [(ids[0], 0), (ids[1], 30)]


def test_word_hashes():
    """Words of every length, at any place, alike only where they are equal; blanks of all kinds part them."""
    words = ["x" * n for n in (1, 7, 8, 9, 16, 17, 63, 64, 65, 200)] + ["a\u00a0b", "Été", "漢字かな交じり", "\x00", "x" * 64 + "y", "x" * 8 + "y"]
    texts = ["", " \t", " ".join(words), "\n\v".join(words[::-1]), *words, "x" * 8 + " y"]
    h, n = substrings.word_hashes([t.encode() for t in texts])
    want = [w for t in texts for w in WORD.findall(t)]
    assert n.tolist() == [len(WORD.findall(t)) for t in texts] and len(h) == len(want)
    seen = {}
    assert all(seen.setdefault(w, x) == x for w, x in zip(want, h.tolist())) and len(set(seen.values())) == len(seen)


def brute_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=4):
    """[(id, fingerprint)] -> {id: smallest id reachable}."""
    home = {d: d for d, _ in prints}

    def root(d):
        while home[d] != d:
            d = home[d]
        return d

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= distance:
                low, high = sorted((root(a), root(b)))
                home[high] = low
    return {d: root(d) for d, _ in prints}


def test_fingerprint():
    for t in ["", None, "a", "A b C", "Ä É x y Z", "word " * 700, *[t for _, t in corpus()]]:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_print(t)


def test_components_of_texts(spark):
    docs = corpus(3)
    docs += [(200 + i, " ".join(f"q{j}" for j in range(400) if j != i)) for i in range(12)]
    prints = [(d, brute_print(t)) for d, t in docs]
    want = brute_components(prints)
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(df).collect()}
    assert got == {d: (p, want[d]) for d, p in prints}
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_links_lose_none_in_any_blocks_or_tiles(spark):
    """Chains at the distance and just beyond it, crowded blocks, small tiles."""
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for _ in range(3):
            for _ in range(rng.choice([1, 4, 5])):
                p ^= 1 << rng.randrange(64)
            prints.append(p)
    prints += [0xFFFF << 48 | i for i in range(0, 4000, 41)]
    prints = sorted(set(prints))
    want = brute_components(list(enumerate(prints)))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for blocks, tile in ((None, 1024), (6, 7), (8, 16)):
        pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, blocks=blocks, tile=tile).collect()]
        at = {p: i for i, p in enumerate(prints)}
        home = list(range(len(prints)))

        def root(x, home=home):
            while home[x] != x:
                x = home[x]
            return x

        for a, b in pairs:
            low, high = sorted((root(at[a]), root(at[b])))
            home[high] = low
        assert {i: root(i) for i in range(len(prints))} == want


def test_simhash_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert simhash.simhash_components(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a b"), (3, None), (2, ""), (2, ""), (9, "one two three four five")], schema)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.simhash_components(df).collect())
    assert got == [(-1, -1), (2, 2), (2, 2), (3, 2), (9, 9)]
    assert sorted(r.doc_id or -1 for r in simhash.near_dedup(df).collect()) == [-1, 2, 9]


def test_near_dedup_keeps_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(5, a, "x"), (5, b, "x"), (6, a, "x"), (5, a, "x"), (7, b, None), (8, None, "y")], "doc_id long, text string, row string")
    got = simhash.near_dedup(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.text == a) for r in got.collect()) == [(5, False), (5, True), (8, False)]
    twice = spark.createDataFrame([(5, a, "x"), (5, a, "y")], df.schema)
    kept = [r.row for _ in range(2) for r in simhash.near_dedup(twice.repartition(2 + _)).collect()]
    assert len(kept) == 2 and kept[0] == kept[1]
    assert simhash.near_dedup(df.where("false")).count() == 0
