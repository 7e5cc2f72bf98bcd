"""Personal data, decontamination, mixing and token files against brute force; SQL where there is some."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, mixing, pii, queries, tokenfiles

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, df = c.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def luhn(m):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(re.sub("[^0-9]", "", m)))) % 10 == 0


def base_spans(text):
    fine = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(m), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if fine[k](m[0])]
    return [f"{k}:{a}:{z}" for a, _, k, z in sorted(found)]


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(8)
    bits = ["a@b.co", "x.y@z", "@", "..", "+1 (555) 010-9999", "+49", "10.0.0.1", "300.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "555-0199", "é", "𝒳", " ", "-", "0", "7", "mail ", "GB82WEST12345698765432", "12345678901234567890"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, "a" * 5000 + "@"), (903, "1." * 3000), (904, "4111 1111 1111 1111 " * 500), (904, "x@y.z"), (None, "me@you.org"), (905, "001.002.003.255 0256.1.1.1")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, row int, kind int").repartition(6)
    got = sorted((r.doc_id or -1, [f"{s.kind}:{s.start}:{s.end}" for s in r.found if s.kind_no < 4]) for r in pii.find_pii(df).collect())
    assert got == sorted((d or -1, base_spans(t)) for d, t in docs)
    assert pii.find_pii(df.where("false")).count() == 0


def test_further_kinds_and_scores(spark):
    df = spark.createDataFrame([(1, "my iban is GB82WEST12345698765432, GB83WEST12345698765432"), (2, "call 555-0199"), (3, "part 555-0199")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.score) for s in r.found] for r in pii.find_pii(df).collect()}
    assert got[1] == [("iban", 100)] and got[2] == [("local_phone", 55)] and got[3] == []


PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, bench, n=10):
    wins = {}
    for i, t in bench:
        w = plain(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, items = plain(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in wins:
                    hit.update(range(a, a + k))
                    items |= wins[tuple(w[a : a + k])]
        out.append((d, len(w), sorted(hit), sorted(items)))
    return out


def test_contamination(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["Alpha", "beta", "Γάμμα", "d4", "e", "f", "g", "h"]) for _ in range(n))
    bench = [(i, say(rng.choice([3, 9, 10, 14, 40]))) for i in range(20)] + [(30, None), (31, " .. "), (32, "solo")]
    docs = [(i, say(60) + (". " + rng.choice(bench[:20])[1] + "! " if i % 3 else "") + say(30)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "?!"), (103, "SOLO, solo"), (7, docs[7][1]), (8, "other text"), (None, bench[0][1]), (104, say(5000))]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, h_key int, items string")
    bf = spark.createDataFrame([(*b, "z") for b in bench], "item_id long, text string, words string")
    key = lambda x: (x[0] if x[0] is not None else -1, x[1:])
    want = sorted(brute_hits(docs, bench), key=key)
    for how in ({}, {"broadcast_bytes": -1}):
        got = decontaminate.contamination(df, bf, **how).collect()
        assert sorted([(r.doc_id, r.n_words, [p - 1 for p in r.hit_words], r["items"]) for r in got], key=key) == want
    kept = decontaminate.decontaminate(df, bf)
    clean = sorted(str(d) for d, _, hit, _ in want if not hit)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == clean
    cut = decontaminate.decontaminate(df, bf, remove="spans").collect()
    words = {(r.doc_id, tuple(plain(r.text))) for r in cut}
    assert len(cut) == len(docs)
    assert words == {(d, tuple(w for i, w in enumerate(plain(t)) if i not in hit)) for (d, t), (_, _, hit, _) in zip(docs, brute_hits(docs, bench))}
    assert decontaminate.contamination(df, bf.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(df.where("false"), bf).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left = set(), names
    while True:
        rest = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        now = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if now[s] > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] for s in full} | now
        full.update(over)
        left = [s for s in left if s not in full]


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a", "b", "b", "b", "b", "c", "d", None, "", "Z"]), "w " * rng.choice([0, 1, 5, 30, 200])) for i in range(3000)]
    docs += [(4000, "b", None), (4001, "zero", ""), (5, "b", "x y"), (None, "c", "x")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, copies int").repartition(9)
    sized = df.select("doc_id", "source", "copies", mixing.count_words(F.col("text")).alias("size"))
    rows = mixing.mix_sources(sized).collect()
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = brute_targets(sizes)
    assert len(rows) == len(docs)
    for s, target in targets.items():
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(target) and 0 <= r.copies <= 2 for r in mine)
        assert abs(sum(r.copies * r["size"] for r in mine) - target) <= 2 * max((r["size"] for r in mine), default=0)
    again = mixing.mix_sources(sized.repartition(3)).collect()
    same = lambda rs: sorted(str((r.doc_id, r.source, r["size"], r.copies)) for r in rs)
    assert same(rows) == same(again)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(sized.where("false")).count() == 0


def test_mix_of_repeated_ids_agrees_on_reruns(spark):
    rows = [(i % 3, f"{'abcdefgh'[i % 8]} {i % 5}", "s", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, more int")
    runs = [sorted(map(tuple, mixing.mix_documents(df.repartition(n)).collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 60


def test_boundaries():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (1, 10**9), (300, 2), (1000, 5000), (700, 1)):
        ends = np.cumsum(rng.integers(1, top + 1, n))
        bits, low, high, samples = tokenfiles.encode_boundaries(ends)
        assert tokenfiles.decode_boundaries(n, bits, low, high).tolist() == ends.tolist()
        assert [tokenfiles.select(i, bits, low, high, samples) for i in range(n)] == ends.tolist()
        assert len(low) + len(high) <= n * (2 + max(0, np.log2(ends[-1] / n)) + 1) / 8 + 2


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenfiles.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(3)
    bits = ["Hello", "wörld", "don't", "3.14", "(x)", "漢字かな", "é", " ", "\n\n", "\t", "😀", "a_b", "ALL-CAPS!", "x" * 200, "​", "…", "'s", "ﬁ", "\x00", "　", "end."]
    docs = [(i, rng.choice([" ", "", "  "]).join(rng.choice(bits) for _ in range(rng.choice([0, 1, 10, 300])))) for i in range(80)]
    docs += [(-5, None), (200, ""), (201, " "), (7, "again"), (None, "no id"), (202, "word " * 20000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shard int").repartition(5)
    tokenfiles.write_token_files(df, str(tmp_path / "t"), path, block_ids=500)
    got = tokenfiles.read_documents(spark.read.parquet(str(tmp_path / "t"))).orderBy("start").collect()
    want = [(d, t, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in docs]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), ids) for d, _, ids in want)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    digest = {r.start: r.ids_crc32 for r in tokenfiles.token_table(df, path).collect()}
    assert digest == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    assert tokenfiles.token_table(df.where("false"), path).count() == 0
    some = tokenfiles.fetch(spark.read.parquet(str(tmp_path / "t")), [0, 41, 79, 202, 999]).collect()
    assert sorted((r.doc_id, r.ids) for r in some) == sorted((d, ids) for d, _, ids in want if d in (0, 41, 79, 202))


def test_words_are_forgotten_and_learnt_again():
    path, rng = tokenfiles.default_tokenizer(), random.Random(5)
    vocabulary = [f"w{i}" if i % 3 else f"word-{i}." for i in range(900)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([20, 900])]) for _ in range(120)).encode() for _ in range(90)] + [b"", b"bad \xff bytes"]
    whole, small = tokenfiles.WordEncoder(path), tokenfiles.WordEncoder(path, remembered=100)
    for i in range(0, len(texts), 8):
        for a, b, text in zip(whole.encode(texts[i : i + 8]), small.encode(texts[i : i + 8]), texts[i : i + 8]):
            want = whole.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids
            assert a.tolist() == b.tolist() == want
    assert len(small.places) < 500 < len(whole.places)


def test_words_are_learnt_apart_from_signs():
    """The tokenizers library sees a word once, whatever stands around it and however it is written."""
    encoder, signs = tokenfiles.WordEncoder(tokenfiles.default_tokenizer()), ["", ".", "!!", "###", '"', ")", "&&&", "1", "2,", " ("]
    words = [a + b for a in ("the", "Été", "straße", "MOÑO", "over") for b in "abcdefgh"]
    texts = [" ".join(s[::-1] + w + t for w in words) for s in signs for t in signs]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.places) <= 2 * len(words) + 2 * len(signs)


def test_ids_at_the_ends_of_texts_letters_and_batches(monkeypatch):
    monkeypatch.setattr(tokenfiles, "CUT_BYTES", 64, raising=False)
    encoder, rng = tokenfiles.WordEncoder(tokenfiles.default_tokenizer(), remembered=50), random.Random(7)
    marks = ["H\u0331 h\u0331", "T\u0308.x", "I\u0591\u0307", "É\u0331!", "×.a÷", "İ.İ", "'ſ.'s$'ll", "<|endoftext|>H.é", "<|ENDOFTEXT|>É.", ""]
    texts = [t.encode() for t in marks] + [bytes(rng.choice(b"aZ'.1 \xc3\xc4\xa9\x97\xb0\xcc\x88\xe2\xff") for _ in range(rng.choice([0, 1, 2, 9, 200]))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids, text
    column = pa.array([b"left out", None, b"a b", b"", b"\xc3\x89."], pa.binary()).slice(1)
    for text, ids in zip(column.to_pylist(), encoder.encode(column), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode((text or b"").decode(), add_special_tokens=False).ids


def test_digests(spark, tmp_path):
    text = "Me: a@b.co or +1 555 010 9999"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = pii.op7_pii(spark, str(tmp_path)).first()
    assert (r.n_email, r.n_phone) == (1, 1) and r.base_sha256 == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()
