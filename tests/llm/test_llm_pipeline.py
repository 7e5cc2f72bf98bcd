"""The pipeline on the smallest tables, stage by stage against brute force."""

import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import corpus_pipeline  # noqa: E402
from newsloom.llm import mixing, tokenfiles, toxicity  # noqa: E402
from test_llm_dedup import brute_components, brute_print  # noqa: E402
from test_llm_spans import brute_hits, brute_targets  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages_have_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "benchmark", "mix", "tokens"]


def test_run(spark):
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    kept = sorted(d for d in rows if not scored[d])
    assert 0 < len(kept) < len(rows)
    home = brute_components([(d, brute_print(rows[d].text)) for d in kept])
    kept = sorted(set(home.values()))
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [d for d, _, hit, _ in brute_hits([(d, rows[d].text) for d in kept], bench) if not hit]
    sizes, size = {}, {d: len((rows[d].text or "").split()) for d in kept}
    for d in kept:
        sizes[rows[d].source] = sizes.get(rows[d].source, 0) + size[d]
    targets, mixed = brute_targets(sizes), []
    offsets = {r[0]: r[1] for r in docs.select("source", mixing.offset(docs.source)).distinct().collect()}
    for s in sizes:
        each = targets[s] / sizes[s] if sizes[s] else 0.0
        for rank, d in enumerate(sorted((d for d in kept if rows[d].source == s), key=lambda d: (size[d], d))):
            mixed += [d] * int(np.floor((rank + 1) * each + offsets[s]) - np.floor(rank * each + offsets[s]))
    tokenizer, start, want = Tokenizer.from_file(tokenfiles.default_tokenizer()), 0, []
    for d in sorted(mixed):
        ids = [*tokenizer.encode(rows[d].text or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_words_are_encoded_as_whole_texts_are():
    """Case, stops after letters, special tokens, marks that combine and words forgotten and met again change no id."""
    encoder = tokenfiles.WordEncoder(tokenfiles.default_tokenizer(), remembered=8)
    assert encoder.folds
    texts = [
        "A<|endoftext|>b, C", "<|ENDOFTEXT|> Ab.", "İstanbul, e.g. A.B.C, 'S it's, O'Neil.'s", "x.,y ,, a,.b !, .", "K, É. Été, straße. İ ŉa ǅx",
        "", "1,000.5 a1,b2. 中文, đá,", "the The THE the, The.", "a̸, ≠ ,̸ .́",
    ]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
