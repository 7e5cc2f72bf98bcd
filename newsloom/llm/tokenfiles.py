"""Token-ID files: concatenated ids with Elias-Fano encoded document boundaries.

The format is a Parquet table, which any store that Spark can write will hold, of blocks:

  shard, block      place of the block; blocks in order of (shard, block) hold documents in order of doc_id
  doc_ids           the documents' ids, null where a document has none
  n_docs, n_tokens  documents and ids in the block
  ids               all ids, little-endian, id_bytes bytes each, document after document
  low_bits          l: how many low bits of each boundary are stored plainly
  low               those bits, boundary after boundary, least significant bit first
  high              the rest in unary: boundary i, whose upper part is h, sets bit h + i
  samples           for every 256th boundary the place of its bit in `high`, as unsigned 32-bit

Boundaries are the running ends of the documents. They take about 2 + log2(n_tokens / n_docs)
bits each; select() finds one by its sample and a scan of at most the next 256 ones, fetch() uses it to read single documents.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.shared import new_path, shuffles_freed

END_ID = 2
SAMPLE = 256
#: A block is closed once it holds so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
#: Different words remembered by a worker, of about 250 bytes each. Beyond, only those met more than once since stay.
REMEMBERED = 300_000
#: Texts are cut, and their different words counted, by so many bytes; a longer text goes alone.
CUT_BYTES = 1 << 21
_BYTES = np.arange(256)
_BLANK = np.isin(_BYTES, list(b" \t\n\r\x0b\x0c"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SMALL = (_BYTES >= ord("a")) & (_BYTES <= ord("z"))
#: First bytes of U+00C0 to U+017F, which are letters but for U+00D7 and U+00F7.
_LATIN = (_BYTES >= 0xC3) & (_BYTES <= 0xC5)
#: ASCII that is no letter, no blank and no apostrophe: letters end before it and begin after it.
_SIGN = (_BYTES < 0x80) & ~_SMALL[_LOWER] & ~_BLANK & (_BYTES != ord("'"))
#: Bytes before which a letter is complete: no mark that could combine with it begins so.
_FIRM = (_BYTES < 0x80) | _LATIN
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which begins pieces like 's

BLOCK_SCHEMA = (
    "shard int, block int, doc_ids array<{kind}>, n_docs int, n_tokens long, id_bytes int, ids binary, "
    "low_bits int, low binary, high binary, samples binary"
)


def encode_boundaries(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Ascending ends -> low_bits, low, high, samples."""
    n, top = len(ends), int(ends[-1]) if len(ends) else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    v = ends.astype(np.uint64)
    low = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0), np.uint64)
    place = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
    high[place] = 1
    pack = lambda bits: np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return low_bits, pack(low), pack(high), place[::SAMPLE].astype("<u4").tobytes()


def _low(low_bits: int, low: bytes, first: int, n: int) -> np.ndarray:
    if not low_bits:
        return np.zeros(n, np.int64)
    a, b = first * low_bits, (first + n) * low_bits
    bits = np.unpackbits(np.frombuffer(low, np.uint8, -(-b // 8) - a // 8, a // 8), bitorder="little")[a % 8 : a % 8 + n * low_bits]
    return bits.reshape(n, low_bits).astype(np.int64) @ (1 << np.arange(low_bits, dtype=np.int64))


def decode_boundaries(n: int, low_bits: int, low: bytes, high: bytes) -> np.ndarray:
    """All ends."""
    place = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little"))[:n]
    return ((place - np.arange(n)) << low_bits) | _low(low_bits, low, 0, n)


def select(i: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> int:
    """End of document i, without decoding the others: from the sample before it, byte by byte."""
    at = int(np.frombuffer(samples, "<u4")[i // SAMPLE])
    left, byte, bits = i % SAMPLE, at // 8, high[at // 8] >> (at % 8) << (at % 8)
    while left >= bits.bit_count():
        left -= bits.bit_count()
        byte += 1
        bits = high[byte]
    for _ in range(left):
        bits &= bits - 1
    place = byte * 8 + (bits & -bits).bit_length() - 1
    return (place - i) << low_bits | int(_low(low_bits, low, i, 1)[0])


class _Places(dict):
    """Word -> its number; a new word gets the next one and is noted as pending."""

    def __init__(self):
        super().__init__()
        self.pending: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.pending.append(word)
        self[word] = n = len(self)
        return n


class WordEncoder:
    """Ids of whole texts by way of their blank-separated words.

    The vocabularies it is for drop white space and split at it before anything else, so a text's
    ids are its words' ids in turn. Every different word goes through the tokenizers library once.
    Texts are cut, and equal words found, in arrays of some megabytes; Python sees the different words of each.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece of a word, where the vocabulary marks them
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Case does not matter, and letters are cut from what follows: words that differ so need not be told apart.
        self.folds = bool(self.closes.any()) and self._cut("Ab,9cD7.É!e") == ["ab", ",", "9", "cd", "7", ".", "Ã©", "!", "e"]
        #: For words of small Latin letters alone, which are whole pieces already: without the steps that change or cut a text.
        self.plain = Tokenizer(self.tokenizer.model)  # shared, not copied
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.places = _Places()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _cut(self, text: str) -> list[str]:
        """Pieces that the tokenizer looks at on their own; none where it has no such steps."""
        change, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        return [piece for piece, _ in cut.pre_tokenize_str(change.normalize_str(text))] if change and cut else []

    def _words(self, text: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Blank-separated words of the texts between bounds, one text after the other, and where each text's begin.

        Where the vocabulary allows it in lower case, with letters and the signs beside them apart.
        """
        first = bounds[:-1][np.diff(bounds) > 0]
        word = ~_BLANK[text]
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        if self.folds:
            low, apart = self._folded(text, first)
            lower = text.tobytes().lower()
            for special in self.special:  # those are found in the text as it stands
                at = lower.find(special)
                while at >= 0:
                    a, z = bounds[np.searchsorted(bounds, at, "right") - 1 :][:2]
                    low[a:z], apart[a:z] = text[a:z], False
                    at = lower.find(special, z)
            text = low
            starts |= apart
        starts[first] = word[first]
        letters, ends = text[word], np.flatnonzero(starts[word])
        offsets = np.append(ends, len(letters))
        counts = [np.count_nonzero(starts[a:z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        return words, np.cumsum([0, *counts])

    @staticmethod
    def _folded(text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts, which begin at first, with capital letters made small, up to U+00DE, and the places where letters and signs part.

        A letter before anything that could combine with it stays: H and U+0331 are two characters, h and U+0331 one.
        """
        firm = np.append(_FIRM[text[1:]], True)[: len(text)]
        low = np.where(firm, _LOWER[text], text)
        more = text & 0xC0 == 0x80
        more[first] = False
        at = np.flatnonzero(_LATIN[text[:-1]] & more[1:])
        lead, rest = text[at], text[at + 1]
        no_letter = (lead == 0xC3) & ((rest == 0x97) | (rest == 0xB7)) | (lead == 0xC4) & (rest == 0xB0)  # small U+0130 ends in a mark
        at, lead, rest = at[~no_letter], lead[~no_letter], rest[~no_letter]
        low[at + 1] += np.where((lead == 0xC3) & (rest < 0x9F) & firm[at + 1], 0x20, 0).astype(np.uint8)
        begins, sign = _SMALL[_LOWER[text]], _SIGN[text]
        ends = begins.copy()
        begins[at], ends[at + 1] = True, True
        apart = np.zeros(len(text), bool)
        apart[1:] = (ends[:-1] & sign[1:]) | (sign[:-1] & begins[1:])
        return low, apart

    def _forget(self) -> None:
        """Keep the words met more than once since this was last called, half of what is remembered at most."""
        n = len(self.places)
        often = self.met[:n] > 1
        if often.sum() > self.remembered // 2:
            often = self.met[:n] > max(1, int(np.partition(self.met[:n], n - self.remembered // 2)[n - self.remembered // 2]))
        words, old = [w for w, x in zip(self.places, often.tolist()) if x], (self.flat, self.start[:n][often], self.size[:n][often])
        self.places = _Places()
        self.places.update(zip(words, range(len(words))))
        flat, start, size = old
        ends = np.cumsum(size)
        self.used = int(ends[-1]) if len(ends) else 0
        self.flat = np.empty(max(1 << 16, 2 * self.used), np.uint32)
        self.flat[: self.used] = flat[np.arange(self.used) + np.repeat(start - (ends - size), size)]
        self.start, self.size, self.met = (np.zeros(max(1 << 14, 2 * len(words)), np.int64) for _ in range(3))
        self.start[: len(words)], self.size[: len(words)] = ends - size, size

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes

    def _joined_ids(self, words: list[str], pieces: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same, faster, for words that are known to be cut into so many pieces: as one text, parted at ends of pieces."""
        lines = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
        found = [e.ids for e in (self.plain if plain else self.tokenizer).encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, sum(map(len, found)))
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != pieces.sum():
            return self._ids(words)
        return flat, np.diff(ends[np.cumsum(pieces) - 1], prepend=0)

    def _learn(self) -> None:
        """Encode the pending words. Letters, or letters and then punctuation, are one or two pieces; others go alone."""
        words, self.places.pending = [w.decode(errors="replace") for w in self.places.pending], []
        pieces = np.zeros(len(words), np.int64)
        letters = self.folds and not any(t.isalpha() for t in self.special)
        plain = np.array([letters and w.isalpha() and w == w.lower() and max(w) < "\u0180" for w in words], bool)
        pieces[plain] = 1
        if self.closes.any():
            for i in np.flatnonzero(~plain).tolist():
                head = words[i].rstrip(_PUNCTUATION)
                if head.lower().isalpha():
                    pieces[i] = 1 if head == words[i] else 2
        first = len(self.places) - len(words)
        if len(self.places) > len(self.start):
            self.start, self.size, self.met = (np.concatenate([x, np.zeros(len(self.places), np.int64)]) for x in (self.start, self.size, self.met))
        joined = (pieces > 0) & ~plain
        for which, ids_of in (
            (plain, lambda ws: self._joined_ids(ws, pieces[plain], True)),
            (joined, lambda ws: self._joined_ids(ws, pieces[joined], False)),
            (pieces == 0, self._ids),
        ):
            if not which.any():
                continue
            ids, sizes = ids_of([w for w, x in zip(words, which) if x])
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(len(self.flat) + len(ids), np.uint32)])
            self.flat[self.used : self.used + len(ids)] = ids
            at = first + np.flatnonzero(which)
            self.size[at], self.start[at] = sizes, self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)

    def encode(self, texts: list[bytes] | pa.Array) -> Iterator[np.ndarray]:
        texts = pa.array(texts, pa.large_binary()) if isinstance(texts, list) else texts.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CUT_BYTES, "right")) - 1)
            yield from self._encode(whole[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            i = j

    def _encode(self, text: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        if len(self.places) > self.remembered:
            self._forget()
        words, begins = self._words(text, bounds)
        coded = words.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        k = np.fromiter(map(self.places.__getitem__, different), np.int64, len(different))
        if self.places.pending:
            self._learn()
        self.met[k] += np.bincount(coded.indices.to_numpy(), minlength=len(k))
        size = self.size[k]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[k] - (ends - size), size)
        known = pa.Array.from_buffers(pa.large_binary(), len(k), [None, pa.py_buffer(np.append(0, 4 * ends)), pa.py_buffer(self.flat[at])])
        taken = known.take(coded.indices)  # a word's ids are its bytes
        ids = np.frombuffer(taken.buffers()[2] or b"", np.uint32)
        cuts = np.frombuffer(taken.buffers()[1], np.int64)[begins] // 4 if len(taken) else begins
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield ids[a:z]


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """One for each Python worker: its memory serves all tasks that the worker runs."""
    return WordEncoder(path)


def _blocks(path: str, end_id: int, block_ids: int, kind: str):
    """Texts of one shard, in order -> its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema, shard, block = None, TaskContext.get().partitionId(), 0
        encoder, docs, parts, held = _encoder(path), [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal docs, parts, held, block
            ids = np.concatenate(parts)
            wide = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
            low_bits, low, high, samples = encode_boundaries(np.cumsum([len(p) for p in parts]))
            row = [shard, block, docs, len(docs), len(ids), wide, ids.astype(f"<u{wide}").tobytes(), low_bits, low, high, samples]
            out = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
            docs, parts, held, block = [], [], 0, block + 1
            return out

        for b in batches:
            schema = schema or pa.schema([
                ("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(b.column(0).type)), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32()),
                ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary()),
            ])
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                if held and held + len(ids) > block_ids:
                    yield closed()
                docs.append(doc)
                parts.append(ids)
                held += len(ids)
        if docs:
            yield closed()

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode docs (doc_id, text), sorted by doc_id, into the format above at `out`.

    The sort is by ranges, so no task holds more than its share and one block. Null text is an
    empty document: the end id alone. Documents without doc_id come first; rows that repeat a
    doc_id stay, side by side; bytes that are no UTF-8 are read as U+FFFD; an empty table writes a table without blocks.
    """
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    ordered = texts.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(_blocks(tokenizer, end_id, block_ids, kind), BLOCK_SCHEMA.format(kind=kind)).write.parquet(out)


def _starts(files: DataFrame) -> DataFrame:
    """shard, block, before: ids in all blocks before. One task sees a row a shard, not a row a block."""
    inner = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("shard_before"))
    blocks = files.select("shard", "block", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("block_before"))
    return blocks.join(shards, "shard").select("shard", "block", (F.col("shard_before") + F.col("block_before")).alias("before"))


def read_documents(files: DataFrame, digest: bool = False) -> DataFrame:
    """Blocks -> doc_id, start, n_tokens and ids (or, with digest, ids_crc32): one row for each document.

    start counts the ids of all documents before.
    """
    kind = dict(files.dtypes)["doc_ids"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a block is some megabytes: one at a time
                r = b.slice(k, 1).to_pylist()[0]
                ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").astype("<u4")
                ends = decode_boundaries(r["n_docs"], r["low_bits"], r["low"], r["high"])
                starts = np.concatenate(([0], ends[:-1]))
                each = [ids[a:z] for a, z in zip(starts.tolist(), ends.tolist())]
                n = len(each)
                what = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array(each, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(r["doc_ids"], b.schema.field("doc_ids").type.value_type), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), what],
                    ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    last = "ids_crc32 long" if digest else "ids array<long>"
    rows = files.select("shard", "block", "doc_ids", "n_docs", "id_bytes", "ids", "low_bits", "low", "high").mapInArrow(
        run, f"shard int, block int, doc_id {kind}, at long, n_tokens long, {last}"
    )
    return rows.join(_starts(files), ["shard", "block"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", last.split()[0])


def fetch(files: DataFrame, wanted: list) -> DataFrame:
    """doc_id, ids of the wanted documents only: their boundaries are selected, no others are decoded. Unknown ids have no row."""
    kind = dict(files.dtypes)["doc_ids"][6:-1]
    known = set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                ids, ef = np.frombuffer(r["ids"], f"<u{r['id_bytes']}"), (r["low_bits"], r["low"], r["high"], r["samples"])
                at = [i for i, d in enumerate(r["doc_ids"]) if d in known]
                found = [ids[select(i - 1, *ef) if i else 0 : select(i, *ef)].astype(np.int64) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_ids"][i] for i in at], b.schema.field("doc_ids").type.value_type), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"])

    holding = files.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(w) for w in wanted]).cast(f"array<{kind}>")))
    return holding.select("doc_ids", "id_bytes", "ids", "low_bits", "low", "high", "samples").mapInArrow(run, f"doc_id {kind}, ids array<long>")


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs' token files into the shared folder and describe every document as read back from them."""
    spark = docs.sparkSession
    out = new_path(spark, "tokens")
    with shuffles_freed(spark):
        write_token_files(docs, out, tokenizer)
    return read_documents(spark.read.parquet(out), digest=True)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_tokenizer())
