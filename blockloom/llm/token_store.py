"""Token ids in fixed-width bit packing (operator 1).

A store is a folder of shards that Spark's writer commits, so a lost executor leaves no half
shard. Each row of a shard is a block of whole documents: ids packed in the vocabulary's
minimum bits (little-endian bit order, token i at bit i * width), the ids of its documents and the
offsets of their tokens. Token i of a block is found without the tokens before it, and any slice
unpacks by numpy. Shards hold ascending ranges of doc_id, blocks ascend within them; the
manifest (one row per shard) gives the tokens before each shard. A block's least and greatest doc_id are columns of their
own: a search for documents filters on them in the scan and reads the payloads of the few blocks that can hold them.

Encoding: where the tokenizer's own steps drop white space and never join what stands on two sides of it
(``splits_at_space``), each distinct word is encoded once and looked up by its bytes; any other
tokenizer gets whole texts, unchanged.

Null text counts as empty and has the end id alone; null doc_ids come last, by a hash of the text, and any number may be an id. Repeated rows
are stored each, one after the other. An empty table gives an empty store. A text of any length is
one document of one block. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import rolling
from .common import few, keyed, materialize, pieces, ragged, scratch_root, settings, spans_of, text_bytes

BLOCK_TOKENS = 1 << 18
#: n_null: documents without an id, the last ones of the block; least and greatest of the other ids (null without any).
BLOCK_SCHEMA = "shard int, block int, before long, n_docs int, n_null int, least long, greatest long, n_tokens long, width int, doc_ids binary, offsets binary, payload binary"

_memories: dict = {}


def width_of(vocabulary: int) -> int:
    """Bits that the largest id needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return np.ascontiguousarray(ids).astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(np.ascontiguousarray(ids).astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32)[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Tokens start..stop of a block, as uint32; only their bytes are read."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", stop - start, start * width // 8).astype(np.uint32)
    low, high = start * width >> 3, (stop * width + 7) >> 3
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")
    skip = start * width - 8 * low
    bits = bits[skip : skip + (stop - start) * width].reshape(-1, width)
    full = np.zeros((len(bits), 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


class Library:
    """The tokenizers library on pieces of text.

    A piece of letters is encoded in a run of pieces joined by spaces; every piece's last token is an
    end-of-word token, which gives the borders back. A run whose borders don't add up, and all other pieces, are
    encoded piece by piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        suffix = getattr(self.t.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.t.get_vocab_size(with_added_tokens=True), bool)
        if suffix:
            self.last[[i for w, i in self.t.get_vocab(with_added_tokens=False).items() if w.endswith(suffix)]] = True
        #: a mark behind letters is a piece of its own
        self.marks = {m: self.one([m])[0] for m in ".,"} if suffix else {}

    def one(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, new: list[str]) -> list[list[int]]:
        if not self.marks:
            return self.one(new)
        bare = [s[:-1] if s[-1] in self.marks else s for s in new]
        own = [b if b.isalpha() else s for b, s in zip(bare, new)]
        stems: dict[str, list] = dict.fromkeys(own)
        plain = [w for w in stems if w.isalpha()]
        for i in range(0, len(plain), 256):
            run = plain[i : i + 256]
            ids = self.one([" ".join(run)])[0]
            cut = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(cut) == len(run):
                stems.update(zip(run, [ids[x:y] for x, y in zip([0, *cut], cut)]))
        rest = [w for w, ids in stems.items() if ids is None]
        stems.update(zip(rest, self.one(rest)))
        return [stems[w] if w is s else stems[w] + self.marks[s[-1]] for w, s in zip(own, new)]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
MOST_WORDS = 1_500_000
#: Bytes of long words that are kept at hand.
MOST_BYTES = 64 << 20
#: Words of up to so many bytes are numbers: their bytes, and their length in the highest byte.
SHORT = 7
_MASK = np.array([(1 << 8 * n) - 1 for n in range(SHORT + 1)], np.uint64)

# Steps that keep texts apart at white space.
NORMAL_STEPS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_space(spec: dict) -> bool:
    """Do a tokenizer's own steps give the same ids word by word? Its normalizer may only be of NORMAL_STEPS, its pre-tokenizer must keep the matches of SPLIT and drop the rest, and its added tokens must stand for themselves."""
    normal, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", []) if normal.get("type") == "Sequence" else [normal] if normal else []
    parts = before.get("pretokenizers", []) if before.get("type") == "Sequence" else [before]
    split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    levels = [p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex", True) for p in parts[1:]]
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) and not set(t["content"]) & set(" \t\n\v\f\r") and len(t["content"].encode()) > 1 for t in spec["added_tokens"])
    return all(x in NORMAL_STEPS for x in steps) and parts[:1] == [split] and all(levels) and plain


class WordMemory:
    """Ids of words met before, found by the words' own bytes: short ones as numbers in sorted arrays, long ones in a dictionary. Emptied beyond ``most`` words."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {}])
        self.by_word = splits_at_space(spec)
        self.lower = any(x.get("type") == "Lowercase" for x in steps)
        #: the first two bytes of added tokens: a text that holds them keeps its letters
        self.marks = sorted({t["content"].encode()[:2] for t in spec["added_tokens"]})
        self.library, self.most = Library(path), most
        self.clear()

    def clear(self) -> None:
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.long: dict[bytes, int] = {}
        self.start, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids, self.words, self.used, self.held = np.zeros(1 << 18, np.uint32), 0, 0, 0

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each short word, or -1."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.slot[at], -1)

    def slots_of(self, words: list[bytes]) -> list[int]:
        short = [len(w) <= SHORT for w in words]
        key = np.array([int.from_bytes(w, "little") | len(w) << 56 for w, s in zip(words, short) if s], np.uint64)
        found = iter(self.find(key).tolist())
        return [next(found) if s else self.long.get(w, -1) for w, s in zip(words, short)]

    def learn(self, words: list[bytes]) -> np.ndarray:
        """New slots for distinct words. Letters that were met before, with a mark behind them now, are not encoded again."""
        tail = {m.encode()[0]: ids for m, ids in self.library.marks.items()}
        texts = [w.decode() for w in words]
        stem = [s if w[-1] in tail and t[:-1].isalpha() else -1 for w, t, s in zip(words, texts, self.slots_of([w[:-1] for w in words]))]
        fresh = iter(self.library.encode([t for t, s in zip(texts, stem) if s < 0]))
        ids = [next(fresh) if s < 0 else self.known(s) + tail[w[-1]] for w, s in zip(words, stem)]
        n, counts = len(words), np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(counts.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.words + n > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        self.ids[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
        slots = np.arange(self.words, self.words + n)
        self.count[slots], self.start[slots] = counts, self.used + spans_of(counts)[:-1]
        self.words, self.used = self.words + n, self.used + total
        return slots

    def known(self, slot: int) -> list[int]:
        return self.ids[self.start[slot] : self.start[slot] + self.count[slot]].tolist()

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts in a buffer, and how many each has."""
        if not self.by_word:
            ids = self.library.one(_texts(raw, at))
            return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64)
        low = raw
        if self.lower:  # the tokenizer's own step, taken first so that fewer words differ
            low = LOWER[raw]
            for mark in self.marks:
                for i in _holding(raw, at, mark):
                    low[at[i] : at[i + 1]] = raw[at[i] : at[i + 1]]
        start, end, n = rolling.words(low, at)
        if not len(start):
            return np.zeros(0, np.uint32), n
        size = end - start
        slot = np.empty(len(start), np.int64)
        short = np.flatnonzero(size <= SHORT)
        long = np.flatnonzero(size > SHORT)
        u, code = np.unique((rolling.eights(low)[start[short]] & _MASK[size[short]]) | (size[short].astype(np.uint64) << np.uint64(56)), return_inverse=True)
        text = low.tobytes()
        names = [text[x:y] for x, y in zip(start[long].tolist(), end[long].tolist())]
        if self.words + len(u) + len(names) > self.most and self.words or self.held > MOST_BYTES:
            self.clear()
        of = self.find(u)
        new = np.flatnonzero(of < 0)
        words = [int(x).to_bytes(8, "little")[: int(x) >> 56] for x in u[new].tolist()]
        more = list({w: None for w in names if w not in self.long})
        if words or more:
            got = self.learn(words + more)
            of[new] = got[: len(words)]
            place = np.searchsorted(self.key, u[new])
            self.key, self.slot = np.insert(self.key, place, u[new]), np.insert(self.slot, place, of[new])
            self.long.update(zip(more, got[len(words) :].tolist()))
            self.held += sum(map(len, more))
        slot[short] = of[code]
        slot[long] = np.fromiter(map(self.long.__getitem__, names), np.int64, len(names))
        counts = self.count[slot].astype(np.int64)
        return self.ids[ragged(self.start[slot], counts)], np.diff(spans_of(counts)[spans_of(n)])


def _texts(raw: np.ndarray, at: np.ndarray) -> list[str]:
    data = raw.tobytes()
    return [data[x:y].decode() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


def _holding(raw: np.ndarray, at: np.ndarray, what: bytes) -> list[int]:
    """The texts that hold a two-byte string."""
    place = np.flatnonzero((raw[:-1] == what[0]) & (raw[1:] == what[1]))
    return np.unique(np.searchsorted(at, place, side="right") - 1).tolist()


def _memory(path: str) -> WordMemory:
    if path not in _memories:
        _memories[path] = WordMemory(path)
    return _memories[path]


def vocabulary_of(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encode_texts(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and the number of each text."""
    return _memory(path).encode(np.frombuffer(b"".join(texts), np.uint8), spans_of(np.array([len(t) for t in texts], np.int64)))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode and store all documents under ``path``."""
    vocabulary = vocabulary_of(tokenizer)
    width = width_of(max(vocabulary, end_id + 1))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, parts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            offsets, own = spans_of(np.concatenate(counts)), pa.chunked_array(ids, pa.int64())
            known = own.drop_null().to_numpy()  # ascending, and all before the nulls
            row = [shard, block, before, len(own), own.null_count, *([int(known[0]), int(known[-1])] if len(known) else [None, None]), int(offsets[-1]), width]
            row += [own.fill_null(0).to_numpy().astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), pack(np.concatenate(parts), width)]
            kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in BLOCK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for b in pieces(batches, 2 << 20):
            flat, n = _memory(tokenizer).encode(*text_bytes(b.column("text")))
            at = spans_of(n)
            out = np.full(len(flat) + len(n), end_id, np.uint32)
            out[ragged(at[:-1] + np.arange(len(n)), n)] = flat
            first, end = 0, spans_of(n + 1)
            while first < len(n):  # documents until the block is full
                stop = min(len(n), int(np.searchsorted(end, end[first] + block_tokens - size)))
                ids.append(b.column("doc_id").slice(first, stop - first))
                counts.append((n + 1)[first:stop])
                parts.append(out[end[first] : end[stop]])
                size += int(end[stop] - end[first])
                first = stop
                if size >= block_tokens:
                    yield flush()
                    block, before = block + 1, before + size
                    ids, counts, parts, size = [], [], [], 0
        if size:
            yield flush()

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = keyed(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    with settings(docs.sparkSession):
        rows.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard, base: the tokens before each shard. One row per shard meets in one task."""
    totals = spark.read.schema(BLOCK_SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with the tokens before each (``start``)."""
    # one row per shard is broadcast where it is counted to be few, so the payloads don't move
    return spark.read.schema(BLOCK_SCHEMA).parquet(path).join(few(manifest(spark, path)), "shard").withColumn("start", F.col("base") + F.col("before"))


def _ids(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block's documents, and which of them are there at all."""
    return np.frombuffer(r["doc_ids"], "<i8"), np.arange(r["n_docs"]) < r["n_docs"] - r["n_null"]


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (ids, there), at = _ids(r), np.frombuffer(r["offsets"], "<i8")
                flat = unpack(r["payload"], r["width"], 0, r["n_tokens"]).astype("<u4")
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~there), pa.array(at[:-1] + r["start"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    out = read(spark, path).select("start", "n_docs", "n_null", "n_tokens", "width", "doc_ids", "offsets", "payload")
    return materialize(out.mapInArrow(unpacked, "doc_id long, start long, n_tokens long, ids_crc32 long"), "token-digests", 8)


def holding(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The blocks whose range of ids has one of a few: a filter on two columns that the scan pushes down, so that other blocks' payloads are not read."""
    some = F.lit(False)
    for i in sorted(set(doc_ids)):
        some = some | (F.col("least") <= i) & (F.col("greatest") >= i)
    return spark.read.schema(BLOCK_SCHEMA).parquet(path).where(some)


def tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Random access: the ids of a few documents (a filter holds so many terms). Only blocks that can hold one are read, and only the documents' own tokens are unpacked."""
    wanted = np.array(sorted(set(doc_ids)), np.int64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (ids, there), at = _ids(r), np.frombuffer(r["offsets"], "<i8")
                for i in np.flatnonzero(np.isin(ids, wanted) & there).tolist():
                    got = unpack(r["payload"], r["width"], int(at[i]), int(at[i + 1]))
                    yield pa.RecordBatch.from_arrays([pa.array([int(ids[i])], pa.int64()), pa.array([got.tobytes()], pa.binary())], names=["doc_id", "ids"])

    rows = holding(spark, path, doc_ids).select("n_docs", "n_null", "width", "doc_ids", "offsets", "payload")
    with settings(spark, 8):
        return {r["doc_id"]: np.frombuffer(bytes(r["ids"]), np.uint32) for r in rows.mapInArrow(pick, "doc_id long, ids binary").collect()}


def new_path(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
