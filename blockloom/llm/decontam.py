"""Benchmark decontamination (operator 6): an FM-index for each training shard.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is 10 consecutive
words of an item (an item of fewer words, but not none, is one window). Test phrases are the
distinct windows; they are sent to the tasks in blocks of bounded size, one after the other, and every block is
held against all documents (one block, the usual case, takes one pass without a shuffle).

A shard is what one task has of the documents, some MB at a time. Its words become symbols of
the phrases' own vocabulary, every other word a separator. No window can contain a separator, so runs of
symbols shorter than the shortest phrase can't hold one and are left out: this is lossless. Over the
rest stand a suffix array, its Burrows-Wheeler transform in a wavelet matrix with rank
directories, and every SAMPLED-th suffix position. Backward search runs for all phrases at once;
occurrences are located by walking back to the next sampled position; overlapping
occurrences merge into spans of words.

Null texts have no words and are clean; null item ids are written "null". Repeated rows
get equal results; empty tables give no rows, an empty benchmark leaves all clean. Texts are never
cut (a text longer than a shard is a shard). ``documents`` is read by id and text alone;
``remove`` passes all other columns through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import rolling
from .common import discard, keyed, materialize, numbered, pieces, ragged, spans_of, text_of, unused

WINDOW = 10
SAMPLED = 8
SHARD_BYTES = 4 << 20
#: Text of the items whose phrases are sent to the tasks at once.
BLOCK_BYTES = 8 << 20

#: Every byte as a word byte in lower case, or else a space.
FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))
BETWEEN = np.array([FOLD[b] == 0x20 for b in range(256)])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Phrases:
    """Distinct windows of a block of items, by length, with the items of each: all in arrays, for a block has a million windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.code: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        words = [np.array([self.code.setdefault(x, len(self.code) + 1) for x in words_of(text)], np.int32) for _, text in items]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths, pairs = [], []
        for n in sorted({min(len(w), window) for w in words} - {0}):
            own = [(number[item], np.lib.stride_tricks.sliding_window_view(w, n)) for (item, _), w in zip(items, words) if min(len(w), window) == n]
            rows, code = np.unique(np.concatenate([v for _, v in own]), axis=0, return_inverse=True)
            ids = len(lengths) + np.arange(len(rows))
            pairs.append(np.stack([ids[code.ravel()], np.repeat([i for i, _ in own], [len(v) for _, v in own])]))
            self.by_length[n] = ids, rows.astype(np.int64)
            lengths += [n] * len(rows)
        self.shortest = min(self.by_length, default=0)
        self.length = np.array(lengths, np.int64)
        phrase, item = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
        self.at, self.item = spans_of(np.bincount(phrase, minlength=len(lengths))), item

    def items_of(self, phrases: np.ndarray) -> set[str]:
        """The items that have one of some phrases."""
        return {self.names[i] for p in set(phrases.tolist()) for i in self.item[self.at[p] : self.at[p + 1]].tolist()}


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the text ends with its own smallest symbol."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    n, step = len(text), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Bits:
    """A bit vector with ranks: bits in 64-bit words, and the ones before each word."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        self.word = np.zeros(len(flags) // 64 + 1, np.uint64)
        self.word.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.word), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many ones come before each place."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.word[w] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.word[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    def __init__(self, text: np.ndarray, sampled: int = SAMPLED):
        """text: symbols from 0; a last symbol of its own is added."""
        t = np.concatenate([text + 1, [0]]).astype(np.int64)
        self.n = n = len(t)
        sa = suffix_array(t)
        last = t[sa - 1]
        self.levels: list[tuple[int, Bits, int]] = []
        count = np.bincount(t)
        self.first = np.concatenate(([0], np.cumsum(count)))
        low = np.zeros(len(count), np.int64)  # where the run of each symbol begins in the lowest level
        symbols = np.arange(len(count))
        s = last
        for shift in range(int(t.max(initial=0)).bit_length() - 1, -1, -1):
            bit = (s >> shift & 1).astype(bool)
            bits, zeros = Bits(bit), int(n - bit.sum())
            self.levels.append((shift, bits, zeros))
            own = (symbols >> shift & 1).astype(bool)
            ones = bits.ones(low)
            low = np.where(own, zeros + ones, low - ones)
            s = np.concatenate([s[~bit], s[bit]])
        self.low = low
        mark = sa % sampled == 0
        self.mark, self.sample = Bits(mark), sa[mark]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c comes before place i of the transform."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(c >> shift & 1, zeros + ones, i - ones)
        return i - self.low[c]

    def back(self, i: np.ndarray) -> np.ndarray:
        """From a suffix to the one a place before it in the text: the symbol is read on the way down."""
        c = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            bit = bits.at(i)
            ones = bits.ones(i)
            i = np.where(bit, zeros + ones, i - ones)
            c |= bit.astype(np.int64) << shift
        return self.first[c] + i - self.low[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases: one row each. Row, first and end of the suffixes of those that occur."""
        row = np.arange(len(phrases))
        low, high = np.zeros(len(row), np.int64), np.full(len(row), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[row, k] + 1
            there = c < len(self.low)
            row, low, high, c = row[there], low[there], high[there], c[there]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            there = low < high
            row, low, high = row[there], low[there], high[there]
        return row, low, high

    def locate(self, i: np.ndarray) -> np.ndarray:
        out, left, steps = np.zeros(len(i), np.int64), np.arange(len(i)), 0
        while len(left):
            known = self.mark.at(i)
            out[left[known]] = self.sample[self.mark.ones(i[known])] + steps
            left, i = left[~known], self.back(i[~known])
            steps += 1
        return out


def shard_hits(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; then for each occurrence its text, its first word there, and its phrase."""
    split = [words_of(t) for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    none = np.zeros(0, np.int64)
    if not phrases.shortest or not n.sum():
        return n, none, none, none
    get = phrases.code.get
    code = np.zeros(int(n.sum()) + len(n) + 1, np.int64)  # a separator before every text and after the last
    at = spans_of(n + 1)
    code[ragged(at[:-1] + 1, n)] = np.fromiter((get(w, 0) for ws in split for w in ws), np.int64, int(n.sum()))
    # runs of symbols that could hold a phrase, each with one separator behind it
    inside = code > 0
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    long = end - start >= phrases.shortest
    start, size = start[long], (end - start)[long] + 1
    if not len(start):
        return n, none, none, none
    source = ragged(start, size)
    index = FMIndex(code[source])
    places, which = [none], [none]
    for ids, rows in phrases.by_length.values():
        row, low, high = index.search(rows)
        places.append(index.locate(ragged(low, high - low)))
        which.append(np.repeat(ids[row], high - low))
    place = source[np.concatenate(places)]
    text = np.searchsorted(at, place, side="right") - 1
    return n, text, place - at[text] - 1, np.concatenate(which)


def hit_words(n: np.ndarray, text: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A flag for every word of all texts, and the texts' offsets in it: merged spans of all occurrences."""
    at = spans_of(n)
    change = np.zeros(int(at[-1]) + 1, np.int64)
    np.add.at(change, at[text] + first, 1)
    np.add.at(change, at[text] + first + length, -1)
    return np.cumsum(change)[:-1] > 0, at


class Benchmark:
    """The items in blocks of some MB of text: one block's phrases at a time are on the driver and in the tasks."""

    def __init__(self, benchmark: DataFrame, window: int, id_col: str, text_col: str):
        self.window = window
        self.items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        self.blocks = int((self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES + 1)

    def phrases(self, block: int) -> Phrases:
        own = self.items.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.blocks)) == block)
        return Phrases([(r["item"], r["text"].encode()) for r in own.collect()], self.window)

    def sent(self, block: int):
        """A block's phrases as a broadcast: once for each executor, not for each task."""
        return self.items.sparkSession.sparkContext.broadcast(self.phrases(block))


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _grouped(text: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Texts that have an occurrence, and their parts of each column."""
    order = np.argsort(text, kind="stable")
    own, first = np.unique(text[order], return_index=True)
    return own, [np.split(c[order], first[1:]) if len(own) else [] for c in columns]


def _block_hits(rows: DataFrame, benchmark: Benchmark) -> DataFrame:
    """rows: (row, text). For several blocks: the occurrences of every document that has any, block after block, each written before the next begins."""
    schema = "row long, first array<int>, length array<int>, items array<string>"
    out = None
    for block in range(benchmark.blocks):
        sent = benchmark.sent(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            for b in pieces(batches, SHARD_BYTES):
                _, text, first, which = shard_hits(_bytes(b.column("text")), phrases)
                own, (firsts, groups) = _grouped(text, first, which)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").take(pa.array(own)), pa.array(firsts, pa.list_(pa.int32())), pa.array([phrases.length[g] for g in groups], pa.list_(pa.int32())), pa.array([sorted(phrases.items_of(g)) for g in groups], pa.list_(pa.string()))],
                    names=["row", "first", "length", "items"],
                )

        found = materialize(rows.mapInArrow(run, schema), "block-hits")
        sent.unpersist()
        out = found if out is None else out.unionByName(found)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return out.groupBy("row").agg(flat("first"), flat("length"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _of_lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of all occurrences that came with a batch."""
    n = [len(x or ()) for x in b.column("first").to_pylist()]
    values = [np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in b.column(c).to_pylist() if x]]) for c in ("first", "length")]
    return np.repeat(np.arange(len(n)), n), *values


def _summary(ids: pa.Array, n: np.ndarray, text: np.ndarray, first: np.ndarray, length: np.ndarray, found: list) -> pa.RecordBatch:
    hit, at = hit_words(n, text, first, length)
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[at[1:]] - total[at[:-1]]
    spans = []
    for i, k in enumerate(n_hit.tolist()):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[at[i] : at[i + 1]].view(np.int8), [0])))).tolist() if k else []
        spans.append(",".join(f"{x}:{y}" for x, y in zip(edge[::2], edge[1::2])))
    sha = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in found]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n), pa.array(n_hit), pa.array([len(s) for s in found], pa.int64()), pa.array(sha, pa.string()), pa.array(n_hit > 0), pa.array(spans, pa.string())],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
    )


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (first:end in words) of every row."""
    items = Benchmark(benchmark, window, item_col, item_text_col)
    rows = keyed(docs, id_col, text_col)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
    if items.blocks == 1:
        sent = items.sent(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            for b in pieces(batches, SHARD_BYTES):
                n, text, first, which = shard_hits(_bytes(b.column("text")), phrases)
                found: list[set] = [set() for _ in range(len(n))]
                own, (groups,) = _grouped(text, which)
                for t, g in zip(own.tolist(), groups):
                    found[t] = phrases.items_of(g)
                yield _summary(b.column("doc_id"), n, text, first, phrases.length[which], found)

        out = materialize(rows.mapInArrow(run, schema), "contamination")
        sent.unpersist()
        return out
    rows, _ = numbered(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, SHARD_BYTES):
            n = np.array([len(words_of(t)) for t in _bytes(b.column("text"))], np.int64)
            yield _summary(b.column("doc_id"), n, *_of_lists(b), [set(x or ()) for x in b.column("items").to_pylist()])

    out = materialize(rows.join(_block_hits(rows.select("row", "text"), items), "row", "left").mapInArrow(run, schema), "contamination")
    discard(rows)
    return out


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words; a run of them goes with what lies between them."""
    raw = np.frombuffer(text, np.uint8)
    start, end, _ = rolling.words(raw, np.array([0, len(raw)]), BETWEEN)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
    out, last = [], 0
    for x, y in zip(edge[::2], edge[1::2]):
        out.append(text[last : start[x]])
        last = int(end[y - 1])
    return b"".join([*out, text[last:]])


def _without(b: pa.RecordBatch, text_col: str, n: np.ndarray, text: np.ndarray, first: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    changed = set(text.tolist())
    if not changed:
        return b
    hit, at = hit_words(n, text, first, length)
    new, texts = b.column(text_col).to_pylist(), _bytes(b.column(text_col))
    for i in changed:
        new[i] = cut(texts[i], hit[at[i] : at[i + 1]]).decode()
    arrays = dict(zip(b.schema.names, b.columns))
    arrays[text_col] = pa.array(new, b.schema.field(text_col).type)
    if "n_chars" in arrays and pa.types.is_integer(arrays["n_chars"].type):
        arrays["n_chars"] = pa.array([len(new[i]) if i in changed else c for i, c in enumerate(arrays["n_chars"].to_pylist())], arrays["n_chars"].type)
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with the spans removed from the texts; all rows and columns stay, and n_chars, where it is a column, is counted anew for the texts that change."""
    items = Benchmark(benchmark, window, item_col, item_text_col)
    if items.blocks == 1:
        sent = items.sent(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = sent.value
            for b in pieces(batches, SHARD_BYTES, text_col):
                n, text, first, which = shard_hits(_bytes(b.column(text_col)), phrases)
                yield _without(b, text_col, n, text, first, phrases.length[which])

        out = materialize(docs.mapInArrow(run, docs.schema), "decontaminated")
        sent.unpersist()
        return out
    # all blocks are judged on the input, then everything goes at once
    names, schema = docs.columns, docs.schema
    docs, row = numbered(docs)
    texts = docs.select(F.col(row).alias("row"), text_of(text_col).alias("text"))
    hits = _block_hits(texts, items).select(F.col("row").alias(row), F.struct("first", "length").alias(found := unused(docs, "found")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, SHARD_BYTES, text_col):
            n = np.array([len(words_of(t)) for t in _bytes(b.column(text_col))], np.int64)
            lists = [x or {} for x in b.column(found).to_pylist()]
            lists = pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in lists], pa.list_(pa.int32())) for c in ("first", "length")], names=["first", "length"])
            yield _without(b.select(names), text_col, n, *_of_lists(lists))

    out = materialize(docs.join(hits, row, "left").mapInArrow(run, schema), "decontaminated")
    discard(docs)
    return out
