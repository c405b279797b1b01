"""Where passages of a fixed number of units recur: the steps that operators 4 and 9 share.

A method gives every window of a document a key that follows from the window's units alone, the
same for stretches of neighbouring windows. Then:

1. Each stretch becomes a record (key, document, place); its context is all its units. Within a task, a record whose
   context came before, compared byte by byte, is known to recur and leaves as a range, so that a hot
   passage sends one record for each piece of a task, not one for each copy.
2. Records meet by key. Where a key has company, its contexts are asked for. A key that has BUSY contexts within one
   piece would crowd one place (a line common to a third of all documents): its records are dealt
   by place instead, all ask, and a sign at the key's own place makes the records of other tasks ask too. So do keys
   with a context that may have one window twice (a short period): it needs no company to recur.
3. Contexts that are asked for are cut from the texts and compared by key, by the method's own means. The contexts of a key that
   over HOT records ask for go through the same steps once more, as texts of their own, with the whole window as the
   key: so a hot key is split by what stands around it.
4. Ranges are merged by document.

Every equal pair of windows has one key at either depth, so none is missed. Keys are hashes and only bring contexts
together: no range is removed but by a comparison of bytes or words. HOT and BUSY change where the work is done, never
a result. Steps are written to the shared folder; nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import discard, few, materialize, numbers, pieces, ragged, rank_of, same_slices, spans_of, text_bytes
from .rolling import Rolling, mix

PIECE_BYTES = 2 << 20
COMPARE_BYTES = 1 << 19
HOT = 2_000
BUSY = 8


@dataclass(frozen=True)
class Units:
    """The units of all texts of a piece: canonical bytes, hashes of any run of them, offsets of texts, first and end byte of each unit."""

    raw: np.ndarray
    hashes: Callable[[], Rolling]
    at: np.ndarray
    first: np.ndarray
    end: np.ndarray
    names: np.ndarray | None = None
    #: what the keys are the least of, for methods that need it again
    grams: Callable[[], np.ndarray] | None = None


@dataclass(frozen=True)
class Method:
    window: int
    #: windows in a stretch at most; bounds the size of a context
    stretch: int
    #: only documents with a smaller id count as earlier, not earlier places of the same one
    other_document: bool
    #: raw bytes, text offsets -> Units
    units: Callable
    #: Units -> key of the window at each unit
    keys: Callable
    #: contexts (list of bytes), ranks, rows, places -> (index of each recurring window's context, first unit relative to it)
    compare: Callable
    #: Units, keys, first and end unit of contexts -> those that may have a window twice; only where earlier places of one document count
    lone: Callable | None = None

    def by_window(self) -> Method:
        """The same comparison with whole windows as keys."""
        return replace(self, stretch=1, lone=None, keys=lambda u: u.hashes().of(np.arange(len(u.first)), np.minimum(np.arange(len(u.first)) + self.window, len(u.first))))


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges in order of document and place, overlapping or touching ones made one."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((hi, lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    # the largest end so far, document by document
    base = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1]))) << 33
    top = np.maximum.accumulate(hi + base)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (lo[1:] + base[1:] > top[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], lo[first], (top - base)[last]


#: place: first unit, number of units and two flags in one number, for records are the bulk of what is shuffled.
#: A known range's first and end unit stand in the place of its key.
RECORD = "key long, piece long, place long"
MOST_UNITS = 255
PLAIN, KNOWN, SEVERAL, SIGN = range(4)


def _record_batch(key, piece, lo, hi, flag: int) -> pa.RecordBatch:
    lo, hi = lo.astype(np.int64), hi.astype(np.int64)
    key = lo << 31 | hi if flag == KNOWN else key.view(np.int64)
    place = np.full(len(lo), flag) if flag == KNOWN else lo << 10 | (hi - lo) << 2 | flag
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(piece.astype(np.int64)), pa.array(place.astype(np.int64))], names=["key", "piece", "place"])


def _records(method: Method, busy: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, PIECE_BYTES):
            u = method.units(*text_bytes(b.column("text")))
            ua = u.at
            count = np.maximum(np.diff(ua) - method.window + 1, 0)
            start = ragged(ua[:-1], count)
            if not len(start):
                continue
            keys = method.keys(u)
            key = keys[start]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)))
            first = np.flatnonzero(new)
            size = np.diff(np.concatenate((first, [len(start)])))
            many = -(-size // method.stretch)
            part = ragged(np.zeros(len(many), np.int64), many)
            run_first, run_size = np.repeat(first, many) + part * method.stretch, np.minimum(np.repeat(size, many) - part * method.stretch, method.stretch)
            lo = start[run_first]
            hi = lo + run_size - 1 + method.window
            key = key[run_first]
            alone = method.lone(u, keys, lo, hi) if method.lone else np.zeros(len(lo), bool)
            with np.errstate(over="ignore"):
                both = mix(key ^ mix(u.hashes().of(lo, hi)))
            text = np.searchsorted(ua, lo, side="right") - 1
            rank, row, base = rank_of(numbers(b.column("late")), numbers(b.column("ord")))[text], numbers(b.column("row"))[text], numbers(b.column("base"))[text]
            x, y = u.first[lo], u.end[hi - 1]
            place = base + lo - ua[text]
            # contexts that look equal within the piece: by document, then place
            order = np.lexsort((place, rank)) if len(ua) > 2 and ((rank[1:] < rank[:-1]).any() or base.any()) else np.arange(len(lo))
            order = order[np.argsort(both[order], kind="stable")]
            head = np.concatenate(([True], both[order][1:] != both[order][:-1]))
            of = np.empty(len(lo), np.int64)
            of[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            known = rank > rank[of]
            if not method.other_document:
                known |= (row == row[of]) & (place > place[of])
            k = np.flatnonzero(known & (y - x == y[of] - x[of]))
            # the hash found them, the bytes decide
            k = k[same_slices(u.raw, x[k], x[of[k]], (y - x)[k])]
            o = np.ones(len(lo), bool)
            o[k] = False
            o = np.flatnonzero(o)
            lo, hi = lo - ua[text], hi - ua[text]
            piece = numbers(b.column("piece"))[text]
            # keys with many contexts even here: their records are dealt by place, and a sign at the key's place says so
            tops, contexts = np.unique(key[order[head]], return_counts=True)
            # a context with a window twice asks without company, in the same way
            tops = np.union1d(tops[contexts >= busy], key[alone])
            if len(tops):
                hot = np.isin(key[o], tops)
                h, o = o[hot], o[~hot]
                yield _record_batch(key[h], piece[h], lo[h], hi[h], SEVERAL)
                zero = np.zeros(len(tops), np.int64)
                yield _record_batch(tops, zero, zero, zero, SIGN)
            yield _record_batch(key[o], piece[o], lo[o], hi[o], PLAIN)
            if len(k):
                yield _record_batch(None, *_merged(piece[k], lo[k], hi[k]), KNOWN)

    return run


MARK = "piece long, lo int, hi int, key long, known boolean"


def _mark_batch(piece, lo, hi, key, known: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(key), pa.array(np.full(len(piece), known))], names=["piece", "lo", "hi", "key", "known"])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over records sorted by key: those whose key has company ask. Holds back one record at most, the first of the key at hand."""
    last, held = None, None
    for b in batches:
        key, piece, place = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "piece", "place"))
        known = (place & 3) == KNOWN
        if known.any():
            yield _mark_batch(piece[known], key[known] >> 31, key[known] & ((1 << 31) - 1), key[known], True)
            key, piece, place = (x[~known] for x in (key, piece, place))
        if not len(key):
            continue
        lo, flag = place >> 10, place & 3
        hi = lo + (place >> 2 & MOST_UNITS)
        part = np.cumsum(np.concatenate(([key[0] != last], key[1:] != key[:-1])))  # 0: goes on with the last key
        count = np.bincount(part)
        several = np.bincount(part, flag >= SEVERAL) > 0
        company = (count > 1) | several
        if not part[0]:
            company[0] = True
            if held is not None:
                yield held
        held = None
        ask = company[part] & (flag != SIGN)
        if ask.any():
            yield _mark_batch(piece[ask], lo[ask], hi[ask], key[ask], False)
        if not company[-1]:
            held = _mark_batch(piece[-1:], lo[-1:], hi[-1:], key[-1:], False)
        last = key[-1]


CONTEXT = "key long, row long, late boolean, ord long, places array<int>, context binary, units int"


def _contexts(method: Method):
    """The contexts that a text is asked for, once each; where places of a row count, later ones of an equal context are ranges known already (units without a context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, PIECE_BYTES):
            u = method.units(*text_bytes(b.column("text")))
            asked = b.column("asked")
            n = np.asarray(pc.list_value_length(asked)).astype(np.int64)
            flat = asked.flatten()
            key, lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            text = np.repeat(np.arange(len(n)), n)
            x, y = u.first[u.at[text] + lo], u.end[u.at[text] + hi - 1]
            data, own = u.raw.tobytes(), {}
            for t, k, a, z, p, q in sorted(zip(text.tolist(), key.tolist(), x.tolist(), y.tolist(), lo.tolist(), hi.tolist())):
                own.setdefault((t, k, data[a:z]), [q - p]).append(p)
            rows = []
            base = [p.as_py() for p in b.column("places")]
            for (t, k, c), (size, *places) in own.items():
                if method.other_document:
                    rows.append((k, t, [p + q for q in base[t] for p in places], c, None))
                else:
                    rows.append((k, t, [base[t][0] + places[0]], c, None))
                    if len(places) > 1:
                        rows.append((None, t, [base[t][0] + p for p in places[1:]], None, size))
            for i in range(0, len(rows), 4096):  # small batches out
                k, t, places, c, size = zip(*rows[i : i + 4096])
                at = pa.array(t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int64()), b.column("row").take(at), b.column("late").take(at), b.column("ord").take(at), pa.array(places, pa.list_(pa.int32())), pa.array(c, pa.binary()), pa.array(size, pa.int32())],
                    names=[c.split()[0] for c in CONTEXT.split(", ")],
                )

    return run


RANGE = "row long, lo int, hi int"


def _ranges(row, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["row", "lo", "hi"])


def _comparison(method: Method):
    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        row, places = numbers(t.column("row")), t.column("places").combine_chunks()
        at = places.offsets.to_numpy().astype(np.int64)
        flat = places.values.to_numpy().astype(np.int64)
        found, first = method.compare(t.column("context").to_pylist(), rank_of(numbers(t.column("late")), numbers(t.column("ord"))), row, flat[at[:-1]])
        many = np.diff(at)[found]
        lo = flat[ragged(at[:-1][found], many)] + np.repeat(first, many)
        return _ranges(*_merged(np.repeat(row[found], many), lo, lo + method.window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), b.num_rows]
            _, at = text_bytes(b.column("context"))
            done = 0
            for x in bounds[:-1]:
                # at the begin of a key what is held may go
                if (x or key[0] != last) and size + at[x] - at[done] >= COMPARE_BYTES:
                    if x > done:
                        held.append(b.slice(done, x - done))
                    if held:
                        yield work(held)
                    held, size, done = [], 0, x
            held.append(b.slice(done))
            size += int(at[-1] - at[done])
            last = key[-1]
        if held:
            yield work(held)

    return run


def _windows(method: Method):
    """Contexts of one window each, sorted by key, rank and place. Of each key the distinct windows met so far (one, where no hashes clash) stay at hand, each with the earliest document and the last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = None, {}
        for b in batches:
            out = []
            for key, row, late, ord_, places, context in zip(*(b.column(c).to_pylist() for c in ("key", "row", "late", "ord", "places", "context"))):
                if key != last:
                    last, met = key, {}
                first = met.setdefault(context, [late, ord_, None])  # with the last row of this id
                if (late, ord_) > (first[0], first[1]) or not method.other_document and row == first[2]:
                    out += [(row, p, p + method.window) for p in places]
                first[2] = row
            if out:
                yield _ranges(*np.array(out, np.int64).T)

    return run


def _pass(docs: DataFrame, method: Method, hot: int, busy: int, deep: bool, done: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: piece, row, late, ord, base, places, text. Ranges by piece that are known from the piece's own task, and ranges by row: later places of equal contexts, and what comparisons found. done: gathers the tables that are needed no longer than these."""
    by = F.when(F.col("place").bitwiseAND(F.lit(3)).isin(SEVERAL, KNOWN), F.xxhash64("key", "piece", "place")).otherwise(F.col("key"))
    records = docs.select("piece", "row", "late", "ord", "base", "text").mapInArrow(_records(method, busy), RECORD)
    marks = records.repartition(by).sortWithinPartitions("key").mapInArrow(_marks, MARK)
    marks = marks.groupBy("piece").agg(F.collect_list(F.when(F.col("known"), F.struct("lo", "hi"))).alias("known"), F.collect_list(F.when(~F.col("known"), F.struct("key", "lo", "hi"))).alias("asked"))
    marks = materialize(marks, "marks")

    asked = marks.where(F.size("asked") > 0).select("piece", "asked")
    contexts = docs.select("piece", "row", "late", "ord", "places", "text").join(asked, "piece").mapInArrow(_contexts(method), CONTEXT)
    contexts = materialize(contexts, "contexts")
    done += [marks, contexts]
    later = contexts.where("context is null").select("row", F.explode("places").alias("lo"), "units").select("row", "lo", (F.col("lo") + F.col("units")).alias("hi"))
    contexts = contexts.where("context is not null").drop("units")
    if deep:
        found = contexts.repartition("key").sortWithinPartitions("key", "late", "ord", "row", "places").mapInArrow(_windows(method), RANGE)
        return marks, later, materialize(found, "found-by-window")
    # how many contexts a key has: few keys have very many
    crowded = materialize(asked.select(F.explode("asked.key").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "crowded")
    if crowded.isEmpty():
        found = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_comparison(method), RANGE)
        return marks, later, materialize(found, "found")
    crowded = few(crowded)
    cold = contexts.join(crowded, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_comparison(method), RANGE)
    found = materialize(cold, "found")
    # the contexts of hot keys as texts of their own
    texts = contexts.join(crowded, "key", "left_semi").select(F.monotonically_increasing_id().alias("piece"), "row", "late", "ord", F.element_at("places", 1).alias("base"), "places", F.col("context").alias("text"))
    texts = materialize(texts, "hot-contexts")
    done.append(texts)
    inner, more, deeper = _pass(texts, method.by_window(), hot, busy, True, done)
    inside = texts.select("piece", "row", "places").join(inner.where(F.size("known") > 0).select("piece", "known"), "piece")
    inside = inside.select("row", F.explode("places").alias("p"), "known").select("row", "p", F.inline("known")).select("row", (F.col("p") + F.col("lo")).alias("lo"), (F.col("p") + F.col("hi")).alias("hi"))
    return marks, later, found.unionByName(more).unionByName(deeper).unionByName(inside)


def with_ranges(rows: DataFrame, method: Method, hot: int = HOT, busy: int = BUSY) -> tuple[DataFrame, list[DataFrame]]:
    """rows: (row, late, ord, text, …). Every row with known and found, arrays of struct(lo, hi) in units; and the scratch tables that go once this is written."""
    if method.window - 1 + method.stretch > MOST_UNITS:
        raise ValueError(f"a context has at most {MOST_UNITS} units")
    docs = rows.select(F.col("row").alias("piece"), "row", "late", "ord", F.lit(0).alias("base"), F.array(F.lit(0)).alias("places"), "text")
    marks, later, found = _pass(docs, method, hot, busy, False, done := [])
    found = materialize(found.unionByName(later).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("found")), "ranges")
    discard(*done[1:])
    known = marks.where(F.size("known") > 0).select(F.col("piece").alias("row"), "known")
    return rows.join(known, "row", "left").join(found, "row", "left"), [rows, marks, found]


def covered(batch: pa.RecordBatch, offsets: np.ndarray) -> np.ndarray:
    """A flag for every unit of a batch of with_ranges."""
    total = int(offsets[-1])
    change = np.zeros(total + 1, np.int64)
    for name in ("known", "found"):
        column = batch.column(name)
        if column.null_count == len(column):
            continue
        n = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
        flat = column.flatten()
        text = np.repeat(np.arange(len(n)), n)
        lo = flat.field(0).to_numpy(zero_copy_only=False) + offsets[text]
        hi = flat.field(1).to_numpy(zero_copy_only=False) + offsets[text]
        change += np.bincount(lo, minlength=total + 1) - np.bincount(hi, minlength=total + 1)
    return np.cumsum(change)[:-1] > 0
