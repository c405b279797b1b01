"""Substring dedup over bytes by longest-previous-factor arrays (operator 9).

A byte goes if it is in a string of 100 bytes that also starts earlier: in a document with a smaller
id, or earlier in its own. A window of 100 bytes is looked up by the least hash of its 32-byte
strings; contexts with one key come together (``repeats``), and there a suffix array is built. For every
suffix, the nearest suffixes before and behind it in suffix order that start earlier in the corpus
are found (previous and next smaller positions); the longer of the two common prefixes is
the longest previous factor, and where it is 100 bytes or more, the window is a later copy.

Null texts count as empty, null ids come last. Rows of one id, with equal texts or others, take nothing from each
other. Texts of fewer than 100 bytes stay whole. Empty tables give no rows.
Texts are never cut. Columns besides id and text are not read. Spans may split a character: they are bytes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import rolling
from .common import discard, materialize, numbered, ordered, pieces, ragged, spans_of, text_bytes
from .repeats import BUSY, HOT, Method, Units, covered, with_ranges

WINDOW = 100
GRAM = 32


def _units(gram: int):
    def units(raw: np.ndarray, at: np.ndarray) -> Units:
        place = np.arange(len(raw))
        return Units(raw, functools.cache(lambda: rolling.of_bytes(raw)), at, place, place + 1, grams=functools.cache(lambda: rolling.grams(raw, gram)))

    return units


def _sliding(x: np.ndarray, width: int, pick: np.ufunc, rest: int) -> np.ndarray:
    """pick over x[i : i + width] at each place, by two blocks' running values."""
    n = len(x)
    block = np.full(-(-n // width) * width, rest, np.uint64)
    block[:n] = x
    block = block.reshape(-1, width)
    ahead = pick.accumulate(block, axis=1).ravel()
    behind = pick.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[np.minimum(np.arange(n) + width - 1, len(ahead) - 1)])


def _keys(window: int, gram: int):
    def keys(u: Units) -> np.ndarray:
        """The least hash of all grams of the window at each place."""
        out = np.zeros(len(u.raw), np.uint64)
        if len(g := u.grams()):
            out[: len(g)] = _sliding(g, window - gram + 1, np.minimum, (1 << 64) - 1)
        return out

    return keys


def _lone(window: int, gram: int):
    """Contexts that may have one window twice. Two equal windows with one key lie less than a window's grams apart, so their least gram
    comes twice at that distance; and no other gram between is the least of any window, as that window has one of the two."""
    width = window - gram + 1

    def lone(u: Units, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        g = u.grams()
        # no window has a key above its own grams, so the greatest key around a gram is its own where it is the least of one
        least = np.flatnonzero(_sliding(np.concatenate([np.zeros(width - 1, np.uint64), keys[: len(g)]]), width, np.maximum, 0)[: len(g)] == g)
        again = np.flatnonzero((g[least[1:]] == g[least[:-1]]) & (least[1:] - least[:-1] < width))
        first, second = least[again], least[again + 1]
        i = np.searchsorted(first, lo)
        return np.concatenate([second, [len(u.raw)]])[i] <= hi - gram

    return lone


def ranks(text: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the valid places by their first ``window`` bytes, and a class number for equal ones, by prefix doubling. Places are ranked by 8 bytes first."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    first = np.zeros(n, np.uint64)
    size = min(8, window)
    for i in range(size):
        first = (first << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(first)
    rank = np.empty(n, np.int64)
    ordered = first[order]
    rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    while size * 2 < window:
        key = rank * (n + 1)
        key[: n - size] += rank[size:] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        size *= 2
    # two overlapping halves give the whole window; only windows within one context take part
    key = rank[valid] * (n + 1) + (rank[valid + window - size] if window > size else 0)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    return valid[order], np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))


def previous_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1; all places jump at once."""
    p = np.arange(len(v)) - 1
    left = np.arange(len(v))
    while len(left):
        left = left[p[left] >= 0]
        left = left[v[p[left]] >= v[left]]
        p[left] = p[p[left]]
    return p


def _factors(order: np.ndarray, group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of suffixes in order those with a longest previous factor of a whole window: an equal one (same group) at a smaller place is nearest on one side."""
    v = place[order]
    before = previous_smaller(v)
    behind = len(v) - 1 - previous_smaller(v[::-1])[::-1]
    return (before >= 0) & (group[np.maximum(before, 0)] == group) | (behind < len(v)) & (group[np.minimum(behind, len(v) - 1)] == group)


def later_copies(text: np.ndarray, valid: np.ndarray, rank: np.ndarray, row: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """Of the valid places those whose longest previous factor has ``window`` bytes. rank, row, place: of each byte's document, and where it is there."""
    order, group = ranks(text, valid, window)
    if len(np.unique(rank)) == len(np.unique(row)):
        return order[_factors(order, group, (rank << 40) + place)]
    # rows of one id: earlier is what has a smaller rank, or stands before in the same row
    late = _factors(order, group, rank)
    by = np.lexsort((row[order], group))
    own = np.cumsum(np.concatenate(([0], (group[by][1:] != group[by][:-1]) | (row[order][by][1:] != row[order][by][:-1]))))
    late[by] |= _factors(order[by], own, place)
    return order[late]


def _compare(window: int):
    def compare(contexts: list[bytes], rank: np.ndarray, row: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, contexts), np.int64, len(contexts))
        at = spans_of(n)
        text = np.frombuffer(b"".join(contexts), np.uint8)
        own = np.repeat(np.arange(len(n)), n)
        valid = ragged(at[:-1], np.maximum(n - window + 1, 0))
        hit = later_copies(text, valid, rank[own], row[own], lo[own] + np.arange(len(text)) - at[own], window) if len(valid) else valid
        return own[hit], hit - at[own[hit]]

    return compare


def method(window: int = WINDOW, gram: int = GRAM) -> Method:
    return Method(window, window - gram + 1, False, _units(gram), _keys(window, gram), _compare(window), _lone(window, gram))


def remove_copies(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, busy: int = BUSY, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row and, if asked for, the kept bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            raw, at = text_bytes(b.column("text"))
            gone = covered(b, at)
            n = np.diff(at)
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[at[1:]] - total[at[:-1]]
            inner = np.concatenate(([False], gone[:-1]))
            inner[at[:-1][n > 0]] = False
            rises = np.concatenate(([0], np.cumsum(gone & ~inner)))
            spans = rises[at[1:]] - rises[at[:-1]]
            kept = [(raw[x:y][~gone[x:y]] if r else raw[x:y]).tobytes() for x, y, r in zip(at[:-1].tolist(), at[1:].tolist(), removed.tolist())]
            columns = [b.column("doc_id"), pa.array(n), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(t).hexdigest() for t in kept])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows, _ = numbered(ordered(docs, id_col, text_col))
    rows, scratch = with_ranges(rows, method(window, gram), hot, busy)
    out = materialize(rows.select("doc_id", "text", "known", "found").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")), "kept-bytes")
    discard(*scratch)
    return out
