"""Substring dedup over words by recompression (operator 4).

Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if it is in a window of 13 consecutive words whose
sequence also starts in a document with a smaller id. Rounds of recompression (``recompression``)
name runs and pairs alike in all documents; a window is looked up by its most telling symbol and
the words beside it; shared symbols bring contexts together (``repeats``), and there the windows are named
exactly, by pairs of names of the words themselves.

Null texts have no words. Null ids come last. Rows of one id, with equal texts or others, take nothing
from each other, as neither id is smaller. Texts of fewer than 13 words stay whole. Empty tables give no
rows, texts are never cut, columns besides id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import rolling
from .common import discard, materialize, ordered, numbered, pieces, ragged, spans_of
from .recompression import window_keys
from .repeats import BUSY, HOT, Method, Units, covered, with_ranges

WINDOW = 13
MOST = 2


def _units(raw: np.ndarray, at: np.ndarray) -> Units:
    raw, at = rolling.squeezed(raw, at)  # equal words are equal bytes
    start, end, n = rolling.words(raw, at)
    names = rolling.of_bytes(raw).of(start, end)
    return Units(raw, functools.cache(lambda: rolling.of_names(names)), spans_of(n), start, end, names)


def window_names(names: np.ndarray, window: int) -> np.ndarray:
    """Exact names of all windows: equal windows, and they alone, get the same number. Pairs of names double the length."""
    have, length, out, done = names, 1, None, 0
    left = window
    while left:
        if left & 1:
            if out is None:
                out = have
            else:
                n = len(have) - done
                pair = out[:n] * (int(have.max(initial=0)) + 1) + have[done : done + n]
                out = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            done += length
        left >>= 1
        if left:
            n = max(len(have) - length, 0)
            pair = have[:n] * (int(have.max(initial=0)) + 1) + have[length : length + n]
            have = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            length *= 2
    return out[: max(len(names) - window + 1, 0)]


def _compare(window: int):
    def compare(contexts: list[bytes], rank: np.ndarray, row: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        split = [c.split() for c in contexts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        words = np.empty(int(n.sum()), object)
        words[:] = [w for ws in split for w in ws]
        names = pd.factorize(words)[0].astype(np.int64)
        at = spans_of(n)
        start = ragged(at[:-1], np.maximum(n - window + 1, 0))
        if not len(start):
            return start, start
        own = np.searchsorted(at, start, side="right") - 1
        name = window_names(names, window)[start]
        least = np.full(int(name.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, name, rank[own])
        late = rank[own] > least[name]
        return own[late], (start - at[own])[late]

    return compare


def method(window: int = WINDOW) -> Method:
    return Method(window, window, True, _units, lambda u: window_keys(u.names, u.at, window, MOST), _compare(window))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, busy: int = BUSY, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row and, if asked for, the kept text."""
    if not 2 <= window <= 15:
        raise ValueError("window: 2 to 15 words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            split = [t.split() for t in b.column("text").cast(pa.binary()).to_pylist()]
            n = np.fromiter(map(len, split), np.int64, len(split))
            at = spans_of(n)
            gone = covered(b, at)
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[at[1:]] - total[at[:-1]]
            kept = [b" ".join([w for w, g in zip(ws, gone[x:y].tolist()) if not g] if r else ws) for ws, x, y, r in zip(split, at[:-1].tolist(), at[1:].tolist(), removed.tolist())]
            columns = [b.column("doc_id"), pa.array(n), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array([t.decode() for t in kept], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows, _ = numbered(ordered(docs, id_col, text_col))
    rows, scratch = with_ranges(rows, method(window), hot, busy)
    out = materialize(rows.select("doc_id", "text", "known", "found").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")), "kept-words")
    discard(*scratch)
    return out
