import dataclasses
import hashlib
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from blockloom.llm import recompression, repeats, rolling, substring, suffix_dedup
from blockloom.llm.common import spans_of

from .cases import frame, odd_documents


def order(rows):
    """Distinct documents by id, those without one last by the hash the operators use; a repeated row once."""
    return sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))


def plain_words(rows, window=13):
    first, out = {}, {}
    docs = [(i, d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (d, t) in enumerate(order(rows))]
    for i, d, w in docs:
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for i, d, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[(d, rows_text(w, gone))] = None
        out[i] = (d, len(w), len(gone), hashlib.sha256(rows_text(w, gone).encode()).hexdigest())
    return {v for k, v in out.items() if isinstance(k, int)}


def rows_text(w, gone):
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def plain_bytes(rows, window=100):
    first, out = {}, set()
    docs = [(i, d, (t or "").encode()) for i, (d, t) in enumerate(order(rows))]
    for i, d, b in docs:
        for k in range(len(b) - window + 1):
            first.setdefault(b[k : k + window], (i, k))
    for i, d, b in docs:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < (i, k):
                gone[k : k + window] = True
        edges = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.add((d, len(b), int(gone.sum()), edges, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_bytes_that_overlap_their_own_copy(spark):
    """A passage with a short period repeats itself within one context and may have no other company."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz é"
    rows = []
    for i in range(300):
        period = "".join(rng.choices(letters, k=rng.randint(1, 90)))
        passage = (period * 200)[: rng.randint(90, 260)]
        rows.append((i, "".join(rng.choices(letters, k=rng.randint(0, 60))) + passage + "".join(rng.choices(letters, k=rng.randint(0, 60)))))
    rows += [(300 + i, rows[i][1]) for i in range(0, 300, 50)]
    want = plain_bytes(rows)
    for settings in ({}, {"hot": 1, "busy": 1}):
        got = suffix_dedup.remove_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **settings)
        assert {tuple(r) for r in got.collect()} == want, settings
    small = [(d, t[:120]) for d, t in rows]
    got = suffix_dedup.remove_copies(spark.createDataFrame(small, "doc_id long, text string"), window=20, gram=8)
    assert {tuple(r) for r in got.collect()} == plain_bytes(small, 20)


def test_words_equal_brute_force(spark):
    rows = odd_documents()
    # 2: nearly every key takes the way of hot keys; 1: every record is dealt by context
    for hot, busy in ((repeats.HOT, repeats.BUSY), (2, 2), (9, 1)):
        got = [tuple(r) for r in substring.remove_repeats(frame(spark, rows), hot=hot, busy=busy).collect()]
        assert len(got) == len(rows) and set(got) == plain_words(rows) and sum(r[2] for r in got) > 100


def test_bytes_equal_brute_force(spark):
    rows = odd_documents()
    for hot, busy in ((repeats.HOT, repeats.BUSY), (2, 2), (9, 1)):
        got = [tuple(r) for r in suffix_dedup.remove_copies(frame(spark, rows), hot=hot, busy=busy).collect()]
        assert len(got) == len(rows) and set(got) == plain_bytes(rows) and sum(r[2] for r in got) > 1000


def test_small_alphabet(spark):
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice(["ab ", "ba ", "c "]) for _ in range(rnd.randint(0, 120))), "en", "s", None, None, None, None, None) for i in range(80)]
    got = {tuple(r) for r in substring.remove_repeats(frame(spark, rows), window=7).collect()}
    assert got == plain_words(rows, 7)
    got = {tuple(r) for r in suffix_dedup.remove_copies(frame(spark, rows), window=20, gram=6).collect()}
    assert got == plain_bytes(rows, 20)


def test_empty(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0
    assert suffix_dedup.remove_copies(frame(spark, [])).count() == 0


def test_streamed_marks_do_not_depend_on_batches():
    rnd = np.random.default_rng(3)
    n = 900
    key, piece, lo = np.sort(rnd.integers(0, 400, n)), rnd.integers(0, 40, n), rnd.integers(0, 50, n)
    plain = repeats._record_batch(key.astype(np.uint64), piece, lo, lo + 9, repeats.PLAIN)
    sign = repeats._record_batch(np.array([500, 501], np.uint64), np.zeros(2, np.int64), np.zeros(2, np.int64), np.zeros(2, np.int64), repeats.SIGN)
    tail = repeats._record_batch(np.array([501, 502], np.uint64), np.array([7, 8]), np.array([1, 2]), np.array([9, 9]), repeats.PLAIN)
    batch = pa.Table.from_batches([plain, sign, tail]).combine_chunks().to_batches()[0]
    count = {k: int((key == k).sum()) for k in set(key.tolist())}
    want = sorted([(int(p), int(x), int(x) + 9, int(k)) for k, p, x in zip(key, piece, lo) if count[int(k)] > 1] + [(7, 1, 9, 501)])  # a sign is company, 502 is alone
    for size in (len(batch), 1, 2, 7, 50):
        parts = [batch.slice(i, size) for i in range(0, len(batch), size)]
        got = sorted((r["piece"], r["lo"], r["hi"], r["key"]) for b in repeats._marks(iter(parts)) for r in b.to_pylist())
        assert got == want


class Weak:
    """Hashes of one bit."""

    def __init__(self, whole):
        self.whole = whole

    def of(self, a, b):
        return self.whole.of(a, b) & np.uint64(1)


def weakened(method):
    """The same method with nearly useless hashes: only comparisons can keep it right."""

    def units(raw, at):
        u = method.units(raw, at)
        return dataclasses.replace(u, hashes=lambda: Weak(u.hashes()))

    return dataclasses.replace(method, units=units, keys=lambda u: method.keys(u) & np.uint64(15))


@pytest.mark.parametrize("hot,busy", [(10**9, 8), (2, 10**9), (2, 1)])
def test_nothing_is_removed_by_a_hash(spark, monkeypatch, hot, busy):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = odd_documents()
    for module, run, plain in ((substring, substring.remove_repeats, plain_words), (suffix_dedup, suffix_dedup.remove_copies, plain_bytes)):
        own = module.method()
        monkeypatch.setattr(module, "method", lambda *a, own=own: weakened(own))
        assert {tuple(r) for r in run(frame(spark, rows), hot=hot, busy=busy).collect()} == plain(rows)


def thue_morse(n):
    word = "ab"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def doc(i, t):
    return (i, t, "en", "s", None, None, "c", None, 1)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_unlike_words_of_one_polynomial_hash(spark, n):
    x = thue_morse(n)
    y = x.translate(str.maketrans("ab", "ba"))
    rows = [doc(1, " ".join([x] * 13)), doc(2, " ".join([y] * 13)), doc(3, " ".join([x] * 14))]
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 14}


def test_one_id_with_two_texts_and_ids_of_any_size(spark):
    w, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "wz")
    top, low = (1 << 63) - 1, -(1 << 63)
    rows = [doc(1, w), doc(2, w), doc(2, z), doc(top, w), doc(top - 1, z + " " + w), doc(low, "x " * 90), doc(None, z), doc(None, w + " new")]
    words = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(frame(spark, rows)).collect()), key=str)
    assert words == sorted([(1, 30, 0), (2, 30, 30), (2, 30, 0), (top, 30, 30), (top - 1, 60, 60), (low, 90, 0), (None, 30, 30), (None, 31, 30)], key=str)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_copies(frame(spark, rows)).collect()), key=str)
    n, m = len(w), len(z)
    # the x's repeat within their own text: all but the first two bytes
    assert got == sorted([(1, n, 0), (2, n, n), (2, m, 0), (top, n, n), (top - 1, n + m + 1, n + m), (low, 180, 178), (None, m, m), (None, n + 4, n)], key=str)


def test_rows_of_one_id_keep_their_own_repeats(spark):
    part = "".join(chr(97 + i * 7 % 26) for i in range(120)) + "0123456789"
    rows = [doc(5, part + part), doc(5, "~" + part + "!" + part), doc(5, part + part)]
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_copies(frame(spark, rows)).collect())
    want = sorted((b[1], b[2]) for t in (rows[0], rows[1], rows[2]) for b in plain_bytes([t]))
    assert got == want and sum(x for _, x in got) > 300


@pytest.mark.parametrize("most,rounds", [(1, 1), (2, 2), (3, 3), (5, 4)])
@pytest.mark.parametrize("letters", [2, 3, 6])
def test_equal_windows_have_equal_keys(most, rounds, letters):
    rng = np.random.default_rng(0)
    w = rng.integers(0, letters, 4000).astype(np.uint64)
    w[1000:1400], w[2000:2060], w[3000:3030] = w[200:600], w[2000], w[2000]
    at = np.array([0, 900, 1100, 1300, 2500, 2500, 2510, 4000])
    for window in (5, 7, 13):
        key = recompression.window_keys(rolling.mix(w + np.uint64(5)), at, window, most, rounds)
        seen = {}
        for a, b in zip(at, at[1:]):
            for i in range(a, b - window + 1):
                assert seen.setdefault(tuple(w[i : i + window].tolist()), key[i]) == key[i]


def test_window_names_are_exact():
    rng = np.random.default_rng(4)
    names = rng.integers(0, 3, 500)
    for window in (1, 2, 5, 13):
        got = substring.window_names(names, window)
        seen = {}
        for i, x in enumerate(got.tolist()):
            assert seen.setdefault(x, names[i : i + window].tolist()) == names[i : i + window].tolist()
        assert len(seen) == len({tuple(names[i : i + window].tolist()) for i in range(len(got))})


def test_previous_smaller():
    v = np.random.default_rng(2).integers(0, 50, 400)
    want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(400)]
    assert suffix_dedup.previous_smaller(v).tolist() == want
    assert suffix_dedup.previous_smaller(np.arange(300)[::-1].copy()).tolist() == [-1] * 300
    assert spans_of(np.array([], np.int64)).tolist() == [0]
