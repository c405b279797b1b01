import hashlib
import random
import re

import numpy as np

from blockloom.llm import decontam

from .cases import frame, odd_documents


def plain_words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def plain(rows, items):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i) if i is not None else "null")
    out = []
    for d, t in rows:
        w, hit, own = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                s = windows.get(tuple(w[k : k + n]))
                if s:
                    own |= s
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items(rows):
    texts = [r[1] for r in rows if r[1] and len(r[1]) > 100]
    w = texts[0].split()
    return [(1, " ".join(w[5:40])), (2, " ".join(w[30:44])), (10, "One, TWO"), (None, texts[3][:90]), (4, None), (5, "..."), (6, " ".join(w[5:40])), (7, "never there at all of course because nobody says such things")]


def test_scan_equals_brute_force(spark):
    rows = odd_documents()
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    got = [tuple(r)[:6] for r in decontam.scan(frame(spark, rows), bench).collect()]
    want = plain([(r[0], r[1]) for r in rows], items(rows))
    assert sorted(got, key=str) == want and sum(r[5] for r in want) > 3


def test_blocks_of_phrases_change_nothing(spark, monkeypatch):
    rows = odd_documents(4)
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    one = sorted(map(str, decontam.scan(frame(spark, rows), bench).collect()))
    gone = sorted(map(str, decontam.remove(frame(spark, rows), bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    assert decontam.Benchmark(bench, 10, "item_id", "text").blocks > 2
    assert sorted(map(str, decontam.remove(frame(spark, rows), bench).collect())) == gone
    assert sorted(map(str, decontam.scan(frame(spark, rows), bench).collect())) == one


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(frame(spark, []), bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.scan(frame(spark), bench).collect())


def test_remove_leaves_no_window_and_all_rows(spark):
    rows = odd_documents()
    bench = spark.createDataFrame(items(rows)[:2], "item_id long, text string")
    out = decontam.remove(frame(spark, rows), bench)
    assert out.columns == frame(spark, rows).columns and out.count() == len(rows)
    left = {(r["doc_id"], r["text"]) for r in out.collect()}
    clean = {(r[0], r[1]) for r, p in zip(sorted(rows, key=lambda r: str(r[0])), [0] * len(rows))}
    hits = [x for x in plain(left, items(rows)[:2]) if x[5]]
    was = {x[0] for x in plain([(r[0], r[1]) for r in rows], items(rows)[:2]) if x[5]}
    assert was and len(hits) < len(was)
    assert {x for x in left if x[0] not in was} == {x for x in clean if x[0] not in was}


def test_index_against_scan():
    rnd = random.Random(2)
    text = np.array([rnd.choice([0, 1, 1, 2, 3]) for _ in range(3000)], np.int64)
    index = decontam.FMIndex(text)
    phrases = np.array([[rnd.choice([1, 1, 2, 3, 9]) for _ in range(4)] for _ in range(60)], np.int64)
    row, low, high = index.search(phrases)
    got = {(int(r), int(p)) for r, a, b in zip(row, low, high) for p in index.locate(np.arange(a, b))}
    want = {(i, k) for i, p in enumerate(phrases.tolist()) for k in range(len(text) - 3) if text[k : k + 4].tolist() == p}
    assert got == want and want
