import re
import random

import numpy as np
import xxhash

from blockloom.llm import simhash

from .cases import frame, odd_documents

BIG = 1 << 62


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, radius):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for g, (x, _) in zip(group, rows) if g == group[i] and x is not None]
        out.append((d, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def test_groups_equal_brute_force(spark):
    rows = odd_documents()
    got = [tuple(r) for r in simhash.simhash_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == plain_groups([(r[0], r[1]) for r in rows], 3)


def test_empty_table(spark):
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0


def test_components_in_chunks_and_tiles(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            for bit in rnd.sample(range(64), rnd.randint(1, 3)):
                b ^= 1 << bit
            fps.add(b)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    want = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and want[i] != want[j]:
                a, b = sorted((want[i], want[j]))
                want = [a if w == b else w for w in want]
    for tile in (4096, 3):  # 3: every tile is dealt into chunks that meet in pairs
        got = {r["node"]: r["component"] for r in simhash.components_by_radius(nodes, 3, tile).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_tile_links_whole():
    g = np.random.default_rng(1)
    a = g.integers(0, 1 << 63, 700, dtype=np.uint64)
    a[300:600] = a[:300] ^ (np.uint64(1) << g.integers(0, 63, 300).astype(np.uint64))
    got = {tuple(sorted(x)) for r, c in simhash.tile_links([a], None, 3) for x in zip(r.tolist(), c.tolist())}
    assert got == {(i, j) for j in range(700) for i in range(j) if int(a[i] ^ a[j]).bit_count() <= 3}
    got = {x for r, c in simhash.tile_links([a[:350]], [a[350:]], 20) for x in zip(r.tolist(), c.tolist())}
    assert got == {(i, j) for i in range(350) for j in range(350) if int(a[i] ^ a[350 + j]).bit_count() <= 20}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(11)
    texts = []
    for _ in range(12):
        w = [f"v{rnd.randint(0, 9999)}" for _ in range(rnd.randint(30, 400))]
        texts.append(w)
        for _ in range(4):
            x = list(w)
            for _ in range(rnd.randint(0, 4)):
                x[rnd.randrange(len(x))] = "new"
            texts.append(x)
    rnd.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    rows = [(i, " ".join(w), "en", "s", None, None, "c", None, 1) for i, w in enumerate(texts)]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and want[i] != want[j]:
                a, b = sorted((want[i], want[j]))
                want = [a if w == b else w for w in want]
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).collect())
    assert kept == sorted(set(want))


def _kept(spark, texts):
    rows = [(i, t, "en", "s", None, None, "c", None, 1) for i, t in enumerate(texts)]
    return sorted(r["doc_id"] for r in simhash.drop_near_duplicates(frame(spark, rows)).collect())


def test_repeats_of_a_line_do_not_hide_near_duplicates(spark):
    rnd = random.Random(21)
    texts = []
    for i in range(24):
        words, line = [" ".join(f"w{rnd.randint(0, 99999)}" for _ in range(n)) for n in (100, 12)]
        texts += [f"{words} {line}", words + f" {line}" * (5, 10, 20, 40)[i % 4]]  # similarity 0.9 at least
    assert _kept(spark, texts) == list(range(0, len(texts), 2))


def test_small_sets_are_linked_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COMMON", 8, raising=False)
    rnd = random.Random(22)
    word = lambda: f"w{rnd.randint(0, 99999)}"
    texts = []
    for n in (8, 8, 8, 16, 24, 34):  # words: 4, 12, 20, 30 shingles, and a fourth of them more
        for _ in range(60):
            w = [word() for _ in range(n)]
            texts += [" ".join(w), " ".join(w + [word() for _ in range((n - 4) // 4)])]
    shared = "one line that very many texts of this small table share"
    hot = [f"{shared} " + " ".join(word() for _ in range(4)) for _ in range(30)]  # 7 of 11 shingles in common: no links
    assert _kept(spark, [*texts, *hot]) == [*range(0, len(texts), 2), *range(len(texts), len(texts) + len(hot))]


def test_small_links_in_chunks_equal_brute_force(spark):
    rnd = random.Random(23)
    sets = [sorted(rnd.sample(range(12), rnd.randint(1, 12))) for _ in range(250)]
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            if len(a & b) >= 0.8 * len(a | b) and want[i] != want[j]:
                x, y = sorted((want[i], want[j]))
                want = [x if z == y else z for z in want]
    own = spark.createDataFrame(list(enumerate(sets)), "node long, names array<long>")
    for tile in (4096, 7):
        got = {r["node"]: r["component"] for r in simhash.components(simhash._small_links(own, 0.8, tile)).collect()}
        assert [got.get(i, i) for i in range(len(sets))] == want


def test_odd_rows_survive_near_dedup(spark):
    out = simhash.drop_near_duplicates(frame(spark))
    assert out.columns == frame(spark).columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert 0 in ids and 1 in ids and None not in ids and 12 not in ids and 11 in ids  # the null id comes last, and its text is near another
