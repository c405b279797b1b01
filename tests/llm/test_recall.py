import os

import numpy as np
import pytest
import xxhash

from blockloom.llm import common, quality, simhash
from blockloom.llm.rolling import SPACE

from .cases import odd_documents

SF = "/root/testdata/sf0.1"


def exact_pairs(texts, k=5, similarity=0.8):
    """All pairs of texts whose shingle sets are similar, by comparing every two of them that share a shingle."""
    sets = []
    for t in texts:
        w = t.lower().encode().split()
        sets.append({b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    holders, common_ = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            for j in holders.setdefault(x, []):
                common_[j, i] = common_.get((j, i), 0) + 1
            holders[x].append(i)
    return [(i, j) for (i, j), c in common_.items() if c >= similarity * (len(sets[i]) + len(sets[j]) - c)]


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
def test_recall_against_exact_pairs(spark):
    docs = common.documents(spark, SF).select("doc_id", "text").toPandas()
    pairs = exact_pairs([t or "" for t in docs.text])
    rows = spark.createDataFrame(list(enumerate(t or "" for t in docs.text)), "row long, text string")
    of = {r["row"]: r["component"] for r in simhash.near_groups(rows, 5, 0.8, simhash.WIDE_RADIUS).collect()}
    differ = [(i, j) for i, j in pairs if docs.text[i] != docs.text[j]]
    for name, some in (("all", pairs), ("of different texts", differ)):
        print(f"recall of pairs {name}: {np.mean([of[i] == of[j] for i, j in some]):.4f} of {len(some)}")
        assert len(some) > 50 and np.mean([of[i] == of[j] for i, j in some]) >= 0.99
    # and no more than what links allow
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        up[b] = a
    assert all(root(i) == root(c) for i, c in of.items())


def test_bands_miss_few_similar_sets():
    g = np.random.default_rng(7)
    missed = tried = 0
    for n in (40, 100, 400):
        for _ in range(700):
            both = g.integers(0, 1 << 63, int(round(n * 0.8 * 2 / 1.8)), dtype=np.uint64)
            a, b = (np.concatenate([both, g.integers(0, 1 << 63, n - len(both), dtype=np.uint64)]) for _ in range(2))
            tried += 1
            missed += not (simhash.bands_of(a) == simhash.bands_of(b)).any()
    assert missed / tried < 0.004  # 0.0005 by the law, at similarity 0.8


# --- the quality classifier once more, in plain Python


def plain_values(text):
    raw = text.encode()
    words = raw.split()
    letter = lambda c: c >= 128 or chr(c).isalpha()
    digit = lambda c: 48 <= c <= 57
    symbols = set(b"#$%&*|<>{}[]~^!")
    n = max(len(words), 1)
    ascii_letters = [c for c in raw if c < 128 and chr(c).isalpha()]
    seen, again = {}, 0
    for i, w in enumerate(words):
        again += w in seen.setdefault(i // 64, set())
        seen[i // 64].add(w)
    return len(words), len(ascii_letters), {
        "symbols": sum(c in symbols for c in raw) / max(len(raw), 1),
        "torn": sum(len(w) >= 3 and not letter(w[-1]) and not letter(w[-2]) and not digit(w[-1]) for w in words) / n,
        "capitals": sum(65 <= c <= 90 for c in ascii_letters) / max(len(ascii_letters), 1),
        "separators": sum(len(w) == 1 and w[0] in symbols for w in words) / n,
        "stutter": sum(x == y for x, y in zip(words, words[1:])) / n,
        "poor": again / n,
    }


def plain_votes(text):
    words, letters, values = plain_values(text)
    out = []
    for k in quality.LABELLERS:
        low, high = quality.BOUNDS[k]
        vote = 1 if values[k] >= high else 0 if values[k] <= low else -1
        if words < quality.LEAST_WORDS and (k in ("stutter", "poor") or k == "capitals" and letters < quality.LEAST_LETTERS):
            vote = -1
        out.append(vote if words else -1)
    return tuple(out), words


def plain_model(votes):
    """Expectation-maximisation document by document."""
    low = {v: 0.9 if 1 in v else 0.02 for v in set(votes)}
    count = {v: votes.count(v) for v in low}
    for _ in range(200):
        prior = min(max(sum(low[v] * c for v, c in count.items()) / len(votes), 1e-4), 0.5)
        rates = []
        for c in (0, 1):
            share = {v: (low[v] if c else 1 - low[v]) * count[v] for v in count}
            rates.append([(sum(s for v, s in share.items() if v[i] == 1) + (0.02, 1.0)[c]) / (sum(s for v, s in share.items() if v[i] >= 0) + 2.0) for i in range(6)])
        rates[1] = [min(max(b, 1.5 * a, 0.02), 0.98) for a, b in zip(*rates)]
        rates[0] = [min(max(a, 1e-4), 0.5) for a in rates[0]]

        def posterior(v, prior=prior, rates=rates):
            if max(v) < 0:
                return 1 / (1 + np.exp(5.0))
            odds = np.log(prior / (1 - prior))
            for x, f, r in zip(v, *rates):
                odds += np.log(r / f) if x == 1 else np.log((1 - r) / (1 - f)) if x == 0 else 0
            return 1 / (1 + np.exp(-odds))

        new = {v: posterior(v) for v in low}
        if max(abs(new[v] - low[v]) for v in low) < 1e-9:
            break
        low = new
    return posterior


def plain_features(text, votes):
    raw = text.encode()
    kind = [int(quality.CLASS[c]) for c in raw]
    count = {}
    for i in range(len(kind) - 3):
        gram = ((kind[i] * 9 + kind[i + 1]) * 9 + kind[i + 2]) * 9 + kind[i + 3]
        bucket = (gram * 2654435761 >> 7) % (quality.BUCKETS - 2)
        count[bucket] = count.get(bucket, 0) + 1
    out = {b: (c / max(len(kind) - 3, 1)) ** 0.5 for b, c in count.items()}
    return out | {quality.BUCKETS - 2 + j: 1.0 for j, i in enumerate((4, 5)) if votes[i] == 1}


def plain_scores(texts):
    """Score of every text; the scorer learns from each distinct one (the tables here are smaller than the sample)."""
    told = [plain_votes(t) for t in texts]
    posterior = plain_model([v for v, _ in told])
    distinct = list(dict.fromkeys(zip(range(len(texts)), texts)))
    x = np.zeros((len(distinct), quality.BUCKETS))
    for r, (i, t) in enumerate(distinct):
        for b, value in plain_features(t, told[i][0]).items():
            x[r, b] = value
    y = np.array([posterior(told[i][0]) for i, _ in distinct])
    share = np.where(y > 0.5, 0.5 / (y > 0.5).mean(), 0.5 / (y <= 0.5).mean()) / len(y)
    w, b, vw, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    for _ in range(400):
        lw, lb = w + 0.9 * vw, b + 0.9 * vb
        g = (1 / (1 + np.exp(-np.clip(x @ lw + lb, -30, 30))) - y) * share
        vw, vb = 0.9 * vw - 8.0 * (x.T @ g + 1e-4 * lw), 0.9 * vb - 8.0 * g.sum()
        w, b = w + vw, b + vb
    out = []
    for t, (v, words) in zip(texts, told):
        z = sum(w[k] * value for k, value in plain_features(t, v).items()) + b
        short = words < quality.LEAST_WORDS and len(t.encode()) < quality.LEAST_BYTES
        score = 0.0 if not words else posterior(v) if short else 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        out.append((sum(k == 1 for k in v), posterior(v), score))
    return out


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
def test_quality_equals_brute_force(spark):
    docs = common.documents(spark, "/root/testdata/sf0.001")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(100_000 + n, t) for n, (_, t, *_) in enumerate(odd_documents()) if not t or len(t) < 3000]
    want = {i: x for (i, _), x in zip(rows, plain_scores([t or "" for _, t in rows]))}
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and SPACE.sum() == 6
    for r in got:
        n_low, posterior, score = want[r["doc_id"]]
        assert r["n_low"] == n_low and abs(r["posterior"] - posterior) < 2e-6 and abs(r["score"] - score) < 2e-3
        assert r["keep"] == (score < quality.THRESHOLD) or abs(score - quality.THRESHOLD) < 2e-3
    assert 0 < sum(not r["keep"] for r in got) < len(got) / 2
