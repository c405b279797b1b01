"""Quality classifier (operator 8): a label model over heuristics teaches a hashed linear scorer.

1. Overlapping heuristic labellers vote low or fine on every document with words. Those that need a
   run of words or letters (capitals, stutter, poor) abstain on texts too short for them. The votes of all documents are counted by pattern (at most 3 ** 6 patterns).
2. Expectation-maximisation over the pattern counts estimates the share of low documents and
   each labeller's accuracy in both classes, and so the posterior of every pattern. No true labels are used.
3. The posteriors of a bounded sample (SAMPLE rows about, dealt by a hash of the row, and where the corpus has them
   CLASS_ROWS rows about of the rarer class; the only sampled step) train a logistic scorer on hashed frequencies of 4-grams of character classes.
4. The scorer judges every whole document; a score of THRESHOLD or more rejects it. A text of under
   LEAST_WORDS words and LEAST_BYTES bytes has too few 4-grams for their frequencies to tell; the posterior of its votes
   is its score.

Null, empty and blank texts get no votes (all abstain) and are kept: there is nothing against them. Repeated
rows get equal scores. Very long texts are judged whole, one at a time. With an empty table, or too few low posteriors to learn from, the scorer is the
posterior itself. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import rolling
from .common import keyed, materialize, pieces, settings, text_bytes

SAMPLE = 6000
CLASS_ROWS = 500
BUCKETS = 4096
PIECE_BYTES = 1 << 19
THRESHOLD = 0.5
LABELLERS = ("symbols", "torn", "capitals", "separators", "stutter", "poor")
LEAST_WORDS = 8
#: A text of fewer words is as long as one of LEAST_WORDS if it has so many bytes, or letters.
LEAST_BYTES = 64
LEAST_LETTERS = 40
#: A labeller votes low above the second value, fine below the first, and else abstains.
BOUNDS = {"symbols": (0.01, 0.04), "torn": (0.05, 0.2), "capitals": (0.2, 0.4), "separators": (0.02, 0.1), "stutter": (0.1, 0.3), "poor": (0.6, 0.8)}

# character classes: 0 end, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 other mark, 8 beyond ASCII
CLASS = np.full(256, 7, np.uint8)
CLASS[ord("a") : ord("z") + 1] = 1
CLASS[ord("A") : ord("Z") + 1] = 2
CLASS[ord("0") : ord("9") + 1] = 3
CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
CLASS[0x0A] = 5
CLASS[[ord(c) for c in ".,;:?!'\"-()"]] = 6
CLASS[128:] = 8
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#$%&*|<>{}[]~^!"]] = True
LETTER = (CLASS == 1) | (CLASS == 2) | (CLASS == 8)


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def votes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, labellers): 1 low, 0 fine, -1 abstains."""
    return votes_and_words(raw, at)[0]


def votes_and_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The votes and the number of words of each text."""
    starts, ends, n = rolling.words(raw, at)
    of = rolling.spans_of_counts(n)
    share = lambda flags: _per_text(flags, of) / np.maximum(n, 1)
    size = np.maximum(np.diff(at), 1)
    name = rolling.of_bytes(raw).of(starts, ends)
    same = np.zeros(len(name), bool)
    same[1:] = name[1:] == name[:-1]
    same[of[:-1][n > 0]] = False
    # a word is torn if it ends in two marks or more
    last = np.minimum(ends - 1, len(raw) - 1)
    torn = (ends - starts >= 3) & ~LETTER[raw[last]] & ~LETTER[raw[np.maximum(last - 1, 0)]] & (CLASS[raw[last]] != 3)
    bare = (ends - starts == 1) & SYMBOL[raw[starts]] if len(raw) else np.zeros(0, bool)
    letters = _per_text((CLASS[raw] == 1) | (CLASS[raw] == 2), at)
    upper = _per_text(CLASS[raw] == 2, at) / np.maximum(letters, 1)
    values = {"symbols": _per_text(SYMBOL[raw], at) / size, "torn": share(torn), "capitals": upper, "separators": share(bare), "stutter": share(same)}
    # poor: share of words that have come before within the last 64 words
    owner = np.repeat(np.arange(len(n)), n)
    block = owner * (1 << 32) + (np.arange(len(name)) - np.repeat(of[:-1], n)) // 64
    with np.errstate(over="ignore"):
        key = rolling.mix(name + rolling.mix(block.astype(np.uint64)))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    values["poor"] = share(~first)
    out = np.full((len(n), len(LABELLERS)), -1, np.int8)
    for i, k in enumerate(LABELLERS):
        low, high = BOUNDS[k]
        out[values[k] <= low, i] = 0
        out[values[k] >= high, i] = 1
    few = n < LEAST_WORDS
    out[few & (letters < LEAST_LETTERS), LABELLERS.index("capitals")] = -1
    for k in ("stutter", "poor"):
        out[few, LABELLERS.index(k)] = -1
    out[n == 0] = -1
    return out, n


def pattern_of(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


class LabelModel:
    """Two classes; each labeller has a rate of low votes in each class. Expectation-maximisation over counted patterns."""

    def __init__(self, prior: float, low_rate: np.ndarray):
        self.prior, self.low_rate = prior, low_rate

    @classmethod
    def fit(cls, v: np.ndarray, count: np.ndarray, rounds: int = 200) -> LabelModel:
        # begins with "low if any labeller says so"; smoothed counts keep every rate off 0 and 1
        low = np.where((v == 1).any(axis=1), 0.9, 0.02)
        model = cls(0.1, np.zeros((2, v.shape[1])))
        total = max(count.sum(), 1)
        for _ in range(rounds):
            model.prior = float(np.clip((low * count).sum() / total, 1e-4, 0.5))
            for c, p in enumerate((1 - low, low)):
                said = (v >= 0) * (p * count)[:, None]
                model.low_rate[c] = (((v == 1) * said).sum(axis=0) + (0.02, 1.0)[c]) / (said.sum(axis=0) + 2.0)
            # a labeller is better than chance: it says low more often about low documents
            model.low_rate[1] = np.maximum(model.low_rate[1], model.low_rate[0] * 1.5).clip(0.02, 0.98)
            model.low_rate[0] = model.low_rate[0].clip(1e-4, 0.5)
            new = model.posterior(v)
            if np.abs(new - low).max(initial=0) < 1e-9:
                break
            low = new
        return model

    def posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) * np.ones(len(v))
        f, r = self.low_rate
        odds += ((v == 1) * np.log(r / f) + (v == 0) * np.log((1 - r) / (1 - f))).sum(axis=1)
        odds[(v < 0).all(axis=1)] = -5.0
        return 1 / (1 + np.exp(-odds))


def features(raw: np.ndarray, at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """v: the votes. (text, bucket, value) of all non-zero features: root of the share of each hashed 4-gram of classes, and word repetition."""
    n = len(raw)
    c = CLASS[raw].astype(np.int64)
    gram = c * 729 + np.concatenate([c[1:], [0]]) * 81 + np.concatenate([c[2:], [0, 0]])[:n] * 9 + np.concatenate([c[3:], [0, 0, 0]])[:n] if n else c
    size = np.diff(at)
    whole = np.maximum(size - 3, 0)
    keep = np.repeat(at[:-1], whole) + (np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole))
    owner = np.repeat(np.arange(len(size)), whole)
    bucket = (gram[keep] * 2654435761 >> 7) % (BUCKETS - 2)
    cell = owner * BUCKETS + bucket
    count = np.bincount(cell, minlength=1)
    cell = np.flatnonzero(count)
    count = count[cell]
    text, place = cell // BUCKETS, cell % BUCKETS
    value = np.sqrt(count / np.maximum(whole, 1)[text])
    extra = [(np.flatnonzero(v[:, i] == 1), BUCKETS - 2 + j) for j, i in enumerate((4, 5))]
    return np.concatenate([text, *[t for t, _ in extra]]), np.concatenate([place, *[np.full(len(t), b) for t, b in extra]]), np.concatenate([value, *[np.ones(len(t)) for t, _ in extra]])


class Scorer:
    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 400, l2: float = 1e-4) -> Scorer:
        """Full-batch logistic regression on soft labels, both classes weighted alike, by accelerated gradient steps."""
        share = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 1e-6), 0.5 / max((y <= 0.5).mean(), 1e-6)) / len(y)
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        vw, vb = w.copy(), 0.0
        step = 8.0
        for t in range(rounds):
            lw, lb = w + 0.9 * vw, b + 0.9 * vb
            p = 1 / (1 + np.exp(-np.clip(x @ lw + lb, -30, 30)))
            g = (p - y) * share
            gw, gb = x.T @ g.astype(np.float32) + l2 * lw, float(g.sum())
            vw, vb = 0.9 * vw - step * gw, 0.9 * vb - step * gb
            w, b = w + vw, b + vb
        return cls(w.astype(np.float64), float(b))

    def score(self, raw: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        text, place, value = features(raw, at, v)
        z = np.bincount(text, self.weight[place] * value, len(at) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, Scorer | None]:
    with settings(docs.sparkSession):
        return _fit(keyed(docs, id_col, text_col), sample)


def _fit(own: DataFrame, sample: int) -> tuple[LabelModel, Scorer | None]:

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, PIECE_BYTES):
            found, n = np.unique(pattern_of(votes(*text_bytes(b.column("text")))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pattern", "n"])

    rows = own.mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not rows:
        return LabelModel(0.1, np.full((2, len(LABELLERS)), 0.1)), None
    v, count = votes_of(np.array([r["pattern"] for r in rows])), np.array([r["n"] for r in rows], np.float64)
    model = LabelModel.fit(v, count)

    deal = 1 << 30
    own = own.withColumn("place", F.xxhash64("doc_id", "text"))
    place_of = F.pmod("place", F.lit(deal))
    cut = int(min(deal, deal * sample / count.sum()))

    def dealt(part: DataFrame, only: np.ndarray | None = None) -> list:
        def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, PIECE_BYTES):
                raw, at = text_bytes(b.column("text"))
                v = votes(raw, at)
                if only is not None:
                    keep = np.isin(pattern_of(v), only)
                    if not keep.any():
                        continue
                    b, v = b.filter(pa.array(keep)), v[keep]
                    raw, at = text_bytes(b.column("text"))
                text, place, value = features(raw, at, v)
                order = np.argsort(text, kind="stable")
                cut = np.searchsorted(text[order], np.arange(1, len(at) - 1))
                ps, vs = np.split(place[order].astype("<i2"), cut), np.split(value[order].astype("<f4"), cut)
                yield pa.RecordBatch.from_arrays([b.column("place"), pa.array(pattern_of(v)), pa.array([x.tobytes() for x in ps], pa.binary()), pa.array([x.tobytes() for x in vs], pa.binary())], names=["row", "pattern", "place", "value"])

        # rows that repeat count once, so that the sample has a bound whatever repeats
        return part.mapInArrow(sparse, "row long, pattern long, place binary, value binary").dropDuplicates(["row"]).collect()

    got = dealt(own.where(place_of < cut))
    low = model.posterior(v) > 0.5
    for patterns_of, n in ((pattern_of(v[c]), count[c].sum()) for c in (low, ~low)):
        # a class that is rare in the sample is dealt by a wider cut, over all data
        wide = int(min(deal, deal * CLASS_ROWS / max(n, 1)))
        if wide > cut and n:
            got += dealt(own.where((place_of >= cut) & (place_of < wide)), patterns_of)
    got = sorted(got, key=lambda r: r["row"])
    if not got:
        return model, None
    y = model.posterior(votes_of(np.array([r["pattern"] for r in got])))
    if (y > 0.5).sum() < 5 or (y <= 0.5).sum() < 5:
        return model, None
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(bytes(r["place"]), "<i2")] = np.frombuffer(bytes(r["value"]), "<f4")
    return model, Scorer.fit(x, y)


class Judge:
    """What the scorer says about the texts of a piece."""

    def __init__(self, model: LabelModel, scorer: Scorer | None):
        self.model, self.scorer = model, scorer

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labellers that say low, posterior and score of each text."""
        raw, at = text_bytes(column)
        v, n = votes_and_words(raw, at)
        posterior = self.model.posterior(v)
        short = (n < LEAST_WORDS) & (np.diff(at) < LEAST_BYTES)
        score = posterior.copy() if self.scorer is None else np.where(short, posterior, self.scorer.score(raw, at, v))
        score[n == 0] = 0.0
        return (v == 1).sum(axis=1), posterior, score


def classify(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_low (labellers that say low), posterior, score, keep of every row."""
    judge = Judge(*fit(docs, sample, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, PIECE_BYTES):
            low, posterior, score = judge.of(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(low), pa.array(posterior.round(6)), pa.array(score.round(6)), pa.array(score < threshold)], names=["doc_id", "n_low", "posterior", "score", "keep"])

    return materialize(keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_low long, posterior double, score double, keep boolean"), "quality")


def keep_good(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier keeps: judged where they are, with all their columns."""
    judge = Judge(*fit(docs, sample, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, PIECE_BYTES, text_col):
            yield b.filter(pa.array(judge.of(b.column(text_col).fill_null(""))[2] < threshold))

    return materialize(docs.mapInArrow(run, docs.schema), "good")
