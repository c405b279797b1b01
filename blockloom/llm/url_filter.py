"""URL filter (operator 7): rules first, then a weighted vocabulary.

Rules (host, path, verdict): a rule fits its host and all subdomains, if the path starts with the
rule's path; the longest wins. Without a rule, an Aho-Corasick automaton counts weighted
terms in the lower-cased host and path. A hit counts only between characters that are no
ASCII letter or digit (or at an end). A term of weight 1 or more is strict: one hit rejects. Lighter terms are soft:
distinct ones reject once their weights add up to 1. The vocabulary is data: pairs in the code for the
default, else a DataFrame or a tab-separated file of (term, weight), of any length up to MOST_TERMS.

A null url, or one without ``://``, has an empty host and path, no rule, no term: it is allowed.
Repeated rows are judged alike; an empty table gives no rows. Urls of any length are read whole. Of the input only the id and url
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize

# The rules of the contract.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
STRICT = ("casino", "cheap-pills", "gambling", "hentai", "malware", "phishing", "porn", "spam-farm", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "bonus", "cheap", "click", "deal", "discount", "download", "farm", "free", "loan", "pills", "promo", "spam", "torrent", "win")
SOFT_HITS = 2
#: The vocabulary is sent to the tasks as a broadcast; more terms than these (some 100 MB of automaton) are refused.
MOST_TERMS = 1_000_000


def split_url(url: Column) -> tuple[Column, Column]:
    """host and path as the contract has them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null without one. The rules are few: one CASE."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def default_terms(strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> list[tuple[str, float]]:
    return [(t, 1 / soft_hits) for t in soft] + [(t, 1.0) for t in strict]


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary file: a term and its weight on each line, with a tab between."""
    return spark.read.schema("term string, weight double").option("sep", "\t").option("quote", "").csv(path)


def _weights(terms: DataFrame | list[tuple[str, float]]) -> dict[str, float]:
    """Lower-cased terms with their weights, the largest where one comes twice; empty terms and weights of zero or less are left out."""
    if isinstance(terms, DataFrame):
        terms = [tuple(r) for r in terms.select("term", F.col("weight").cast("double")).limit(MOST_TERMS + 1).collect()]
    if len(terms) > MOST_TERMS:
        raise ValueError(f"a vocabulary has at most {MOST_TERMS} terms")
    out: dict[str, float] = {}
    for term, weight in terms:
        if term and weight and weight > 0:
            term = term.translate(_LOWER)
            out[term] = max(weight, out.get(term, 0.0))
    return out


def automaton(weights: dict[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in weights.items():
        found.add_word(term, (weight, term))
    found.make_automaton()
    return found


def _alnum(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def term_hits(text: str, found: ahocorasick.Automaton) -> tuple[int, int, float]:
    """Strict hits, distinct soft hits and the weight of these in a lower-cased text."""
    strict, soft = 0, {}
    for end, (weight, term) in found.iter(text) if len(found) else ():
        start = end + 1 - len(term)
        if start and _alnum(text[start - 1]) or end + 1 < len(text) and _alnum(text[end + 1]):
            continue
        if weight >= 1:
            strict += 1
        else:
            soft[term] = weight
    return strict, len(soft), math.fsum(soft.values())


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, terms: DataFrame | list[tuple[str, float]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft of every row."""
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("__url"))
    host, path = split_url(F.coalesce(F.col("__url"), F.lit("")))
    base = base.select("page_id", host.alias("host"), path.alias("path"))
    base = base.withColumn("__r", rule_of(F.col("host"), F.col("path"), rules)) if rules else base.withColumn("__r", F.lit(None).cast("struct<rule:string,verdict:string>"))
    base = base.select("page_id", "host", "path", F.col("__r.rule").alias("rule"), F.col("__r.verdict").alias("ruled"))
    sent = pages.sparkSession.sparkContext.broadcast(_weights(default_terms() if terms is None else terms))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(sent.value)
        for b in batches:
            hits = [term_hits((h + p).translate(_LOWER), found) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            ns, nf = [x[0] for x in hits], [x[1] for x in hits]
            verdict = [r or ("block" if s or w >= 1 - 1e-9 else "allow") for r, (s, _, w) in zip(b.column("ruled").to_pylist(), hits)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("host"), b.column("path"), b.column("rule"), pa.array(verdict, pa.string()), pa.array(ns, pa.int64()), pa.array(nf, pa.int64())],
                names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"],
            )

    kind = base.schema["page_id"].dataType.simpleString()
    out = materialize(base.mapInArrow(scan, f"page_id {kind}, host string, path string, rule string, verdict string, n_strict long, n_soft long"), "pages")
    sent.unpersist()
    return out
