"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import importlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, exact_dedup, quality, secrets, simhash, substring, suffix_dedup, token_store, url_filter
from .common import documents


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.new_path(spark)
    token_store.write(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.digests(spark, path)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_copies(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def queries() -> dict:
    return {
        "op1_token_store": op1_token_store,
        "op2_simhash": op2_simhash,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_bpe": op5_bpe,
        "op6_decontamination": op6_decontamination,
        "op7_url_filter": op7_url_filter,
        "op8_quality": op8_quality,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_secrets": op10_secrets,
        "pipeline": lambda spark, sf_dir: importlib.import_module("corpus_pipeline").run(spark, sf_dir),
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) t(i)),
late AS (SELECT win.doc_id, i FROM win JOIN (SELECT s, min(doc_id) AS first FROM win GROUP BY s) f ON win.s = f.s AND win.doc_id > f.first),
gone AS (SELECT DISTINCT doc_id, p FROM late, unnest(range(i, i + 13)) t(p)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_FOLD = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6 = f"""
WITH d AS (SELECT doc_id, {_FOLD} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_FOLD} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
win AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS s FROM d, (SELECT DISTINCT n FROM p), unnest(range(1, len(w) - n + 2)) t(i)),
occ AS (SELECT doc_id, i, n, item FROM win JOIN p USING (n, s)),
hit AS (SELECT DISTINCT doc_id, q FROM occ, unnest(range(i - 1, i - 1 + n)) t(q)),
runs AS (SELECT doc_id, min(q) AS a, max(q) + 1 AS z FROM (SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS g FROM hit) GROUP BY doc_id, g),
h AS (SELECT doc_id, sum(z - a)::BIGINT AS n_hit, string_agg(a || ':' || z, ',' ORDER BY a) AS spans FROM runs GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT rid, doc_id, i, b[i:i+{suffix_dedup.WINDOW - 1}] AS s FROM d, unnest(range(1, octet_length(b) - {suffix_dedup.WINDOW - 2})) t(i)),
others AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
own AS (SELECT rid, s, min(i) AS first FROM win GROUP BY rid, s),
late AS (SELECT rid, i FROM win JOIN others USING (s) JOIN own USING (rid, s) WHERE doc_id > least OR i > first),
step AS (SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + {suffix_dedup.WINDOW}, true)::BIGINT AS new FROM late),
runs AS (SELECT rid, min(i) AS a, max(i) + {suffix_dedup.WINDOW - 1} AS z FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM step) GROUP BY rid, g),
gone AS (SELECT rid, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid),
edges AS (SELECT rid, a, z FROM runs UNION ALL SELECT rid, octet_length(b) + 1, NULL FROM d),
left_over AS (SELECT rid, a, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a) + 1, 1) AS x FROM edges),
kept AS (SELECT rid, unhex(string_agg(hex(CASE WHEN x < a THEN b[x:a-1] ELSE ''::BLOB END), '' ORDER BY a)) AS k FROM left_over JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(k) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN gone USING (rid)
"""

def _op7_sql() -> str:
    def edge(term: str) -> str:
        return f"(^|[^a-z0-9]){term}($|[^a-z0-9])"

    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules) + " END"
    soft = " + ".join(f"regexp_matches(low, '{edge(t)}')::BIGINT" for t in url_filter.SOFT)
    # two hits may share the character between them, so each term is counted on its own, its borders doubled
    count = lambda t: f"len(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g'), '{edge(t.replace('-', '--'))}'))"
    strict = " + ".join(count(t) for t in url_filter.STRICT)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, translate(host || path, '{_UPPER}', '{_LOWER}') AS low, {rule} AS rule, {ruled} AS ruled FROM b),
d AS (SELECT *, CAST({strict} AS BIGINT) AS n_strict, CAST({soft} AS BIGINT) AS n_soft FROM c)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN n_strict > 0 OR n_soft >= {url_filter.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM d
"""


def _op10_sql() -> str:
    def spans(pattern: str, kind: int, group: int, keep: str) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT rid, s.start AS start, {kind} AS kind, s.stop AS stop, s.value AS value FROM (
  SELECT rid, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'start': list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0),
    'stop': list_sum(list_transform(b[1:i], lambda x: length(x))) + list_sum(list_transform(w[1:i], lambda x: length(x))), 'value': v[i]}})) AS s
  FROM (SELECT rid, regexp_extract_all(t, '{p}') AS w, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS b FROM d WHERE regexp_matches(t, '{p}'))) WHERE {keep.replace("value", "s.value")}"""

    base = " UNION ALL ".join([spans(secrets.ASSIGN, 0, 2, "length(value) >= 6"), spans(secrets.ACCESS_LONG, 1, 0, "true"), spans(secrets.HEX_LONG, 2, 0, "true")])
    more = spans(secrets.OWNED_LONG, 3, 0, "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')")
    name = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || start::BIGINT || ':' || stop::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
base AS ({base}),
more AS ({more}),
owners AS (SELECT value, count(DISTINCT owner) AS n FROM more JOIN d USING (rid) GROUP BY value),
live AS (SELECT more.* FROM more JOIN owners USING (value) WHERE n <= {secrets.MAX_OWNERS}),
b AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg({name}, ',' ORDER BY start, kind) AS s FROM base GROUP BY rid),
a AS (SELECT rid, string_agg({name}, ',' ORDER BY start, kind) AS s, count(*) FILTER (kind = 3) AS n_owned FROM (SELECT * FROM base UNION ALL SELECT * FROM live) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans, coalesce(n_owned, 0) AS n_owned
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op4_substring_dedup": OP4, "op6_decontamination": OP6, "op7_url_filter": _op7_sql(), "op9_suffix_dedup": OP9, "op10_secrets": _op10_sql()}
