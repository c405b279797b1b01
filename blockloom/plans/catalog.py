"""All queries over the operators, and their SQL on the same tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bignum, hexcols
from ..functions.keccak import event_topic
from ..operators import changelog, decode, entities, filters, heightmap, lineage, metadata, ordered, planning
from ..streaming import handlers
from ..sources import project
from .testviews import ARRIVALS_SQL, SQL, Views

_queries: dict[str, Callable[[Views], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(f):
        _queries[name] = f
        if sql is not None:
            _oracles[name] = SQL + sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for k, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


# --- the topics and addresses that the filters below ask for
_md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
PURCHASE, ERROR, CLICK = ("0x" + _md5(x) * 2 for x in ("purchase", "error", "click"))
USER7 = "0xaB" + "7".rjust(38, "0")
TOPIC7 = "0x" + "7".rjust(64, "0")
_LOG = "SELECT height, log_index FROM v_logs WHERE "
_TX = "SELECT height, transaction_index FROM v_tx WHERE "


def _logs(v: Views, f: filters.LogFilter) -> DataFrame:
    return v.logs.where(f.column()).select("height", "log_index")


def _txs(v: Views, f: filters.TransactionFilter) -> DataFrame:
    return v.tx.where(f.column(normalized=True)).select("height", "transaction_index")


HANDLERS = [
    filters.Handler("purchases", filters.LOG, filters.LogFilter(topics=(PURCHASE,)), 5, None),
    filters.Handler("user7", filters.LOG, filters.LogFilter(address=USER7), 0, 900),
    filters.Handler("not_error", filters.LOG, filters.LogFilter(topics=(None, None)), 10, 500),
    filters.Handler("creations", filters.TRANSACTION, filters.TransactionFilter(to="0x" + "3".rjust(40, "0")), 0, 200),
    filters.Handler("every_tenth", filters.BLOCK, filters.BlockFilter(10), 3, None),
]
_HANDLER_SQL = f"""
, m AS (
  SELECT 'purchases' AS handler, height FROM v_logs WHERE topic0 = '{PURCHASE}' AND height >= 5
  UNION ALL SELECT 'user7', height FROM v_logs WHERE lower(address) = '{USER7.lower()}' AND height <= 900
  UNION ALL SELECT 'not_error', height FROM v_logs WHERE height BETWEEN 10 AND 500
  UNION ALL SELECT 'creations', height FROM v_tx WHERE recipient = '0x{"3".rjust(40, "0")}' AND height <= 200
  UNION ALL SELECT 'every_tenth', height FROM v_headers WHERE height % 10 = 0 AND height >= 3),
names AS (SELECT unnest(['purchases', 'user7', 'not_error', 'creations', 'every_tenth']) AS handler),
c AS (SELECT h.height, n.handler, count(m.height) AS n FROM v_headers h CROSS JOIN names n LEFT JOIN m ON m.height = h.height AND m.handler = n.handler GROUP BY ALL)
"""


@query("handler_match_counts", _HANDLER_SQL + "SELECT * FROM c")
def _(v):
    return filters.match_counts(HANDLERS, v.headers, v.logs, v.tx)


@query("block_match_total", _HANDLER_SQL + "SELECT height, sum(n)::BIGINT AS n FROM c GROUP BY height")
def _(v):
    return filters.block_totals(filters.match_counts(HANDLERS, v.headers, v.logs, v.tx))


# --- filters
query("hex_eq", _LOG + f"lower(address) = '{USER7.lower()}'")(lambda v: v.logs.where(hexcols.equals(F.col("address"), USER7[2:].upper())).select("height", "log_index"))
query("log_filter_address", _LOG + f"lower(address) = '{USER7.lower()}'")(lambda v: _logs(v, filters.LogFilter(USER7)))
query("log_filter_topic", _LOG + f"topic0 = '{PURCHASE}'")(lambda v: _logs(v, filters.LogFilter(topics=(PURCHASE,))))
query("log_filter_topic_or", _LOG + f"topic0 IN ('{PURCHASE}', '{ERROR}')")(lambda v: _logs(v, filters.LogFilter(topics=((PURCHASE, ERROR),))))
query("log_filter_topic_any", _LOG + f"topic0 = '{ERROR}'")(lambda v: _logs(v, filters.LogFilter(topics=(ERROR, None, None))))
query("log_filter_positional", _LOG + f"topic1 = '{TOPIC7}' AND topic2 IS NOT NULL AND topic0 = '{PURCHASE}' AND topic2 <= '0x{'5'.rjust(64, '0')}' AND topic2 >= '0x{'0'.rjust(64, '0')}'")(
    lambda v: _logs(v, filters.LogFilter(topics=(PURCHASE, TOPIC7, tuple("0x" + str(k).rjust(64, "0") for k in range(6)))))
)
query("log_filter_empty", _LOG + "true")(lambda v: _logs(v, filters.LogFilter()))


@query("pinned_topic0", f"SELECT 1 AS filter, '{PURCHASE}' AS topic0, (SELECT count(*) FROM v_logs WHERE topic0 = '{PURCHASE}') AS n UNION ALL SELECT 2, NULL, (SELECT count(*) FROM v_logs WHERE topic0 IN ('{PURCHASE}', '{ERROR}')) UNION ALL SELECT 3, NULL, (SELECT count(*) FROM v_logs)")
def _(v):
    own = [filters.LogFilter(topics=(PURCHASE,)), filters.LogFilter(topics=((PURCHASE, ERROR),)), filters.LogFilter()]
    counts = v.logs.agg(*[F.count_if(f.column()).alias(f"n{i}") for i, f in enumerate(own)])
    rows = [F.struct(F.lit(i + 1).alias("filter"), F.lit(f.pinned_topic0()).cast("string").alias("topic0"), F.col(f"n{i}").alias("n")) for i, f in enumerate(own)]
    return counts.select(F.inline(F.array(*rows)))


query("tx_filter_to", _TX + f"recipient = '0x{'3'.rjust(40, '0')}'")(lambda v: _txs(v, filters.TransactionFilter(to="0x" + "3".rjust(40, "0"))))
query("tx_filter_from", _TX + f"sender = '0x{'42'.rjust(40, '0')}'")(lambda v: _txs(v, filters.TransactionFilter(sender="42".rjust(40, "0"))))
query("tx_filter_selector", _TX + f"starts_with(input, '0x{_md5('1-URGENT')[:8]}')")(lambda v: _txs(v, filters.TransactionFilter(function=_md5("1-URGENT")[:8].upper())))
query("block_filter_modulo", "SELECT height FROM v_headers WHERE height % 7 = 0")(lambda v: v.headers.where(filters.BlockFilter(7).column()).select("height"))


@query("event_matches", f"""SELECT height, log_index, coalesce(topic0 = '{PURCHASE}', false) AS as_log, false AS as_block, false AS malformed FROM v_logs""")
def _(v):
    rows = v.logs.withColumn("tx_hash", F.lit(None).cast("string"))
    return rows.select("height", "log_index", filters.event_matches("log", '{"topics": ["%s"]}' % PURCHASE).alias("as_log"), filters.event_matches("block", None).alias("as_block"), filters.event_matches("log", '{"address": 42}').alias("malformed"))


query("active_datasources", "SELECT name, kind FROM v_sources WHERE start <= 120 AND (stop IS NULL OR stop >= 120)")(lambda v: filters.active_sources(v.sources, 120).select("name", "kind"))
query("filters_for_kind", "SELECT name, start FROM v_sources WHERE kind = 'log'")(lambda v: filters.for_kind(v.sources, "log").select("name", "start"))
query("bypass_heights", "SELECT height FROM v_headers WHERE NOT EXISTS (SELECT 1 FROM v_spans WHERE height BETWEEN a AND b)")(lambda v: filters.without_spans(v.headers.select("height"), v.spans))
query("candidate_heights", f"SELECT DISTINCT height FROM v_logs WHERE height BETWEEN 100 AND 800 AND topic0 = '{PURCHASE}' AND lower(address) = '{USER7.lower()}'")(lambda v: filters.candidate_heights(v.logs, 100, 2000, 800, [PURCHASE], [USER7]))
query("generate_heights", "SELECT h AS height FROM range(17, 5001) t(h)")(lambda v: planning.heights(v.spark, 17, 5000))
query("union_datasources", "SELECT name, start, false AS dynamic FROM v_sources WHERE kind = 'log' UNION ALL SELECT 'dyn' || id, height, true FROM v_ops WHERE op = 'Remove' AND entity = 'Ghost'")(
    lambda v: filters.for_kind(v.sources, "log").select("name", "start", F.lit(False).alias("dynamic")).unionByName(v.ops.where("op = 'Remove' and entity = 'Ghost'").select(F.concat(F.lit("dyn"), "id").alias("name"), F.col("height").alias("start"), F.lit(True).alias("dynamic")))
)

# --- sources and decoding
query("header_scan", "SELECT height, hash, parent_hash FROM v_headers")(lambda v: v.headers.select("height", "hash", "parent_hash"))
query("safe_head", "SELECT height, height AS unfinalized, least(height, height - height % 7 + 3) AS finalized FROM v_headers")(
    lambda v: v.headers.select("height", planning.safe_head(F.col("height"), F.lit(0), True).alias("unfinalized"), planning.safe_head(F.col("height"), F.col("height") - F.col("height") % 7 + 3, False).alias("finalized"))
)
query("journal_latest", "SELECT height, hash, parent_hash FROM v_headers ORDER BY height DESC LIMIT 1")(lambda v: lineage.latest(v.headers))
query("fingerprint", "SELECT c_name AS name, sha256(length(c_name)::VARCHAR || ':' || c_name || length(c_mktsegment)::VARCHAR || ':' || c_mktsegment) AS fingerprint FROM customer")(
    lambda v: v.table("customer").select(F.col("c_name").alias("name"), F.sha2(F.concat(F.length("c_name").cast("string"), F.lit(":"), "c_name", F.length("c_mktsegment").cast("string"), F.lit(":"), "c_mktsegment"), 256).alias("fingerprint"))
)
def _hex_of(event: DataFrame, long, odd) -> DataFrame:
    third = F.col("event_id") % 3
    return event.select("event_id", F.when(third == 0, F.concat(F.lit("0x"), F.md5("props"), long)).when(third == 1, odd).otherwise(F.concat(F.lit("0x"), F.md5("props"), F.lit("a"))).alias("c"))


query("hash32", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '0x' || md5(props) || md5(props) WHEN 1 THEN '0x' || md5(props) || md5(event_type) END AS hash FROM events")(
    lambda v: _hex_of(v.table("events"), F.md5("props"), F.concat(F.lit("0x"), F.upper(F.md5("props")), F.md5("event_type"))).select("event_id", hexcols.hash32(F.col("c")).alias("hash"))
)
query("hex_bytes", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '0x' || md5(props) || 'ab' WHEN 1 THEN '0x' END AS data FROM events")(
    lambda v: _hex_of(v.table("events"), F.lit("AB"), F.lit("0x")).select("event_id", hexcols.data(F.col("c")).alias("data"))
)
query("unsigned_quantity", "SELECT event_id, (9223372036854775808::HUGEINT + event_id)::VARCHAR AS quantity FROM events")(
    lambda v: v.table("events").select("event_id", hexcols.unsigned(F.concat(F.lit("0x8"), F.lpad(F.hex("event_id"), 15, "0"))).cast("string").alias("quantity"))
)
query("block_to_header", "SELECT height, hash, parent_hash, floor(epoch(timestamp))::BIGINT AS seconds FROM v_headers")(lambda v: decode.headers(v.raw_blocks).select("height", "hash", "parent_hash", F.unix_seconds("timestamp").alias("seconds")))


def _part(x: str) -> str:
    return f"unhex(lpad(format('{{:x}}', octet_length(encode({x}))), 16, '0')) || encode({x})"


@query("project_fingerprint", "SELECT n_name AS name, sha256(" + " || ".join(map(_part, ["'blockloom-project-v1'", """'{"name":"' || n_name || '"}'""", "n_name", "'abi'", "n_regionkey::VARCHAR"])) + ") AS fingerprint FROM nation")
def _(v):
    # a project for each nation: manifests are driver-side files, and nations are 25 at any scale
    own = v.table("nation").select("n_name", F.col("n_regionkey").cast("string").alias("r")).collect()
    rows = [(n, project.digest(project.fingerprint_parts({"name": n}, n.encode(), [("abi", r.encode())]))) for n, r in own]
    return v.spark.createDataFrame(rows, "name string, fingerprint string")


query("timestamp_text", "SELECT height, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS text FROM v_headers")(lambda v: v.headers.select("height", handlers.rfc3339(F.col("timestamp").cast("timestamp")).alias("text")))
query("hex_quantity", "SELECT event_id, event_id * 7919 AS quantity, CAST(NULL AS BIGINT) AS padded FROM events")(
    lambda v: v.table("events").select("event_id", hexcols.quantity(F.concat(F.lit("0x"), F.lower(F.hex(F.col("event_id") * 7919)))).alias("quantity"), hexcols.quantity(F.concat(F.lit("0x0"), F.lower(F.hex(F.col("event_id") + 1)))).alias("padded"))
)
query("normalize_address", "SELECT height, log_index, lower(address) AS address FROM v_logs")(lambda v: v.logs.select("height", "log_index", hexcols.address(F.col("address")).alias("address")))


def _raw_blocks(v: Views) -> DataFrame:
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    t = v.tx.join(v.headers.select("height", F.col("hash").alias("block_hash")), "height")
    one = F.struct(
        "hash", F.when(F.col("transaction_index") == 13, F.col("hash")).otherwise(F.col("block_hash")).alias("blockHash"), hexed(F.col("height")).alias("blockNumber"), hexed(F.col("transaction_index")).alias("transactionIndex"),
        "from", "to", hexed(F.col("value").cast("long")).alias("value"), "input",
    )
    rows = t.groupBy("height", "block_hash").agg(F.array_sort(F.collect_list(F.struct("transaction_index", one.alias("t")))).alias("l"))
    return rows.select(hexed(F.col("height")).alias("number"), F.col("block_hash").alias("hash"), F.transform("l", lambda x: x["t"]).alias("transactions"))


@query("decode_header", "SELECT height, hash, parent_hash, height + 1700000000 AS seconds FROM v_headers")
def _(v):
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    raw = v.headers.select(hexed(F.col("height")).alias("number"), F.upper("hash").alias("hash"), F.col("parent_hash").alias("parentHash"), hexed(F.col("height") + 1700000000).alias("timestamp"), F.col("height").alias("requested"))
    raw = raw.withColumn("hash", F.regexp_replace("hash", "^0X", "0x"))
    return decode.checked_header(raw).select("height", "hash", "parent_hash", F.unix_timestamp("timestamp").alias("seconds"))


@query("validate_transactions", "SELECT height, count(*) AS n, count(*) FILTER (transaction_index = 13 OR position <> transaction_index) AS bad, count(*) - count(DISTINCT hash) AS repeated FROM (SELECT t.*, row_number() OVER (PARTITION BY t.height ORDER BY transaction_index) - 1 AS position FROM v_tx t JOIN v_headers h ON t.height = h.height) GROUP BY height")
def _(v):
    return decode.transaction_faults(decode.transactions(_raw_blocks(v)))


@query("validate_logs", "SELECT l.height, l.log_index, coalesce(t.hash = l.transaction_hash AND NOT l.removed AND n_topics <= 4, false) AS ok FROM v_txlogs l LEFT JOIN v_tx t ON t.height = l.height AND t.transaction_index = l.transaction_index")
def _(v):
    return decode.check_logs(v.tx_logs, v.tx).select("height", "log_index", "ok")


@query("log_index_contiguous", "SELECT height, min(log_index) = 0 AND max(log_index) = count(*) - 1 AND count(DISTINCT log_index) = count(*) AS ok FROM v_txlogs WHERE NOT (removed AND height % 5 = 0) GROUP BY height")
def _(v):
    return lineage.contiguous(v.tx_logs.where("not (removed and height % 5 = 0)"), "height", "log_index")


@query("decode_events", "SELECT l.height, l.log_index, t.hash AS tx_hash, t.recipient AS \"to\", t.value FROM v_txlogs l LEFT JOIN (SELECT * FROM v_tx WHERE transaction_index <> 7) t ON t.height = l.height AND t.transaction_index = l.transaction_index")
def _(v):
    return decode.events(v.tx_logs, v.tx.where("transaction_index != 7")).select("height", "log_index", "tx_hash", "to", "value")


# --- height maps
query("asof_datasource", "SELECT h.height, m.value FROM v_headers h ASOF LEFT JOIN v_heightmap m ON h.height >= m.start_height")(lambda v: heightmap.as_of(v.headers.select("height"), v.heightmap))
query("height_map_ranges", "SELECT start_height AS start, lead(start_height) OVER (ORDER BY start_height) - 1 AS \"end\", value FROM v_heightmap")(lambda v: heightmap.ranges(v.heightmap))
query("height_map_within", "SELECT start_height, value FROM (SELECT *, lead(start_height) OVER (ORDER BY start_height) AS nxt FROM v_heightmap) WHERE start_height BETWEEN 100 AND 300 OR (start_height < 100 AND nxt >= 100)")(lambda v: heightmap.within(v.heightmap, 100, 300))

# --- lineage
query("parent_link_check", "SELECT c.height, coalesce(c.parent_hash = p.hash, false) AS linked FROM v_canonical c JOIN v_canonical p ON c.height = p.height + 1")(lambda v: lineage.parent_links(v.canonical))
query("continues_chain", "SELECT c.height, coalesce(c.height = 41 AND c.parent_hash = (SELECT hash FROM v_headers WHERE height = 40), false) AS continues FROM v_canonical c")(lambda v: lineage.continues(v.canonical, 40, "0x" + _md5("h40") * 2))
_COMPARED = "SELECT s.height, s.hash AS stored_hash, c.hash AS canonical_hash, coalesce(s.hash = c.hash, false) AS matches FROM v_headers s LEFT JOIN v_canonical c USING (height), v_top WHERE s.height BETWEEN top - 200 AND top"
query("reorg_compare", _COMPARED)(lambda v: lineage.compare(v.headers, v.canonical, v.top))
query("find_common_ancestor", f", x AS ({_COMPARED}) SELECT CASE WHEN count(*) = 0 OR max(height) FILTER (matches) = max(height) THEN 'canonical' WHEN bool_or(matches) THEN 'rewind' ELSE 'beyond_history' END AS decision, CASE WHEN max(height) FILTER (matches) = max(height) THEN NULL WHEN bool_or(matches) THEN max(height) FILTER (matches) ELSE min(height) END AS ancestor, (SELECT count(*) FROM x WHERE height > (SELECT max(height) FROM x WHERE matches)) AS depth FROM x")(
    lambda v: lineage.common_ancestor(lineage.compare(v.headers, v.canonical, v.top))
)
query("headers_descending", "SELECT height, hash FROM v_headers WHERE height BETWEEN 20 AND 90 ORDER BY height DESC")(lambda v: lineage.descending(v.headers, 20, 90).select("height", "hash"))
query("truncate_above", "SELECT height, hash FROM v_headers WHERE height <= 50")(lambda v: lineage.truncated_above(v.headers, 50).select("height", "hash"))
query("prune_below", "SELECT height, finality FROM v_headers WHERE NOT (height < 50 AND finality = 'final')")(lambda v: lineage.pruned_below(v.headers, 50).select("height", "finality"))
query("journal_append_check", "SELECT c.height, CASE WHEN c.height = 60 THEN 'repeat' WHEN c.height < 60 THEN 'refused' WHEN c.parent_hash = p.hash THEN 'append' ELSE 'refused' END AS status FROM v_canonical c LEFT JOIN v_canonical p ON c.height = p.height + 1 WHERE c.height >= 55")(
    lambda v: lineage.append_check(v.headers.where("height = 60"), v.canonical.where("height >= 55"))
)
query("gaps_islands", ", g AS (SELECT height, height - row_number() OVER (ORDER BY height) AS k FROM (SELECT DISTINCT height FROM v_logs WHERE NOT EXISTS (SELECT 1 FROM v_spans WHERE height BETWEEN a AND b))) SELECT min(height) AS start, max(height) AS \"end\", count(*) AS n FROM g GROUP BY k")(
    lambda v: ordered.islands(filters.without_spans(v.headers.select("height"), v.spans), bucket=64)
)
query("finalized_running_max", "SELECT height, max((height * 7919) % 1009) OVER (ORDER BY height) AS finalized FROM v_headers")(lambda v: ordered.running_max(v.headers.select("height"), (F.col("height") * 7919) % 1009, "height", "finalized", bucket=64).select("height", "finalized"))

# --- ordered commit
query("fence_all_arrivals", ARRIVALS_SQL + "SELECT arrival_pos, height FROM every_arrival WHERE generation = 1")(lambda v: ordered.fenced(v.every_arrival, 1).select("arrival_pos", "height"))
query(
    "commit_order_of_all",
    ARRIVALS_SQL + ", f AS (SELECT height, min(arrival_pos) AS p FROM every_arrival WHERE generation = 1 AND height >= 100 GROUP BY height), r AS (SELECT *, height - row_number() OVER (ORDER BY height) AS k FROM f) SELECT height, max(p) OVER (ORDER BY height) AS released_at FROM r WHERE k = (SELECT k FROM r WHERE height = 100)",
)(lambda v: ordered.release_order(v.every_arrival, 100, 1))
query("gap_of_all", ARRIVALS_SQL + "SELECT (SELECT gap FROM every_top) AS expected, min(height) AS lowest FROM every_arrival WHERE generation = 1 AND height >= (SELECT gap FROM every_top) HAVING min(height) > (SELECT gap FROM every_top)")(
    lambda v: ordered.stall_gap(v.every_arrival, v.every_gap, 1)
)

# --- planning
_ARGS = [(100, 1000, 10, None), (100, 102, 100, None), (101, 100, 10, None), (100, 100, 10, None), (150, 900, 20, None), (140, 900, 50, None), (290, 305, 100, 300), (300, 305, 100, None), (0, 5, 10, None), (5, 500, 0, None)]


@query("next_batch", """, q(cursor, head, size, stop) AS (VALUES (100,1000,10,NULL),(100,102,100,NULL),(101,100,10,NULL),(100,100,10,NULL),(150,900,20,NULL),(140,900,50,NULL),(290,305,100,300),(300,305,100,NULL),(0,5,10,NULL),(5,500,0,NULL)),
 a AS (SELECT *, least(head, coalesce(stop, head)) AS c, coalesce((SELECT max(b) + 1 FROM v_spans WHERE cursor BETWEEN a AND b), cursor) AS s FROM q),
 b AS (SELECT *, least(s + size - 1, c) AS e, size > 0 AND cursor <= c AND s <= c AS fits FROM a)
 SELECT cursor::BIGINT AS cursor, head::BIGINT AS head, size::BIGINT AS size, CASE WHEN fits THEN s END::BIGINT AS start, CASE WHEN fits THEN coalesce((SELECT min(x.a) - 1 FROM v_spans x WHERE x.a > s AND x.a <= e), e) END::BIGINT AS last FROM b""")
def _(v):
    rows = v.spark.createDataFrame(_ARGS, "cursor long, head long, size long, end long")
    return planning.plan_batches(rows, v.spans).drop("end")


query("backpressure_budget", "SELECT height, greatest(0, least(50 - height % 70, 100 - (height % 90 + height % 70))) AS budget FROM v_headers")(
    lambda v: v.headers.select("height", planning.budget_column(50, 100, F.col("height") % 90, F.col("height") % 70).alias("budget"))
)
query("progress_snapshot", "SELECT height, greatest(500 - height, 0) AS behind, height >= 500 AS caught_up FROM v_headers")(
    lambda v: v.headers.select("height", *[c.alias(n) for c, n in zip(planning.progress(F.col("height"), F.lit(500).cast("long")), ("behind", "caught_up"))])
)

# --- entities
_E = "SELECT id, name, nation, cents, segment FROM v_customers WHERE "
for _op, _sql, _cond in (
    ("eq", "segment = 'BUILDING'", ("segment", "eq", "BUILDING")), ("ne", "nation <> 5", ("nation", "ne", 5)), ("in", "nation IN (1, 2, 9)", ("nation", "in", [1, 2, 9])), ("not_in", "nation NOT IN (1, 2, 9)", ("nation", "not_in", [1, 2, 9])),
    ("lt", "cents < 100000", ("cents", "lt", 100000)), ("lte", "id <= 77", ("id", "lte", 77)), ("gt", "cents > 500000", ("cents", "gt", 500000)), ("gte", "nation >= 20", ("nation", "gte", 20)),
):
    query(f"get_by_fields_{_op}", _E + _sql)(lambda v, c=_cond: entities.by_fields(v.customers, c))
query("get_by_fields_page", _E + "cents > 0 ORDER BY nation ASC NULLS LAST, id LIMIT 40 OFFSET 25")(lambda v: entities.page(entities.by_fields(v.customers, ("cents", "gt", 0)), "nation", limit=40, offset=25))
query("get_by_id", _E + "id = 42")(lambda v: entities.get(v.customers, 42))
query("get_one_by_field", _E + "segment = 'MACHINERY' ORDER BY id LIMIT 1")(lambda v: entities.get_one(v.customers, "segment", "MACHINERY"))
query("dump_canonical", "SELECT cents::VARCHAR AS cents, id::VARCHAR AS id, name, nation::VARCHAR AS nation, segment FROM v_customers ORDER BY v_customers.id")(lambda v: entities.canonical(v.customers))

# --- change log
query("compact_changelog", "SELECT entity, id, height, op_seq, data FROM (SELECT *, row_number() OVER (PARTITION BY entity, id ORDER BY height DESC, handler_seq DESC, op_seq DESC) AS rn FROM v_ops) WHERE rn = 1 AND op = 'Set'")(lambda v: changelog.compact(v.ops).select("entity", "id", "height", "op_seq", "data"))
query("entity_versions", "SELECT * FROM v_history")(lambda v: changelog.versions(v.ops))
query("state_as_of", "SELECT entity, id, data FROM v_history WHERE valid_from <= 300 AND (valid_to IS NULL OR valid_to > 300)")(lambda v: changelog.as_of(changelog.versions(v.ops), 300).select("entity", "id", "data"))
query("rewind_versions", "SELECT entity, id, data, valid_from, CASE WHEN valid_to <= 60 THEN valid_to END AS valid_to FROM v_history WHERE valid_from <= 60")(lambda v: changelog.rewound(changelog.versions(v.ops), 60))
query("rewind_report", "SELECT (SELECT count(*) FROM v_history WHERE valid_from > 60) AS deleted, (SELECT count(*) FROM v_history WHERE valid_from <= 60 AND valid_to > 60) AS reopened, (SELECT count(*) FROM v_headers WHERE height > 60) AS headers_removed, (SELECT greatest(max(height) - 60, 0) FROM v_headers) AS blocks_discarded")(
    lambda v: changelog.rewind_report(changelog.versions(v.ops), v.headers, 60)
)
query("upsert_repeated", "SELECT id, name, nation, cents, segment FROM v_customers WHERE id % 10 <> 3 UNION ALL SELECT id, name || '2', NULL, cents + 2, NULL FROM v_customers WHERE id % 10 = 3")(
    lambda v: changelog.upserted(v.customers, v.customers.where("id % 10 = 3").select("id", F.explode(F.array(F.lit(2), F.lit(1))).alias("turn"), "name", "cents").select("id", F.concat("name", F.col("turn").cast("string")).alias("name"), (F.col("cents") + F.col("turn")).alias("cents"), "turn"), order=("turn",))
)
query("upsert_entities", "SELECT id, name, nation, cents, segment FROM v_customers WHERE id % 10 <> 3 UNION ALL SELECT id, name || '!', NULL, cents + 1, NULL FROM v_customers WHERE id % 10 = 3 UNION ALL SELECT id + 10000000, name || '!', NULL, cents + 1, NULL FROM v_customers WHERE id % 100 = 3")(
    lambda v: changelog.upserted(v.customers, v.customers.where("id % 10 = 3").unionByName(v.customers.where("id % 100 = 3").withColumn("id", F.col("id") + 10000000)).select("id", F.concat("name", F.lit("!")).alias("name"), (F.col("cents") + 1).alias("cents")))
)
query("remove_entities", "SELECT id, name FROM v_customers WHERE id % 3 <> 0")(lambda v: changelog.removed(v.customers, v.customers.where("id % 3 = 0")).select("id", "name"))
query("unknown_entity_rejects", "SELECT height, op_seq, entity FROM v_ops WHERE entity <> 'Account'")(lambda v: changelog.unknown_entities(v.ops, ["Account"]).select("height", "op_seq", "entity"))
query("block_is_empty", "SELECT h.height, count(o.height) = 0 AS is_empty FROM v_headers h LEFT JOIN (SELECT height FROM v_ops WHERE op = 'Remove' UNION ALL SELECT start FROM v_sources) o ON o.height = h.height GROUP BY h.height")(
    lambda v: changelog.empty_blocks(v.ops.where("op = 'Remove'"), v.sources.select(F.col("start").alias("height")), v.headers)
)

# --- metadata
_FACTS = "(SELECT 'project_id' AS key, 'p1' AS value UNION ALL SELECT 'chain_id', '1' UNION ALL SELECT 'schema_version', '1')"
query("checkpoint_load", "SELECT max(height) AS indexed_height, max_by(hash, height) AS indexed_block_hash, max(height) FILTER (finality = 'final') AS finalized_height FROM v_headers")(lambda v: metadata.checkpoint(_stored(v)))
query("metadata_verify", f"SELECT key, CASE key WHEN 'chain_id' THEN 'match' WHEN 'project_id' THEN 'mismatch' ELSE 'stamp' END AS status FROM {_FACTS}")(
    lambda v: metadata.verify(v.spark.createDataFrame([("project_id", "p1"), ("chain_id", "1"), ("schema_version", "1")], "key string, value string"), _stored(v))
)


def _stored(v: Views) -> DataFrame:
    tip = v.headers.agg(F.max_by(F.struct("height", "hash"), "height").alias("t"), F.max(F.when(F.col("finality") == "final", F.col("height"))).alias("f"))
    pair = lambda k, c: F.struct(F.lit(k).alias("key"), c.cast("string").alias("value"))
    return tip.select(F.inline(F.array(pair("indexed_height", F.col("t.height")), pair("indexed_block_hash", F.col("t.hash")), pair("finalized_height", F.col("f")), pair("chain_id", F.lit("1")), pair("project_id", F.lit("p2")))))


# --- balances of 256-bit amounts
@query("holder_balances", ", m AS (SELECT sender AS holder, value::HUGEINT * 1000000000000000000 AS v, 1 AS d FROM v_tx UNION ALL SELECT recipient, value::HUGEINT * 1000000000000000000, 0 FROM v_tx WHERE recipient IS NOT NULL) SELECT holder, (sum(CASE d WHEN 0 THEN v ELSE -v END))::VARCHAR AS balance, count(*) AS transfers FROM m GROUP BY holder")
def _(v):
    wei = v.tx.withColumn("value", F.concat("value", F.lit("0" * 18)))
    moves = wei.select(F.col("from").alias("holder"), F.col("value").alias("debit"), F.lit(None).cast("string").alias("credit")).unionByName(wei.where(F.col("to").isNotNull()).select(F.col("to").alias("holder"), F.lit(None).cast("string").alias("debit"), F.col("value").alias("credit")))
    sums = moves.groupBy("holder").agg(bignum.total(F.col("credit")).alias("credit"), bignum.total(F.col("debit")).alias("debit"), F.count("*").alias("transfers"))
    return sums.select("holder", bignum.difference(F.col("credit"), F.col("debit")).alias("balance"), "transfers")


# --- handlers
query("handler_status_codes", "SELECT height, op_seq, CASE WHEN entity <> 'Account' THEN -2 WHEN data IS NULL OR height % 13 = 0 THEN -1 ELSE 0 END AS status FROM v_ops WHERE op = 'Set'")(
    lambda v: v.ops.where("op = 'Set'").select("height", "op_seq", handlers.set_status(F.col("entity"), F.col("id"), F.when(F.col("height") % 13 == 0, F.lit("[1]")).otherwise(F.to_json(F.struct("id", "data"))), ["Account"]).alias("status"))
)
query("log_level_map", "SELECT height, log_index, CASE height % 7 WHEN 0 THEN 'trace' WHEN 1 THEN 'debug' WHEN 2 THEN 'info' WHEN 3 THEN 'warn' WHEN 4 THEN 'error' ELSE 'info' END AS level FROM v_logs")(lambda v: v.logs.select("height", "log_index", handlers.level_name(F.col("height") % 7).alias("level")))

TRANSFER = event_topic("Transfer(address,address,uint256)")
