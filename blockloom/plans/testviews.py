"""The star-schema tables seen as block streams: the same derivations as DataFrames and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _md5x2(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.md5(c), F.md5(c))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def logs(self) -> DataFrame:
        e = self.table("events")
        t0 = _md5x2(F.col("event_type"))
        user = F.concat(F.lit("0x"), _pad(F.col("user_id"), 64))
        k = F.concat(F.lit("0x"), _pad(F.regexp_extract("props", r"(\d+)", 1), 64))
        topics = F.when(F.col("event_type") == "error", F.array(t0)).when(F.col("event_type") == "purchase", F.array(t0, user, k)).otherwise(F.array(t0, user))
        return e.select(
            F.floor(F.col("event_id") / 10).cast("long").alias("height"), (F.col("event_id") % 10).alias("log_index"), F.concat(F.lit("0xAb"), _pad(F.col("user_id"), 38)).alias("address"),
            t0.alias("topic0"), topics.alias("topics"), "ts", "user_id", "event_type", "value", "props",
        )

    @cached_property
    def headers(self) -> DataFrame:
        h = self.logs.groupBy("height").agg(F.max("ts").alias("timestamp"))
        name = lambda c: _md5x2(F.concat(F.lit("h"), c.cast("string")))
        return h.select("height", name(F.col("height")).alias("hash"), F.when(F.col("height") > 0, name(F.col("height") - 1)).alias("parent_hash"), "timestamp", F.when(F.col("height") % 3 == 0, "unfinalized").otherwise("final").alias("finality"))

    @cached_property
    def top(self) -> int:
        """The highest height: one value by a combining aggregate over one column."""
        return (self.table("events").agg(F.max("event_id")).first()[0] or 0) // 10

    @cached_property
    def canonical(self) -> DataFrame:
        """A fork of the three highest blocks."""
        fork = _md5x2(F.concat(F.lit("f"), F.col("height").cast("string")))
        return self.headers.withColumn("hash", F.when(F.col("height") > self.top - 3, fork).otherwise(F.col("hash")))

    @cached_property
    def tx(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.floor(F.col("o_orderkey") / 50).cast("long").alias("height"), (F.col("o_orderkey") % 50).alias("transaction_index"), _md5x2(F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))).alias("hash"),
            F.concat(F.lit("0x"), _pad(F.col("o_custkey"), 40)).alias("from"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("0x"), _pad(F.col("o_custkey") % 7, 40))).alias("to"),
            F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("value"), F.concat(F.lit("0x"), F.substring(F.md5("o_orderpriority"), 1, 8), _pad(F.col("o_orderkey"), 8)).alias("input"),
        )

    @cached_property
    def tx_logs(self) -> DataFrame:
        li = self.table("lineitem")
        h = F.floor(F.col("l_orderkey") / 50).cast("long")
        w = Window.partitionBy("height").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
        wrong = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
        rows = li.withColumn("height", h).withColumn("log_index", F.row_number().over(w).cast("long") - 1)
        return rows.select(
            "height", "log_index", (F.col("l_orderkey") % 50).alias("transaction_index"), _md5x2(F.concat(F.when(wrong, F.lit("w")).otherwise(F.lit("t")), F.col("l_orderkey").cast("string"))).alias("transaction_hash"),
            ((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 2)).alias("removed"), F.array_repeat(F.lit("0x00"), (F.col("l_partkey") % 6).cast("int")).alias("topics"), F.col("l_suppkey").alias("supplier"),
        )

    @cached_property
    def ops(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.floor(F.col("event_id") / 10).cast("long").alias("height"), F.lit(0).cast("long").alias("handler_seq"), (F.col("event_id") % 10).alias("op_seq"),
            F.when(F.col("event_type") == "error", "Remove").otherwise("Set").alias("op"), F.when(F.col("user_id") % 11 == 0, "Ghost").otherwise("Account").alias("entity"), F.col("user_id").cast("string").alias("id"),
            F.round(F.col("value") * 100).cast("long").cast("string").alias("data"),
        )

    @cached_property
    def heightmap(self) -> DataFrame:
        return self.table("nation").select((F.col("n_nationkey") * 37).cast("long").alias("start_height"), F.col("n_name").alias("value"))

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        """Bypass spans of the project's configuration: one for each of five regions."""
        return [(r * 150, r * 150 + 9) for r in range(5)]

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.nullif(F.col("c_nationkey").cast("long"), F.lit(3).cast("long")).alias("nation"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"), F.col("c_mktsegment").alias("segment"))

    @cached_property
    def sources(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") * 3).alias("start"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") * 3 + 200).alias("end"), F.when(F.col("s_suppkey") % 3 == 0, "log").when(F.col("s_suppkey") % 3 == 1, "transaction").otherwise("block").alias("kind"))

    @cached_property
    def every_gap(self) -> int:
        """A height that never comes, 700 below the last event."""
        return (self.table("events").agg(F.max("event_id")).first()[0] or 0) - 700

    @cached_property
    def every_arrival(self) -> DataFrame:
        """Blocks as they come from workers, one for each event: out of order, some of an older generation and, behind all others, once more."""
        e = self.table("events")
        swapped = F.col("event_id") + F.when(F.col("event_id") % 4 == 0, 3).when(F.col("event_id") % 4 == 3, -3).otherwise(0)
        rows = e.select(F.col("event_id").alias("arrival_pos"), F.when(F.col("event_id") % 17 == 0, 0).otherwise(1).cast("long").alias("generation"), swapped.alias("height"))
        again = rows.where("arrival_pos % 17 = 0").select((F.col("arrival_pos") + self.every_gap + 701).alias("arrival_pos"), F.lit(1).cast("long").alias("generation"), "height")
        return rows.unionByName(again).where(F.col("height") != self.every_gap)

    @cached_property
    def raw_blocks(self) -> DataFrame:
        """Headers as a node answers them."""
        number = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
        return self.headers.select(number(F.col("height")).alias("number"), F.upper(F.col("hash")).alias("hash"), F.col("parent_hash").alias("parentHash"), number(F.unix_seconds(F.col("timestamp").cast("timestamp"))).alias("timestamp"))


SQL = r"""
WITH v_logs AS (
  SELECT event_id // 10 AS height, event_id % 10 AS log_index, '0xAb' || lpad(user_id::VARCHAR, 38, '0') AS address, '0x' || md5(event_type) || md5(event_type) AS topic0,
    CASE WHEN event_type = 'error' THEN NULL ELSE '0x' || lpad(user_id::VARCHAR, 64, '0') END AS topic1,
    CASE WHEN event_type = 'purchase' THEN '0x' || lpad(regexp_extract(props, '(\d+)', 1), 64, '0') END AS topic2, ts, user_id, event_type, value, props FROM events),
v_headers AS (
  SELECT height, '0x' || md5('h' || height) || md5('h' || height) AS hash, CASE WHEN height > 0 THEN '0x' || md5('h' || (height - 1)) || md5('h' || (height - 1)) END AS parent_hash,
    max(ts) AS timestamp, CASE WHEN height % 3 = 0 THEN 'unfinalized' ELSE 'final' END AS finality FROM v_logs GROUP BY height),
v_top AS (SELECT max(height) AS top FROM v_headers),
v_canonical AS (SELECT height, CASE WHEN height > top - 3 THEN '0x' || md5('f' || height) || md5('f' || height) ELSE hash END AS hash, parent_hash FROM v_headers, v_top),
v_tx AS (
  SELECT o_orderkey // 50 AS height, o_orderkey % 50 AS transaction_index, '0x' || md5('t' || o_orderkey) || md5('t' || o_orderkey) AS hash, '0x' || lpad(o_custkey::VARCHAR, 40, '0') AS sender,
    CASE WHEN o_orderstatus <> 'P' THEN '0x' || lpad((o_custkey % 7)::VARCHAR, 40, '0') END AS recipient, round(o_totalprice * 100)::BIGINT::VARCHAR AS value,
    '0x' || left(md5(o_orderpriority), 8) || lpad(o_orderkey::VARCHAR, 8, '0') AS input FROM orders),
v_txlogs AS (
  SELECT l_orderkey // 50 AS height, row_number() OVER (PARTITION BY l_orderkey // 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS log_index,
    l_orderkey % 50 AS transaction_index, '0x' || md5((CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'w' ELSE 't' END) || l_orderkey) || md5((CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'w' ELSE 't' END) || l_orderkey) AS transaction_hash,
    (l_returnflag = 'A' AND l_linenumber = 2) AS removed, l_partkey % 6 AS n_topics, l_suppkey AS supplier FROM lineitem),
v_ops AS (
  SELECT event_id // 10 AS height, 0 AS handler_seq, event_id % 10 AS op_seq, CASE WHEN event_type = 'error' THEN 'Remove' ELSE 'Set' END AS op, CASE WHEN user_id % 11 = 0 THEN 'Ghost' ELSE 'Account' END AS entity,
    user_id::VARCHAR AS id, round(value * 100)::BIGINT::VARCHAR AS data FROM events),
v_heightmap AS (SELECT (n_nationkey * 37)::BIGINT AS start_height, n_name AS value FROM nation),
v_spans AS (SELECT (r * 150)::BIGINT AS a, (r * 150 + 9)::BIGINT AS b FROM range(5) t(r)),
v_customers AS (SELECT c_custkey AS id, c_name AS name, nullif(c_nationkey::BIGINT, 3) AS nation, round(c_acctbal * 100)::BIGINT AS cents, c_mktsegment AS segment FROM customer),
v_sources AS (SELECT s_name AS name, s_suppkey * 3 AS start, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 3 + 200 END AS stop, CASE s_suppkey % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'transaction' ELSE 'block' END AS kind FROM supplier),
v_versions AS (
  SELECT entity, id, op, data, height AS valid_from, lead(height) OVER (PARTITION BY entity, id ORDER BY height) AS valid_to FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, id, height ORDER BY handler_seq DESC, op_seq DESC) AS rn FROM v_ops) WHERE rn = 1),
v_history AS (SELECT entity, id, data, valid_from, valid_to FROM v_versions WHERE op = 'Set')
"""

#: As every_arrival, for the queries that ask for it.
ARRIVALS_SQL = r"""
, every_top AS (SELECT max(event_id) AS top, max(event_id) - 700 AS gap FROM events),
every_first AS (SELECT event_id AS arrival_pos, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 END::BIGINT AS generation, event_id + CASE event_id % 4 WHEN 0 THEN 3 WHEN 3 THEN -3 ELSE 0 END AS height FROM events),
every_arrival AS (SELECT * FROM (SELECT * FROM every_first UNION ALL SELECT arrival_pos + top + 1, 1, height FROM every_first, every_top WHERE arrival_pos % 17 = 0) WHERE height <> (SELECT gap FROM every_top))
"""
