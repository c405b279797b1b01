"""Node answers to typed rows, with the checks of a block as predicates.

``mode="failfast"`` raises on the first block that does not fit, ``mode="quarantine"`` keeps its
height and reason in a side table: one bad row condemns its whole block either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import bignum, hexcols


def headers(raw: DataFrame) -> DataFrame:
    """height, hash, parent_hash, timestamp; null where a field is malformed."""
    return raw.select(hexcols.quantity(F.col("number")).alias("height"), hexcols.hash32(F.col("hash")).alias("hash"), hexcols.hash32(F.col("parentHash")).alias("parent_hash"), F.timestamp_seconds(hexcols.quantity(F.col("timestamp"))).alias("timestamp"))


def checked_header(raw: DataFrame, requested: str = "requested") -> DataFrame:
    """As headers; raises for a block that is missing or another than requested."""
    out = raw.select("*", hexcols.quantity(F.col("number")).alias("__h"))
    bad = F.when(F.col("number").isNull(), F.concat(F.lit("block unavailable: "), F.col(requested))).when(F.col("__h").isNull() | (F.col("__h") != F.col(requested)), F.concat(F.lit("not the requested block: "), F.col(requested)))
    out = out.withColumn("number", F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("number")))
    return headers(out)


def transactions(blocks: DataFrame) -> DataFrame:
    """One row per transaction of raw blocks, with ``ok``."""
    rows = blocks.select(hexcols.quantity(F.col("number")).alias("height"), hexcols.hash32(F.col("hash")).alias("block_hash"), F.posexplode("transactions").alias("position", "t"))
    t = lambda name: F.col(f"t.{name}")
    rows = rows.select(
        "height", "block_hash", "position",
        hexcols.hash32(t("hash")).alias("hash"), hexcols.quantity(t("transactionIndex")).alias("transaction_index"), hexcols.hash32(t("blockHash")).alias("__bh"), hexcols.quantity(t("blockNumber")).alias("__bn"),
        hexcols.address(t("from")).alias("from"), hexcols.address(t("to")).alias("to"), (t("to").isNull() | hexcols.address(t("to")).isNotNull()).alias("__to"), bignum.from_hex(t("value")).alias("value"), hexcols.data(t("input")).alias("input"),
    )
    ok = (F.col("transaction_index") == F.col("position")) & (F.col("__bh") == F.col("block_hash")) & (F.col("__bn") == F.col("height")) & F.col("from").isNotNull() & F.col("__to") & F.col("value").isNotNull() & F.col("input").isNotNull() & F.col("hash").isNotNull()
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("__bh", "__bn", "__to")


def transaction_faults(rows: DataFrame) -> DataFrame:
    """(height, n, bad, repeated): transactions that fail a check, and hashes that repeat within the block."""
    return rows.groupBy("height").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"), (F.count("*") - F.count_distinct("hash")).alias("repeated"))


def check_logs(logs: DataFrame, txs: DataFrame, most_topics: int = 4) -> DataFrame:
    """logs with ``ok``: their transaction is there by block and index with the same hash, they are not removed, have few topics."""
    known = txs.select("height", "transaction_index", F.col("hash").alias("__hash"))
    rows = logs.join(known, ["height", "transaction_index"], "left")
    ok = (F.col("__hash") == F.col("transaction_hash")) & ~F.col("removed") & (F.size("topics") <= most_topics)
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("__hash")


def events(logs: DataFrame, txs: DataFrame) -> DataFrame:
    """Every log with its transaction, or null where that is not there."""
    own = txs.select("height", "transaction_index", F.col("hash").alias("tx_hash"), "from", "to", "value", "input")
    return logs.join(own, ["height", "transaction_index"], "left")


def accepted(rows: DataFrame, faults: DataFrame, mode: str = "failfast") -> tuple[DataFrame, DataFrame]:
    """rows of good blocks, and the faulty heights. faults: (height, reason)."""
    if mode == "failfast":
        bad = faults.select("height", F.raise_error(F.concat(F.lit("block "), F.col("height").cast("string"), F.lit(": "), F.col("reason"))).cast("string").alias("reason"))
        return rows.join(bad.where(F.col("reason").isNull()).select("height"), "height", "left_anti"), bad
    if mode != "quarantine":
        raise ValueError(f"unknown mode {mode}")
    return rows.join(faults.select("height").distinct(), "height", "left_anti"), faults
