"""Key/value facts: checkpoint and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The well-known keys.
KEYS = ("project_id", "schema_version", "manifest_hash", "chain_id", "indexed_height", "indexed_block_hash", "finalized_height", "updated_at", "mapping_abi_version")
CHECKPOINT = ("indexed_height", "indexed_block_hash", "finalized_height")


def checkpoint(kv: DataFrame) -> DataFrame:
    """One row of the three checkpoint keys, none if none is there; raises if only some are."""
    own = kv.where(F.col("key").isin(*CHECKPOINT))
    row = own.agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in CHECKPOINT], F.count("*").alias("n")).where("n > 0")
    missing = F.coalesce(*[F.when(F.coalesce(F.col(k), F.lit("")) == "", F.lit(k)) for k in CHECKPOINT])
    fail = F.raise_error(F.concat(F.lit("incomplete checkpoint: missing "), missing))
    guarded = lambda k: F.when(missing.isNotNull(), fail.cast("string")).otherwise(F.col(k))
    return row.select(guarded("indexed_height").cast("long").alias("indexed_height"), guarded("indexed_block_hash").alias("indexed_block_hash"), guarded("finalized_height").cast("long").alias("finalized_height"))


def verify(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, status) of each expected fact: match, mismatch or stamp (not there yet)."""
    own = stored.select("key", F.col("value").alias("__stored"))
    status = F.when(F.col("__stored").isNull(), "stamp").when(F.col("__stored") == F.col("value"), "match").otherwise("mismatch")
    return expected.join(own, "key", "left").select("key", status.alias("status"))
