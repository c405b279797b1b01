"""Set/Remove operations: current state, versions, as-of reads, upserts and rewinds.

Order within an id is (height, handler_seq, op_seq). Every step groups or joins by (entity, id), so
one partitioning serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SET, REMOVE = "Set", "Remove"
KEY = ("entity", "id")


def _order() -> Column:
    return F.struct("height", "handler_seq", "op_seq")


def last_operations(ops: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The last operation of every key: max_by combines before the shuffle, so a busy id sends one row per task."""
    rest = [c for c in ops.columns if c not in keys]
    return ops.groupBy(*keys).agg(F.max_by(F.struct(*rest), _order()).alias("__last")).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def compact(ops: DataFrame) -> DataFrame:
    """Current entities: last write wins, a last Remove deletes."""
    return last_operations(ops).where(F.col("op") == SET)


def versions(ops: DataFrame) -> DataFrame:
    """(entity, id, data, valid_from, valid_to): several operations at a height are its last one first; a Remove only ends a version."""
    one = last_operations(ops, (*KEY, "height"))
    after = F.lead("height").over(Window.partitionBy(*KEY).orderBy("height"))
    return one.withColumn("valid_to", after).where(F.col("op") == SET).select(*KEY, "data", F.col("height").alias("valid_from"), "valid_to")


def as_of(history: DataFrame, height: int) -> DataFrame:
    return history.where((F.col("valid_from") <= height) & (F.col("valid_to").isNull() | (F.col("valid_to") > height)))


def rewound(history: DataFrame, height: int) -> DataFrame:
    """Versions that began above the height go, versions that ended above it are open again."""
    kept = history.where(F.col("valid_from") <= height)
    return kept.withColumn("valid_to", F.when(F.col("valid_to") <= height, F.col("valid_to")))


def rewind_report(history: DataFrame, headers: DataFrame, height: int) -> DataFrame:
    """One row: versions deleted and reopened, headers removed, blocks discarded."""
    gone = F.count_if(F.col("valid_from") > height)
    again = F.count_if((F.col("valid_from") <= height) & (F.col("valid_to") > height))
    v = history.agg(gone.alias("deleted"), again.alias("reopened"))
    h = headers.agg(F.count_if(F.col("height") > height).alias("headers_removed"), F.greatest(F.max("height") - height, F.lit(0)).alias("blocks_discarded"))
    return v.join(F.broadcast(h), F.lit(True))  # one row each


def upserted(snapshot: DataFrame, changes: DataFrame, key: str = "id", order: tuple[str, ...] = ()) -> DataFrame:
    """Whole rows replaced by key; fields that a change lacks become null. Of several changes to one key the last in ``order`` stays; without an order one of them, the same for the same rows."""
    rest = [c for c in changes.columns if c != key]
    last = F.struct(*order) if order else F.xxhash64(*rest) if rest else F.lit(0)
    if rest:
        changes = changes.groupBy(key).agg(F.max_by(F.struct(*rest), last).alias("__last")).select(key, *[F.col(f"__last.`{c}`").alias(c) for c in rest])
    else:
        changes = changes.distinct()
    changed = changes.select(*[F.col(c) if c in changes.columns else F.lit(None).cast(snapshot.schema[c].dataType).alias(c) for c in snapshot.columns])
    return snapshot.join(changed.select(key), key, "left_anti").unionByName(changed)


def removed(snapshot: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return snapshot.join(gone.select(key), key, "left_anti")


def unknown_entities(ops: DataFrame, entities: list[str]) -> DataFrame:
    """Operations on entities that the project's schema does not have."""
    return ops.where(~F.col("entity").isin(entities) | F.col("entity").isNull())


def empty_blocks(ops: DataFrame, sources: DataFrame, headers: DataFrame) -> DataFrame:
    """(height, is_empty): a block is empty if it has neither operations nor new data sources."""
    busy = ops.select("height").unionByName(sources.select("height")).distinct().withColumn("busy", F.lit(True))
    return headers.select("height").join(busy, "height", "left").select("height", F.col("busy").isNull().alias("is_empty"))
