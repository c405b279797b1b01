"""What to fetch next: driver arithmetic, and the same as a query over plan arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def safe_head(latest: Column | int, finalized: Column | int, unfinalized: bool) -> Column | int:
    """The highest height to index: the head, or what is final of it."""
    if unfinalized:
        return latest
    return min(latest, finalized) if isinstance(latest, int) else F.least(latest, finalized)


def next_batch(cursor: int, head: int, size: int, end: int | None = None, bypass: list[tuple[int, int]] = ()) -> tuple[int, int] | None:
    """Inclusive heights of the next batch, or none. A bypassed span at the cursor is skipped, one ahead ends the batch."""
    ceiling = head if end is None else min(head, end)
    if size == 0 or cursor > ceiling:
        return None
    start = next((b + 1 for a, b in merged_spans(list(bypass)) if a <= cursor <= b), cursor)
    if start > ceiling:
        return None
    last = min(start + size - 1, ceiling)
    ahead = [a - 1 for a, _ in bypass if start < a <= last]
    return start, min(ahead, default=last)


def budget(max_in_flight: int, capacity: int, queued: int, in_flight: int) -> int:
    """How many blocks may be fetched now."""
    if max_in_flight < 1 or capacity < 1:
        raise ValueError("limits must be at least 1")
    return max(0, min(max_in_flight - in_flight, capacity - queued - in_flight))


def budget_column(max_in_flight: int, capacity: int, queued: Column, in_flight: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(max_in_flight) - in_flight, F.lit(capacity) - (queued + in_flight)))


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one: then a height needs to move once at most."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def plan_batches(requests: DataFrame, bypass: list[tuple[int, int]]) -> DataFrame:
    """(cursor, head, size, end) to the same with start and last (null: nothing to do). Spans come from the configuration."""
    spans = merged_spans(bypass)
    cursor = F.col("cursor")
    moved = [F.when(cursor.between(a, b), F.lit(b + 1).cast("long")) for a, b in spans]
    rows = requests.withColumn("__c", F.least(F.col("head"), F.coalesce("end", "head"))).withColumn("__s", F.coalesce(*moved, cursor))
    rows = rows.withColumn("__e", F.least(F.col("__s") + F.col("size") - 1, F.col("__c")))
    cuts = [F.when((F.lit(a) > F.col("__s")) & (F.lit(a) <= F.col("__e")), F.lit(a - 1).cast("long")) for a, _ in bypass]
    end = F.least(F.col("__e"), *cuts) if cuts else F.col("__e")
    fits = (F.col("size") > 0) & (F.col("cursor") <= F.col("__c")) & (F.col("__s") <= F.col("__c"))
    return rows.select(*requests.columns, F.when(fits, F.col("__s")).alias("start"), F.when(fits, end).alias("last"))


def heights(spark, low: int, high: int) -> DataFrame:
    """Every height of an inclusive range."""
    return spark.range(low, high + 1).select(F.col("id").alias("height"))


def progress(indexed: Column, target: Column) -> tuple[Column, Column]:
    """Blocks behind (never negative), and whether caught up."""
    behind = F.greatest(target - indexed, F.lit(0))
    return behind, behind == 0
