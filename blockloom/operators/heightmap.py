"""Values in force from a height until the next entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BUCKET = 1024


def ranges(entries: DataFrame) -> DataFrame:
    """(start, end, value): end is the height before the next entry, null for the last. The map is a small dimension (one row per change)."""
    after = F.lead("start_height").over(Window.orderBy("start_height"))
    return entries.select(F.col("start_height").alias("start"), (after - 1).alias("end"), "value")


def as_of(rows: DataFrame, entries: DataFrame, height: str = "height", strict: bool = False, bucket: int = BUCKET) -> DataFrame:
    """rows with the value in force at their height; before the first entry null, or an error if strict.

    Each interval is laid over the buckets of heights that it covers, up to the highest one in the
    rows, and joined on the bucket: an equi-join that shuffles once and holds for maps of any size.
    """
    spans = ranges(entries)
    top = rows.agg(F.max(height).alias("top"))
    spans = spans.join(F.broadcast(top), F.lit(True)).where(F.col("start") <= F.col("top"))  # top is one row
    last = F.least(F.coalesce("end", "top"), "top")
    spans = spans.select("start", last.alias("end"), "value", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(last / bucket))).alias("__b"))
    keyed = rows.withColumn("__b", F.floor(F.col(height) / bucket))
    inside = (keyed["__b"] == spans["__b"]) & keyed[height].between(spans["start"], spans["end"])
    out = keyed.join(spans, inside, "left").select(*[keyed[c] for c in rows.columns], spans["value"], spans["start"].alias("__start"))
    if strict:
        out = out.withColumn("value", F.when(F.col("__start").isNull(), F.raise_error(F.lit("no entry in force"))).otherwise(F.col("value")))
    return out.drop("__start")


def within(entries: DataFrame, low: int, high: int) -> DataFrame:
    """(start_height, value) of entries that start in [low, high], and of the one before the first entry at or above low, where there is such an entry."""
    after = F.lead("start_height").over(Window.orderBy("start_height"))
    rows = entries.withColumn("after", after)
    return rows.where(F.col("start_height").between(low, high) | (F.col("start_height") < low) & (F.col("after") >= low)).select("start_height", "value")
