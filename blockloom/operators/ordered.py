"""Running values, runs and release order over one long axis of heights, without a single-task window.

A height's bucket is height div BUCKET. Windows run inside buckets; what crosses them is a
window over one row per bucket, which is BUCKET times smaller than the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET = 4096


def running_max(rows: DataFrame, value: Column, order: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """rows with the largest value up to each place; order must be unique integers."""
    rows = rows.withColumn("__b", F.floor(F.col(order) / bucket)).withColumn("__v", value)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("__b").agg(F.max("__v").alias("__top")).select("__b", F.max("__top").over(before).alias("__before"))
    inside = Window.partitionBy("__b").orderBy(order)
    rows = rows.withColumn("__in", F.max("__v").over(inside)).join(tops, "__b")
    return rows.withColumn(name, F.greatest("__in", "__before")).drop("__b", "__v", "__in", "__before")


def islands(heights: DataFrame, column: str = "height", bucket: int = BUCKET) -> DataFrame:
    """(start, end, n) of maximal runs of consecutive values. Runs are found in buckets, then those that meet at a bucket's edge are joined."""
    own = heights.select(F.col(column).alias("h")).distinct().withColumn("b", F.floor(F.col("h") / bucket))
    place = F.row_number().over(Window.partitionBy("b").orderBy("h"))
    parts = own.withColumn("g", F.col("h") - place).groupBy("b", "g").agg(F.min("h").alias("start"), F.max("h").alias("end"))
    # only runs at an edge of a bucket can go on in the next: two for each bucket at most
    at_edge = (F.col("start") % bucket == 0) | ((F.col("end") + 1) % bucket == 0)
    w = Window.orderBy("start")
    edge = parts.where(at_edge).withColumn("new", F.coalesce((F.col("start") != F.lag("end").over(w) + 1).cast("int"), F.lit(1)))
    edge = edge.withColumn("run", F.sum("new").over(w)).groupBy("run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    out = parts.where(~at_edge).select("start", "end").unionByName(edge.select("start", "end"))
    return out.select("start", "end", (F.col("end") - F.col("start") + 1).alias("n"))


def fenced(arrivals: DataFrame, generation: int) -> DataFrame:
    """Output of an older generation is dropped."""
    return arrivals.where(F.col("generation") == generation)


def release_order(arrivals: DataFrame, cursor: int, generation: int) -> DataFrame:
    """(height, released_at): the arrival with which each height is released.

    The buffer releases the longest run without a gap from the cursor, so a height goes out with the latest first
    arrival of all heights from the cursor to it; what lies behind a gap waits. Repeated and stale
    arrivals count once, with the first.
    """
    first = fenced(arrivals, generation).where(F.col("height") >= cursor).groupBy("height").agg(F.min("arrival_pos").alias("arrival_pos"))
    run = islands(first).where(F.col("start") == cursor).select(F.col("end").alias("last"))
    ready = first.join(F.broadcast(run), F.col("height") <= F.col("last")).select("height", "arrival_pos")  # one row at most
    return running_max(ready, F.col("arrival_pos"), "height", "released_at").select("height", "released_at")


def stall_gap(arrivals: DataFrame, cursor: int, generation: int) -> DataFrame:
    """One row (expected, lowest): the next height that is missing, and the lowest one that waits behind it; none without a gap."""
    own = fenced(arrivals, generation).where(F.col("height") >= cursor)
    lows = own.agg(F.min("height").alias("lowest")).select(F.lit(cursor).cast("long").alias("expected"), "lowest")
    return lows.where(F.col("lowest") > F.col("expected"))
