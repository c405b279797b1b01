"""Header chains: parent links, forks and what to rewind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import LineageError

WINDOW = 200


def is_child(height: Column, parent_hash: Column, before_height: Column, before_hash: Column) -> Column:
    """One higher and naming its hash; a null parent is no child."""
    return F.coalesce((height == before_height + 1) & (parent_hash == before_hash), F.lit(False))


def parent_links(headers: DataFrame) -> DataFrame:
    """(height, linked) of every header but those without a predecessor row: an equi-join on height, which scales where a global window does not."""
    before = headers.select((F.col("height") + 1).alias("height"), F.col("hash").alias("before_hash"))
    return headers.join(before, "height").select("height", F.coalesce(F.col("parent_hash") == F.col("before_hash"), F.lit(False)).alias("linked"))


def continues(headers: DataFrame, last_height: int, last_hash: str) -> DataFrame:
    """(height, continues): does the header follow on the last one?"""
    ok = is_child(F.col("height"), F.col("parent_hash"), F.lit(last_height), F.lit(last_hash))
    return headers.select("height", ok.alias("continues"))


def compare(stored: DataFrame, canonical: DataFrame, tip: int, window: int = WINDOW) -> DataFrame:
    """(height, matches) within the window below the tip; a height that the canonical chain lacks has diverged."""
    recent = F.col("height").between(tip - window, tip)
    own = stored.where(recent).select("height", F.col("hash").alias("stored_hash"))
    other = canonical.where(recent).select("height", F.col("hash").alias("canonical_hash"))
    return own.join(other, "height", "left").select("height", "stored_hash", "canonical_hash", F.coalesce(F.col("stored_hash") == F.col("canonical_hash"), F.lit(False)).alias("matches"))


def common_ancestor(compared: DataFrame) -> DataFrame:
    """One row (decision, ancestor, depth): canonical if the tip matches or there is nothing, rewind to the highest match, or beyond history with the oldest height."""
    top = compared.agg(
        F.max("height").alias("tip"),
        F.min("height").alias("oldest"),
        F.max(F.when(F.col("matches"), F.col("height"))).alias("ancestor"),
        F.count("*").alias("n"),
    )
    decision = F.when((F.col("n") == 0) | (F.col("ancestor") == F.col("tip")), "canonical").when(F.col("ancestor").isNotNull(), "rewind").otherwise("beyond_history")
    # rows are contiguous (asserted by the caller), so the rows above the ancestor are tip - ancestor
    return top.select(
        decision.alias("decision"),
        F.when(decision == "rewind", F.col("ancestor")).when(decision == "beyond_history", F.col("oldest")).alias("ancestor"),
        F.when(decision == "rewind", F.col("tip") - F.col("ancestor")).otherwise(F.lit(0)).cast("long").alias("depth"),
    )


def contiguous(rows: DataFrame, group: str, index: str) -> DataFrame:
    """(group, ok): is the index exactly 0..n-1, each once?"""
    own = rows.groupBy(group).agg(F.min(index).alias("a"), F.max(index).alias("b"), F.count("*").alias("n"), F.count_distinct(index).alias("d"))
    return own.select(group, ((F.col("a") == 0) & (F.col("b") == F.col("n") - 1) & (F.col("d") == F.col("n"))).alias("ok"))


@dataclass(frozen=True)
class Header:
    height: int
    hash: str
    parent_hash: str | None = None
    timestamp: object = None


def check_append(last: Header | None, new: Header) -> bool:
    """May ``new`` follow in the journal? False if it is the last one again; raises if it does not fit."""
    if not new.hash:
        raise LineageError("empty hash")
    if new.height < 0:
        raise LineageError("negative height")
    if last is None:
        return True
    if (new.height, new.hash, new.parent_hash) == (last.height, last.hash, last.parent_hash):
        return False
    if new.height != last.height + 1 or new.parent_hash is None or new.parent_hash != last.hash:
        raise LineageError(f"block {new.height} does not follow on {last.height}")
    return True


def append_check(journal_last: DataFrame, batch: DataFrame) -> DataFrame:
    """(height, status) of a batch of headers against the journal's last (one row or none): repeat, append or refused, each seen with its predecessor in the batch or the journal."""
    last = journal_last.select(F.col("height").alias("l_height"), F.col("hash").alias("l_hash"))
    before = batch.select((F.col("height") + 1).alias("height"), F.col("hash").alias("b_hash"))
    rows = batch.join(before, "height", "left").join(F.broadcast(last.limit(1)), F.lit(True), "left")
    follows = F.coalesce(F.when(F.col("height") == F.col("l_height") + 1, F.col("parent_hash") == F.col("l_hash")).otherwise(F.col("parent_hash") == F.col("b_hash")), F.lit(False))
    status = (
        F.when(F.col("hash") == "", "refused")
        .when((F.col("height") == F.col("l_height")) & (F.col("hash") == F.col("l_hash")), "repeat")
        .when(F.col("l_height").isNull() & F.col("b_hash").isNull(), "append")
        .when((F.col("height") > F.col("l_height")) & follows | F.col("l_height").isNull() & follows, "append")
        .otherwise("refused")
    )
    return rows.select("height", status.alias("status"))


def latest(journal: DataFrame) -> DataFrame:
    """The highest header: one row, by a combining aggregate."""
    return journal.agg(F.max_by(F.struct("height", "hash", "parent_hash"), "height").alias("j")).where("j is not null").select("j.*")


def descending(headers: DataFrame, low: int, high: int) -> DataFrame:
    return headers.where(F.col("height").between(low, high)).orderBy(F.col("height").desc())


def truncated_above(headers: DataFrame, height: int) -> DataFrame:
    return headers.where(F.col("height") <= height)


def pruned_below(headers: DataFrame, height: int) -> DataFrame:
    """Only final headers go."""
    return headers.where(~((F.col("height") < height) & (F.col("finality") == "final")))
