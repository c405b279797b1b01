"""Selection of logs, transactions and blocks: small filter objects that compile to one Column each.

Literals are normalised on the driver, so a compiled predicate is built-in expressions only
and reaches the scan where the columns are stored normalised (``normalized=True``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import hexcols

MOST_TOPICS = 4
LOG, TRANSACTION, BLOCK = "log", "transaction", "block"


def _all(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def _equal(c: Column, literal: str, normalized: bool) -> Column:
    return c == F.lit("0x" + hexcols.bare(literal)) if normalized else hexcols.equals(c, literal)


@dataclass(frozen=True)
class LogFilter:
    """address: absent fits any. topics: by position a value, a list (any of them) or None (anything, a missing topic too)."""

    address: str | None = None
    topics: tuple[str | tuple[str, ...] | None, ...] = ()

    def column(self, address: Column | None = None, topics: Column | None = None, normalized: bool = False) -> Column:
        address = F.col("address") if address is None else address
        topics = F.col("topics") if topics is None else topics
        terms = [] if self.address is None else [_equal(address, self.address, normalized)]
        for i, want in enumerate(self.topics):
            if want is None:
                continue
            at = F.try_element_at(topics, F.lit(i + 1))
            terms.append(_equal(at, want, normalized) if isinstance(want, str) else hexcols.among(at, list(want)))
        return F.coalesce(_all(terms), F.lit(False))

    def pinned_topic0(self) -> str | None:
        """The one value that the first topic must have, as a hint for sources; none for lists and wildcards."""
        return self.topics[0] if self.topics and isinstance(self.topics[0], str) else None

    @classmethod
    def from_params(cls, params: dict) -> LogFilter:
        address, topics = params.get("address"), params.get("topics") or []
        if address is not None and not isinstance(address, str) or not isinstance(topics, list):
            raise ValueError("malformed log filter")
        for t in topics:
            if not (t is None or isinstance(t, str) or isinstance(t, list) and all(isinstance(x, str) for x in t)):
                raise ValueError("malformed topic")
        return cls(address, tuple(tuple(t) if isinstance(t, list) else t for t in topics))


@dataclass(frozen=True)
class TransactionFilter:
    """A null recipient (contract creation) never fits a ``to``."""

    to: str | None = None
    sender: str | None = None
    function: str | None = None

    def column(self, to: Column | None = None, sender: Column | None = None, data: Column | None = None, normalized: bool = False) -> Column:
        to = F.col("to") if to is None else to
        sender = F.col("from") if sender is None else sender
        data = F.col("input") if data is None else data
        terms = []
        if self.to is not None:
            terms.append(_equal(to, self.to, normalized))
        if self.sender is not None:
            terms.append(_equal(sender, self.sender, normalized))
        if self.function is not None:
            terms.append(hexcols.begins(data, self.function))
        return F.coalesce(_all(terms), F.lit(False))

    @classmethod
    def from_params(cls, params: dict) -> TransactionFilter:
        got = [params.get(k) for k in ("to", "from", "function")]
        if any(x is not None and not isinstance(x, str) for x in got):
            raise ValueError("malformed transaction filter")
        return cls(*got)


@dataclass(frozen=True)
class BlockFilter:
    """Every ``modulo``-th height; none or 0 takes all. Time schedules are refused by the compiler."""

    modulo: int | None = None

    def column(self, height: Column | None = None) -> Column:
        height = F.col("height") if height is None else height
        return height % F.lit(self.modulo) == 0 if self.modulo else F.lit(True)


@dataclass(frozen=True)
class Handler:
    """A mapping handler with the heights over which it is active."""

    name: str
    kind: str
    filter: LogFilter | TransactionFilter | BlockFilter = field(default_factory=LogFilter)
    start: int = 0
    end: int | None = None

    def active(self, height: Column) -> Column:
        inside = height >= self.start
        return inside if self.end is None else inside & (height <= self.end)


def event_matches(kind: str, params: str | None, has_transaction: Column | None = None) -> Column:
    """Does a decoded event fit a generic handler filter? Compiled once; malformed parameters fit nothing, block handlers never fit an event, a transaction handler needs the event's transaction."""
    try:
        spec = json.loads(params) if params else {}
        if not isinstance(spec, dict):
            raise ValueError("parameters are no object")
        if kind == LOG:
            return LogFilter.from_params(spec).column()
        if kind == TRANSACTION:
            there = F.col("tx_hash").isNotNull() if has_transaction is None else has_transaction
            return there & TransactionFilter.from_params(spec).column()
    except ValueError:
        pass
    return F.lit(False)


def active_sources(sources: DataFrame, height: Column | int) -> DataFrame:
    """Data sources whose window holds the height."""
    height = F.lit(height) if isinstance(height, int) else height
    return sources.where((F.col("start") <= height) & (F.col("end").isNull() | (F.col("end") >= height)))


def for_kind(handlers: DataFrame, kind: str) -> DataFrame:
    return handlers.where(F.col("kind") == kind)


def without_spans(heights: DataFrame, spans: list[tuple[int, int]], column: str = "height") -> DataFrame:
    """Heights outside inclusive spans. Spans come from the project's configuration: one predicate, no join."""
    inside = [F.col(column).between(a, b) for a, b in spans]
    return heights.where(~reduce(lambda a, b: a | b, inside)) if inside else heights


def match_counts(handlers: list[Handler], headers: DataFrame, logs: DataFrame | None = None, transactions: DataFrame | None = None) -> DataFrame:
    """(height, handler, n) for every block and handler, zeros too.

    All log handlers are counted in one pass and one aggregation by height, so are all transaction
    handlers; the handlers become rows at the end.
    """
    out = headers.select("height")
    for kind, rows in ((LOG, logs), (TRANSACTION, transactions)):
        own = [(i, h) for i, h in enumerate(handlers) if h.kind == kind]
        if own and rows is not None:
            counts = rows.groupBy("height").agg(*[F.count_if(h.active(F.col("height")) & h.filter.column()).alias(f"n{i}") for i, h in own])
            out = out.join(counts, "height", "left")
    names = []
    for i, h in enumerate(handlers):
        if h.kind == BLOCK:
            n = (h.active(F.col("height")) & h.filter.column()).cast("long")
        else:
            n = F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("long") if f"n{i}" in out.columns else F.lit(0).cast("long")
        names.append(F.struct(F.lit(h.name).alias("handler"), n.alias("n")))
    if not names:
        return out.select("height", F.lit("").alias("handler"), F.lit(0).cast("long").alias("n")).limit(0)
    return out.select("height", F.inline(F.array(*names)))


def block_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("height").agg(F.sum("n").alias("n"))


def candidate_heights(index: DataFrame, low: int, high: int, head: int, topic0: list[str] | None = None, addresses: list[str] | None = None) -> DataFrame:
    """Heights in [low, min(high, head)] that may hold a match, from an index (topic0, address, height); never fewer than there are."""
    rows = index.where(F.col("height").between(low, min(high, head)))
    if topic0:
        rows = rows.where(hexcols.among(F.col("topic0"), topic0))
    if addresses:
        rows = rows.where(hexcols.among(F.col("address"), addresses))
    return rows.select("height").distinct()
