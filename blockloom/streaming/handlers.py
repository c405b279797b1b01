"""Mapping handlers: Python callables that turn inputs into Set and Remove operations and new data sources.

Tier 1 (``run_pure``): no reads of entities; fully parallel by ``mapInPandas``, operations carry the
order (height, tx_index, log_index, handler_seq, op_seq). Tier 2 (``run_folds``): a fold over the inputs of one
entity id in that order, streamed, so that a busy id takes one task's time but not its memory. Tier 3 (``iter_ordered``): any reads, in chain order
on the driver, for small backfills; operations leave one by one.

An input's record is what handlers of every kind get: ``block`` (height, hash, parentHash, timestamp as RFC 3339), ``kind``, ``dataSource`` (name,
parameters), ``payload``, and ``height`` once more. Columns that the inputs lack are null in it. Data sources that a handler creates are rows of
their own (op Source) among the operations; ``operations_of`` and ``sources_of`` tell them apart.

There is no sandbox around Python. ``Limits`` gives a handler call a time (by a timer signal, so in a process's main thread) and a
worker's address space a ceiling; beyond either the batch fails.
"""

from __future__ import annotations

import json
import logging
import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import HandlerError
from ..shipping import ship

# The handler contract.
ABI_VERSION = 1
OK, NOT_FOUND, INVALID_ARGUMENT, UNKNOWN_ENTITY, STORE_ERROR, CAPABILITY_DENIED, RESOURCE_EXHAUSTED = 0, 1, -1, -2, -3, -4, -5
LEVELS = ("trace", "debug", "info", "warn", "error")
OPERATIONS = "height long, tx_index long, log_index long, handler_seq long, op_seq long, op string, entity string, id string, data string"
ORDER = ("height", "tx_index", "log_index")
SOURCE = "Source"
#: what a record may tell besides the payload; each is a column of the inputs or null
MORE = {"hash": "string", "parent_hash": "string", "timestamp": "timestamp", "kind": "string", "source": "string", "parameters": "string"}

_log = logging.getLogger("blockloom.handlers")


@dataclass(frozen=True)
class Limits:
    """Milliseconds of a handler call, and MiB that a worker may grow by while handlers run."""

    timeout_ms: int = 5_000
    memory_mb: int = 256

    @contextmanager
    def time(self, what: str):
        if threading.current_thread() is not threading.main_thread():
            yield  # signals reach the main thread alone
            return

        def late(*_):
            raise HandlerError(f"{what}: status {RESOURCE_EXHAUSTED}, over {self.timeout_ms} ms")

        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, self.timeout_ms / 1000)
        try:
            yield
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    @contextmanager
    def memory(self):
        import resource

        with open("/proc/self/statm") as f:
            now = int(f.read().split()[0]) * resource.getpagesize()
        soft, hard = resource.getrlimit(resource.RLIMIT_AS)
        ceiling = now + (self.memory_mb << 20)
        resource.setrlimit(resource.RLIMIT_AS, (ceiling if hard == resource.RLIM_INFINITY else min(ceiling, hard), hard))
        try:
            yield
        except MemoryError:
            raise HandlerError(f"status {RESOURCE_EXHAUSTED}, over {self.memory_mb} MiB") from None
        finally:
            resource.setrlimit(resource.RLIMIT_AS, (soft, hard))


def rfc3339(c: Column) -> Column:
    """A timestamp as RFC 3339 text in UTC."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def set_status(entity: Column, entity_id: Column, data: Column, known: list[str]) -> Column:
    """Status of a Set: the entity must be known, the data an object, and its id the operation's."""
    parsed = F.from_json(data, "id string", {"mode": "PERMISSIVE"})
    is_object = F.coalesce(data.rlike(r"^\s*\{"), F.lit(False))
    fits = is_object & F.coalesce(parsed["id"] == entity_id, F.lit(False))
    return F.when(~F.coalesce(entity.isin(known), F.lit(False)), UNKNOWN_ENTITY).when(~fits, INVALID_ARGUMENT).otherwise(OK)


def level_name(level: Column) -> Column:
    names = F.array(*[F.lit(x) for x in LEVELS])
    return F.when((level >= 0) & (level < len(LEVELS)), F.element_at(names, level.cast("int") + 1)).otherwise("info")


@dataclass
class Context:
    """What a handler may do: buffered writes and, in tier 3, reads of what was written before."""

    known: frozenset[str]
    reader: Callable[[str, str], dict | None] | None = None
    operations: list[tuple[str, str, str, str | None]] = field(default_factory=list)
    sources: list[dict] = field(default_factory=list)
    height: int | None = None
    #: (height, to, data) -> answer; the height is the block's own, whatever the handler asks
    chain: Callable[[int, str, str], str] | None = None

    def set(self, entity: str, entity_id: str, data: object) -> int:
        if entity not in self.known:
            return UNKNOWN_ENTITY
        if not isinstance(data, dict) or data.get("id") != entity_id:
            return INVALID_ARGUMENT
        self.operations.append(("Set", entity, entity_id, json.dumps(data, sort_keys=True, separators=(",", ":"))))
        return OK

    def remove(self, entity: str, entity_id: str) -> int:
        if entity not in self.known:
            return UNKNOWN_ENTITY
        self.operations.append(("Remove", entity, entity_id, None))
        return OK

    def get(self, entity: str, entity_id: str) -> tuple[int, dict | None]:
        if entity not in self.known:
            return UNKNOWN_ENTITY, None
        if self.reader is None:
            return CAPABILITY_DENIED, None
        for op, e, i, data in reversed(self.operations):
            if (e, i) == (entity, entity_id):
                return (OK, json.loads(data)) if op == "Set" else (NOT_FOUND, None)
        found = self.reader(entity, entity_id)
        return (NOT_FOUND, None) if found is None else (OK, found)

    def add_source(self, template: str, parameters: dict) -> None:
        """A data source from one of the manifest's templates, active from this block on."""
        self.sources.append({"template": template, "parameters": parameters})

    def log(self, level: str | int, message: str) -> None:
        """A line of the worker's log, with the block's height; an unknown level is info."""
        name = LEVELS[level] if isinstance(level, int) and 0 <= level < len(LEVELS) else level if level in LEVELS else "info"
        _log.log({"trace": 5}.get(name) or getattr(logging, {"warn": "WARNING"}.get(name, name.upper())), "height %s: %s", self.height, message)

    def call(self, to: str, data: str = "0x") -> tuple[int, str | None]:
        """A contract's answer as of the block that is indexed: a read that can be replayed."""
        if self.chain is None or self.height is None:
            return CAPABILITY_DENIED, None
        return OK, self.chain(self.height, to, data)

    def rows(self) -> list[tuple[str, str, str | None, str | None]]:
        """Operations, then new data sources."""
        return [*self.operations, *[(SOURCE, s["template"], None, json.dumps(s["parameters"], sort_keys=True, separators=(",", ":"))) for s in self.sources]]


@dataclass(frozen=True)
class Registered:
    name: str
    call: Callable[[Context, dict], object]
    version: int = ABI_VERSION
    reads: bool = False


class Registry:
    """Handlers by name, checked when they are added."""

    def __init__(self, entities: list[str]):
        self.entities, self.handlers = frozenset(entities), {}

    def add(self, handler: Registered) -> None:
        if handler.version != ABI_VERSION:
            raise HandlerError(f"{handler.name}: version {handler.version}, this engine has {ABI_VERSION}")
        if not callable(handler.call) or handler.name in self.handlers:
            raise HandlerError(f"{handler.name}: not callable, or there already")
        self.handlers[handler.name] = handler

    def get(self, name: str) -> Registered:
        if name not in self.handlers:
            raise HandlerError(f"no handler {name}")
        return self.handlers[name]


def _run_one(handler: Registered, ctx: Context, record: dict, limits: Limits) -> None:
    """A handler that raises, takes too long or returns an error status fails the batch: nothing is skipped."""
    with limits.time(f"{handler.name} at {record['height']}"):
        status = handler.call(ctx, record)
    if isinstance(status, int) and not isinstance(status, bool) and status < 0:
        raise HandlerError(f"{handler.name}: status {status} at {record.get('height')}")


def _prepared(inputs: DataFrame) -> DataFrame:
    """The columns of a record, those that are missing as nulls."""
    more = [F.col(c) if c in inputs.columns else F.lit(None).cast(t).alias(c) for c, t in MORE.items()]
    rows = inputs.select(*ORDER, "payload", *more)
    return rows.withColumn("timestamp", rfc3339(F.col("timestamp").cast("timestamp")))


def _record(height, payload, hash_, parent_hash, timestamp, kind, source, parameters) -> dict:
    block = {"height": height, "hash": hash_, "parentHash": parent_hash, "timestamp": timestamp}
    return {"height": height, "block": block, "kind": kind, "dataSource": {"name": source, "parameters": json.loads(parameters) if parameters else {}}, "payload": json.loads(payload)}


def _caller(chain: dict | None) -> Callable[[int, str, str], str] | None:
    if chain is None:
        return None
    from ..sources.rpc import Client

    return Client(**chain).call_at


def operations_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("op") != SOURCE)


def sources_of(rows: DataFrame) -> DataFrame:
    """height, template, parameters (JSON) of every data source that handlers created, in order with the other columns."""
    return rows.where(F.col("op") == SOURCE).select("height", "tx_index", "log_index", "handler_seq", "op_seq", F.col("entity").alias("template"), F.col("data").alias("parameters"))


def run_pure(inputs: DataFrame, registry: Registry, name: str, seq: int = 0, limits: Limits | None = None, chain: dict | None = None) -> DataFrame:
    """inputs: height, tx_index, log_index, payload (JSON) and any of MORE. chain: arguments of a node client, for handlers that call contracts."""
    handler, entities, limits = registry.get(name), registry.entities, limits or Limits()
    if handler.reads:
        raise HandlerError(f"{name} reads entities and can't run in parallel")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = _caller(chain)
        for frame in frames:
            out = []
            with limits.memory():
                for height, tx, log, payload, *more in frame[[*ORDER, "payload", *MORE]].astype(object).where(frame.notna(), None).itertuples(index=False):
                    ctx = Context(entities, height=height, chain=caller)
                    _run_one(handler, ctx, _record(height, payload, *more), limits)
                    out += [(height, tx, log, seq, i, *op) for i, op in enumerate(ctx.rows())]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OPERATIONS.split(", ")])

    ship(inputs.sparkSession)
    return _prepared(inputs).mapInPandas(run, OPERATIONS)


def run_folds(inputs: DataFrame, key: str, start: Callable[[], dict], step: Callable[[dict, dict], dict], entity: str) -> DataFrame:
    """One Set per key and input, each the state after it. inputs: key, height, tx_index, log_index, payload. Prefer an aggregate where one can say it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for frame in frames:
            out = []
            for k, height, tx, log, payload in frame[["key", *ORDER, "payload"]].itertuples(index=False):
                if state is None or k != last:
                    last, state = k, start()
                state = step(state, json.loads(payload))
                out.append((height, tx, log, 0, 0, "Set", entity, k, json.dumps(state, sort_keys=True, separators=(",", ":"))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OPERATIONS.split(", ")])

    ship(inputs.sparkSession)
    rows = inputs.select(F.coalesce(F.col(key).cast("string"), F.lit("None")).alias("key"), *ORDER, "payload")
    return rows.repartition("key").sortWithinPartitions("key", *ORDER).mapInPandas(run, OPERATIONS)


def iter_ordered(inputs: DataFrame, registry: Registry, name: str, reader: Callable[[str, str], dict | None], seq: int = 0, limits: Limits | None = None, chain: dict | None = None) -> Iterator[tuple]:
    """In chain order on the driver, one row at a time from the executors. reader: an entity as left by all operations that were handed over before; it sees each as soon as it is."""
    handler, limits, caller = registry.get(name), limits or Limits(), _caller(chain)
    for row in _prepared(inputs).orderBy(*ORDER).toLocalIterator():
        ctx = Context(registry.entities, reader, height=row["height"], chain=caller)
        _run_one(handler, ctx, _record(row["height"], row["payload"], *[row[c] for c in MORE]), limits)
        for i, op in enumerate(ctx.rows()):
            yield (row["height"], row["tx_index"], row["log_index"], seq, i, *op)


def run_ordered(inputs: DataFrame, registry: Registry, name: str, state: dict[tuple[str, str], dict] | None = None, seq: int = 0, limits: Limits | None = None, chain: dict | None = None) -> list[tuple]:
    """As iter_ordered, over entities held in a dictionary, with all operations in a list: for inputs that the driver can hold."""
    state, out = {} if state is None else state, []
    for row in iter_ordered(inputs, registry, name, lambda e, i: state.get((e, i)), seq, limits, chain):
        out.append(row)
        *_, op, entity, entity_id, data = row
        if op == "Set":
            state[entity, entity_id] = json.loads(data)
        elif op != SOURCE:
            state.pop((entity, entity_id), None)
    return out
