"""Entities over the commit store: an append-only log of operations, typed by the project's schema.

A ``Block`` buffers its writes and commits them with its header and checkpoint; ``set`` and the other single calls are a commit each.
Reads see the last write of every id; the log keeps history, so any height can be read and rewound. Missing fields of a Set are null: a Set replaces the whole entity.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import StoreError
from ..functions import hexcols
from ..functions.naming import underscore
from ..operators import changelog, entities, lineage, metadata
from ..sources.sdl import Entity, Field
from ..types import FINAL, OPERATION, UNFINALIZED
from .commit import Store

LOG, HEADERS = "operations", "headers"
_HEADER = "height long, hash string, parent_hash string, finality string, seq long"


def typed(text: Column, field: Field) -> Column:
    """A field's JSON text as its column type; text that does not fit raises."""
    kind = field.spark_type()
    if field.is_list:
        return F.from_json(text, kind if field.base not in ("Bytes", "Json", "Date") else "array<string>")
    if field.base == "BigInt":
        return F.when(text.isNull() | text.rlike(r"^-?[0-9]+$"), text).otherwise(F.raise_error(F.concat(F.lit(f"{field.name}: not an integer: "), text)).cast("string"))
    if field.base == "Bytes":
        return hexcols.to_binary(text)
    if field.base == "Json":
        return F.parse_json(text)
    if field.base == "Date":
        return F.to_timestamp_ntz(F.regexp_replace(text, "Z$", ""))
    return text.cast(kind)


class EntityStore:
    def __init__(self, store: Store, schema: Iterable[Entity]):
        self.store, self.entities = store, {e.name: e for e in schema}
        for e in self.entities.values():
            e.struct()  # unsupported types fail here, before anything is written

    def _entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise StoreError(f"unknown entity {name}")
        return self.entities[name]

    def initialize(self) -> None:
        """The empty log, once."""
        if self.store.table(LOG) is None:
            self.store.commit({LOG: ("append", self.store.spark.createDataFrame([], OPERATION))})

    def log(self) -> DataFrame:
        rows = self.store.table(LOG)
        return self.store.spark.createDataFrame([], OPERATION) if rows is None else rows

    # --- writes

    def append(self, ops: DataFrame, batch: int | None = None, checkpoint: dict | None = None) -> bool:
        """Operations as a DataFrame, in one commit; unknown entities are refused."""
        bad = changelog.unknown_entities(ops, sorted(self.entities)).select("entity").first()
        if bad is not None:
            raise StoreError(f"unknown entity {bad['entity']}")
        columns = [c.split()[0] for c in OPERATION.split(", ")]
        return self.store.commit({LOG: ("append", ops.select(*columns))}, checkpoint, batch)

    def _write(self, rows: list[tuple]) -> None:
        self.append(self.store.spark.createDataFrame(rows, OPERATION))

    def set(self, entity: str, data: dict, height: int) -> None:
        self.bulk_create(entity, [data], height)

    def bulk_create(self, entity: str, items: list[dict], height: int) -> None:
        block = self.block(height)
        for d in items:
            block.set(entity, d)
        self._write(block.rows)

    def block(self, height: int) -> Block:
        """A buffer of one block's writes."""
        return Block(self, height)

    def checked(self, entity: str, data: dict) -> dict:
        known = {f.name for f in self._entity(entity).fields}
        if not isinstance(data.get("id"), str) or set(data) - known:
            raise StoreError(f"{entity}: no id, or unknown fields {sorted(set(data) - known)}")
        return data

    def remove(self, entity: str, entity_id: str, height: int) -> None:
        self.bulk_remove(entity, [entity_id], height)

    def bulk_remove(self, entity: str, ids: list[str], height: int) -> None:
        self._entity(entity)
        self._write([(height, 0, i, changelog.REMOVE, entity, x, None) for i, x in enumerate(ids)])

    # --- reads

    def _typed(self, rows: DataFrame, entity: Entity) -> DataFrame:
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in entity.fields])
        rows = rows.withColumn("__d", F.from_json("data", text))
        return rows.select(*[typed(F.col(f"__d.`{f.name}`"), f).alias(f.column) for f in entity.fields])

    def frame(self, entity: str, height: int | None = None, ids: list[str] | None = None) -> DataFrame:
        """Current entities, or those as of a height; of all ids, or of some: then only these are read from the log."""
        spec = self._entity(entity)
        ops = self.log().where(F.col("entity") == entity)
        if ids is not None:
            ops = ops.where(F.col("id").isin(ids))
        rows = changelog.compact(ops) if height is None else changelog.as_of(changelog.versions(ops), height)
        return self._typed(rows, spec)

    def versions(self, entity: str) -> DataFrame:
        self._entity(entity)
        return changelog.versions(self.log().where(F.col("entity") == entity))

    def get(self, entity: str, entity_id: str) -> dict | None:
        row = entities.get(self.frame(entity, ids=[entity_id]), entity_id).first()
        return None if row is None else row.asDict()

    def get_by_fields(self, entity: str, *conditions: tuple[str, str, object], order_by: str = "id", descending: bool = False, limit: int = entities.LIMIT, offset: int = 0) -> DataFrame:
        rows = entities.by_fields(self.frame(entity), *[(underscore(f), op, v) for f, op, v in conditions])
        return entities.page(rows, underscore(order_by), descending, limit, offset)

    def get_one_by_field(self, entity: str, field: str, value: object) -> dict | None:
        row = entities.get_one(self.frame(entity), underscore(field), value).first()
        return None if row is None else row.asDict()

    def dump(self, entity: str) -> DataFrame:
        return entities.canonical(self.frame(entity))

    # --- upkeep

    def rewind(self, height: int) -> None:
        """Operations above the height go; with them the versions that they began, and the ends they gave to others."""
        self.store.update(LOG, lambda log: log.where(F.col("height") <= height))

    def compact_log(self, below: int) -> None:
        """Up to a final height only the last operation of each id is kept: heights below can't be read any more."""

        def keep(log: DataFrame) -> DataFrame:
            old = changelog.compact(log.where(F.col("height") <= below)).select(*log.columns)
            return old.unionByName(log.where(F.col("height") > below))

        self.store.update(LOG, keep)

    def introspect(self) -> dict[str, list[tuple[str, str]]]:
        """Tables and their columns with types, both sorted."""
        return {e.table: sorted((f.name, f.dataType.simpleString()) for f in e.struct()) for e in sorted(self.entities.values(), key=lambda e: e.table)}


class Block:
    """The writes of one block, in order; ``commit`` puts them, its header and the checkpoint in force at once."""

    def __init__(self, entities: EntityStore, height: int):
        self.entities, self.height, self.rows = entities, height, []

    def set(self, entity: str, data: dict) -> None:
        data = self.entities.checked(entity, data)
        self.rows.append((self.height, 0, len(self.rows), changelog.SET, entity, data["id"], json.dumps(data, sort_keys=True, separators=(",", ":"))))

    def remove(self, entity: str, entity_id: str) -> None:
        self.entities._entity(entity)
        self.rows.append((self.height, 0, len(self.rows), changelog.REMOVE, entity, entity_id, None))

    def commit(self, header: lineage.Header, finalized: int, finality: str = UNFINALIZED, batch: int | None = None) -> bool:
        """False if the batch is there already."""
        if header.height != self.height:
            raise StoreError(f"header {header.height} is not of block {self.height}")
        store = self.entities.store
        rows, checkpoint = CheckpointStore(store).change(header, finalized, finality)
        changes = {HEADERS: ("append", rows)}
        if self.rows:
            changes[LOG] = ("append", store.spark.createDataFrame(self.rows, OPERATION))
        return store.commit(changes, checkpoint, batch)


class CheckpointStore:
    """Headers with their finality, and the pointer to the last indexed block. Headers are appended; the last one of a height counts."""

    def __init__(self, store: Store):
        self.store = store

    def _all(self) -> DataFrame:
        rows = self.store.table(HEADERS)
        return self.store.spark.createDataFrame([], _HEADER) if rows is None else rows

    @staticmethod
    def _current(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != "height"]
        return rows.groupBy("height").agg(F.max_by(F.struct(*rest), "seq").alias("h")).select("height", "h.*")

    def headers(self) -> DataFrame:
        return self._current(self._all()).drop("seq")

    def load(self) -> dict | None:
        return self.store.manifest()["checkpoint"]

    def change(self, header: lineage.Header, finalized: int, finality: str = UNFINALIZED) -> tuple[DataFrame, dict]:
        """The row that replaces the header at its height, and the new checkpoint; the finalized height never falls."""
        now = self.store.manifest()
        row = self.store.spark.createDataFrame([(header.height, header.hash, header.parent_hash, finality, now["version"] + 1)], _HEADER)
        return row, {"height": header.height, "hash": header.hash, "finalized": max(finalized, (now["checkpoint"] or {}).get("finalized", 0))}

    def commit(self, header: lineage.Header, finalized: int, finality: str = UNFINALIZED) -> None:
        row, checkpoint = self.change(header, finalized, finality)
        self.store.commit({HEADERS: ("append", row)}, checkpoint)

    def header_at(self, height: int) -> lineage.Header | None:
        row = self._current(self._all().where(F.col("height") == height)).first()
        return None if row is None else lineage.Header(row["height"], row["hash"], row["parent_hash"])

    def descending(self, low: int, high: int) -> DataFrame:
        """Text that is no known finality reads as unfinalized."""
        known = F.when(F.col("finality") == FINAL, FINAL).otherwise(UNFINALIZED)
        return lineage.descending(self.headers().withColumn("finality", known), low, high)

    def truncate_above(self, height: int) -> None:
        self.store.update(HEADERS, lambda h: self._current(lineage.truncated_above(h, height)))

    def prune_below(self, height: int) -> None:
        self.store.update(HEADERS, lambda h: lineage.pruned_below(self._current(h), height))


class Metadata:
    """Typed access to the stored facts."""

    def __init__(self, store: Store):
        self.store = store

    def get(self, key: str) -> str | None:
        return self.store.manifest()["facts"].get(key)

    def number(self, key: str) -> int | None:
        raw = self.get(key)
        if raw is not None and not raw.isdecimal():
            raise StoreError(f"{key}: not a number: {raw!r}")
        return None if raw is None else int(raw)

    def verify(self, expected: dict[str, str]) -> DataFrame:
        rows = lambda d: self.store.spark.createDataFrame(sorted(d.items()), "key string, value string")
        return metadata.verify(rows(expected), rows(self.store.manifest()["facts"]))
