"""Ingestion as a streaming query: headers are journalled, selected inputs counted, batch by batch.

Every batch must follow on the journal; a batch that is delivered again is a no-op. Resuming checks that the
journal's last header is still canonical: in finalized mode a fork is an error, in unfinalized mode the versions
above the common ancestor are rewound and the generation rises. The last header stands in the manifest, so neither a batch nor a
restart reads the journal for it.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import LineageError
from ..operators import changelog, filters, lineage
from ..sources.project import IngestConfig, Project
from .commit import Store
from .metrics import Gauges

JOURNAL, COUNTS, VERSIONS = "journal", "matches", "versions"
_HEADER = ("height", "hash", "parent_hash", "timestamp")


def identity(project: Project, schema_version: str = "1") -> dict[str, str]:
    return {"project_id": str(project.manifest["name"]), "chain_id": project.chain_id, "manifest_hash": project.fingerprint, "schema_version": schema_version}


def last_header(store: Store) -> lineage.Header | None:
    """From the manifest's checkpoint."""
    tip = store.manifest()["checkpoint"]
    if not tip or store.table(JOURNAL) is None:
        return None
    if "parent_hash" not in tip:  # a checkpoint of another writer: one row of the journal
        row = store.table(JOURNAL).where(F.col("height") == tip["height"]).select("height", "hash", "parent_hash").first()
        return None if row is None else lineage.Header(*row)
    return lineage.Header(tip["height"], tip["hash"], tip["parent_hash"])


def resume(store: Store, canonical_hash, config: IngestConfig, start: int, gauges: Gauges | None = None) -> int:
    """The height to begin at. canonical_hash: height -> hash of the canonical chain, or None."""
    last = last_header(store)
    if last is None:
        return start
    if canonical_hash(last.height) != last.hash:
        if not config.unfinalized:
            raise LineageError(f"block {last.height} of the journal is not canonical any more")
        stored = store.table(JOURNAL).where(F.col("height") >= last.height - lineage.WINDOW)
        # the window has some hundred rows at most
        for row in stored.select("height", "hash").orderBy(F.col("height").desc()).limit(lineage.WINDOW + 1).toLocalIterator():
            if canonical_hash(row["height"]) == row["hash"]:
                rewind(store, row["height"], gauges)
                return row["height"] + 1
        raise LineageError("the fork is older than the window")
    if start > last.height + 1:
        raise LineageError(f"start {start} would skip heights after {last.height}")
    return max(last.height + 1, start)


def rewind(store: Store, height: int, gauges: Gauges | None = None) -> None:
    """Journal, counts and versions back to a height, in one commit, under a new generation."""
    last = last_header(store)
    changes = {JOURNAL: ("replace", lineage.truncated_above(store.table(JOURNAL), height))}
    for name, how in ((COUNTS, lambda t: t.where(F.col("height") <= height)), (VERSIONS, lambda t: changelog.rewound(t, height))):
        rows = store.table(name)
        if rows is not None:
            changes[name] = ("replace", how(rows))
    row = store.table(JOURNAL).where(F.col("height") == height).select("height", "hash", "parent_hash").first()
    finalized = (store.manifest()["checkpoint"] or {}).get("finalized", 0)
    store.commit(changes, row.asDict() | {"finalized": finalized} if row else {}, generation=store.manifest()["generation"] + 1)
    if gauges is not None:
        gauges.add("reorgs", 1)
        gauges.add("reorg_depth", last.height - height if last else 0)
        gauges.set("indexed_height", height)


def append_batch(store: Store, blocks: DataFrame, batch: int | None, handlers: list[filters.Handler], finalized: int | None = None, planned_gaps: bool = False, gauges: Gauges | None = None, stream: str = "") -> bool:
    """Journal a batch and count what its handlers select, in one commit."""
    if store.has_batch(store.manifest(), batch, stream):
        return False
    blocks, gauges = blocks.persist(), gauges or Gauges()
    try:
        last, headers = last_header(store), blocks.select(*_HEADER)
        journal = blocks.sparkSession.createDataFrame([] if last is None else [(last.height, last.hash)], "height long, hash string")
        status = lineage.append_check(journal, headers)
        if planned_gaps:  # heights behind a bypassed span have no predecessor
            known = headers.select((F.col("height") + 1).alias("height"))
            status = status.join(known, "height", "left_semi")
        wrong = status.where("status = 'refused'").orderBy("height").first()
        if wrong is not None:
            raise LineageError(f"block {wrong['height']} does not follow")
        new = headers if last is None else headers.where(F.col("height") > last.height)
        changes: dict = {JOURNAL: ("append", new)}
        if handlers:
            logs = blocks.select("height", F.inline("logs")) if "logs" in blocks.columns else None
            txs = blocks.select("height", F.inline("transactions")) if "transactions" in blocks.columns else None
            changes[COUNTS] = ("append", filters.match_counts(handlers, new, logs, txs))
        top = headers.agg(F.max_by(F.struct("height", "hash", "parent_hash"), "height").alias("j"), F.count("*").alias("n")).first()
        if top["j"] is None:
            return False
        gauges.set("queue_depth", top["n"])
        tip = top["j"].asDict()
        if last is not None and tip["height"] < last.height:  # a batch delivered again in part
            tip = {"height": last.height, "hash": last.hash, "parent_hash": last.parent_hash}
        before = (store.manifest()["checkpoint"] or {}).get("finalized", 0)
        tip["finalized"] = max(before, tip["height"] if finalized is None else finalized)
        began = time.monotonic()
        done = store.commit(changes, tip, batch, stream=stream)
        took = time.monotonic() - began
        gauges.set("commit_duration", took)
        gauges.set("blocks_per_second", top["n"] / max(took, 1e-9))
        gauges.set("indexed_height", tip["height"])
        gauges.set("finalized_height", tip["finalized"])
        gauges.set("queue_depth", 0)
        return done
    finally:
        blocks.unpersist()


def stream(spark: SparkSession, store: Store, source: DataFrame, handlers: list[filters.Handler], checkpoint: str, until: int | None = None, stop: threading.Event | None = None, gauges: Gauges | None = None, finalized: Callable[[], int] | None = None, planned_gaps: bool = False, **trigger):
    """Start the query.

    Without a trigger the run is bounded: batch follows batch until the source has nothing new (or height ``until`` is committed), then the query
    ends by itself. With one (as of DataStreamWriter.trigger) it goes on. ``stop`` ends either after the batch at hand. finalized: the chain's final height, asked for once a batch.
    """
    ended = threading.Event()

    def wanted() -> bool:
        tip = store.manifest()["checkpoint"] if until is not None else None
        return stop is not None and stop.is_set() or tip is not None and tip.get("height", -1) >= until

    def each(frame: DataFrame, batch: int) -> None:
        append_batch(store, frame, batch, handlers, finalized() if finalized else None, planned_gaps, gauges, checkpoint)
        if wanted():
            ended.set()

    query = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
    if not trigger or until is not None or stop is not None:
        threading.Thread(target=_watch, args=(query, ended, wanted, not trigger), daemon=True).start()
    return query


#: A batch at hand has so many seconds to end before the query is stopped all the same; commits are atomic, so that loses nothing but its work.
GRACE_SECONDS = 30


def _watch(query, ended: threading.Event, wanted: Callable[[], bool], bounded: bool) -> None:
    """Stops the query behind a batch: as soon as one has ended and more is not wanted, or nothing is left to do."""
    idle, since = 0, None
    while query.isActive:
        # the source was asked and had nothing; twice, for the status is a snapshot
        waits = query.status["message"].startswith("Waiting for data")
        idle = idle + 1 if waits else 0
        since = since or (time.monotonic() if wanted() else None)
        if ended.wait(0.1) or bounded and idle > 1 or since is not None and (waits or time.monotonic() - since > GRACE_SECONDS):
            query.stop()
            return
