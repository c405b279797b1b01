"""python -m blockloom ingest --project DIR …: ingestion of a project's blocks, with restart, rewind and clean stop."""

from __future__ import annotations

import argparse
import json
import logging
import os
import signal
import sys
import threading

from pyspark.sql import SparkSession

from .errors import BlockloomError, ConfigError
from .sources import project, rpc
from .streaming import ingest
from .streaming.commit import Store
from .streaming.metrics import Gauges
from .types import BLOCK_INTERVAL_MS, DEFAULT_INTERVAL_MS

_log = logging.getLogger("blockloom")


def parser() -> argparse.ArgumentParser:
    """Flags and their defaults; the environment gives those that are secrets."""
    d = project.IngestConfig()
    p = argparse.ArgumentParser(prog="blockloom")
    p.add_argument("command", choices=["ingest"])
    p.add_argument("--project", required=True, help="folder of the project's manifest")
    p.add_argument("--store", required=True, help="folder of the tables, on a store that the cluster shares")
    p.add_argument("--endpoint", action="append", default=[], help="node, instead of the manifest's; may come again")
    p.add_argument("--checkpoint", help="folder of the streaming query's own state (default: inside the store)")
    p.add_argument("--schema-version", default="1")
    for name, default in (("batch-size", d.batch_size), ("max-in-flight", d.max_in_flight), ("queue-capacity", d.queue_capacity), ("rpc-timeout-secs", d.rpc_timeout_secs), ("rpc-max-retries", d.rpc_max_retries), ("workers", os.cpu_count() or d.workers), ("query-limit", d.query_limit), ("finality-confirmations", d.finality_confirmations)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--start-height", type=int)
    p.add_argument("--end-height", type=int)
    p.add_argument("--bypass", default="", help="spans of heights to leave out: 5-9,20-30")
    p.add_argument("--unfinalized-blocks", action="store_true")
    p.add_argument("--ingest-only", action=argparse.BooleanOptionalAction, default=None, help="journal and counts alone (the default for finalized blocks)")
    p.add_argument("--historical", default=d.historical)
    p.add_argument("--follow", action="store_true", help="go on at the head, asking anew every block interval")
    p.add_argument("--log-level", default="info", choices=["trace", "debug", "info", "warn", "error"])
    p.add_argument("--log-json", action="store_true")
    return p


def spans(raw: str) -> tuple[tuple[int, int], ...]:
    try:
        out = tuple(tuple(map(int, x.split("-"))) for x in raw.split(",") if x)
        if any(len(x) != 2 or x[0] > x[1] for x in out):
            raise ValueError(raw)
    except ValueError:
        raise ConfigError(f"invalid spans {raw!r}") from None
    return out


def config_of(a: argparse.Namespace) -> project.IngestConfig:
    return project.IngestConfig(
        batch_size=a.batch_size, max_in_flight=a.max_in_flight, queue_capacity=a.queue_capacity, rpc_timeout_secs=a.rpc_timeout_secs, rpc_max_retries=a.rpc_max_retries, workers=a.workers, query_limit=a.query_limit,
        finality_confirmations=a.finality_confirmations, start_height=a.start_height, end_height=a.end_height, unfinalized=a.unfinalized_blocks, historical=a.historical,
        ingest_only=not a.unfinalized_blocks if a.ingest_only is None else a.ingest_only, bypass=spans(a.bypass),
    )


def options_of(config: project.IngestConfig, endpoints: list[str], chain_id: str) -> dict[str, str]:
    """The settings that the source reads."""
    out = {
        "endpoints": ",".join(endpoints), "chainid": chain_id, "timeout": config.rpc_timeout_secs, "attempts": config.rpc_max_retries, "confirmations": config.finality_confirmations, "batchsize": config.batch_size,
        "maxinflight": config.max_in_flight, "queuecapacity": config.queue_capacity, "slice": max(1, config.batch_size // config.workers), "unfinalized": str(config.unfinalized).lower(), "bypass": ",".join(f"{a}-{b}" for a, b in config.bypass),
    }
    return {k: str(v) for k, v in out.items()} | ({} if config.end_height is None else {"endheight": str(config.end_height)})


def run(spark: SparkSession, a: argparse.Namespace, stop: threading.Event, gauges: Gauges) -> None:
    config, bundle = config_of(a), project.load(a.project)
    endpoints = [project.check_endpoint(e) for e in a.endpoint] or bundle.endpoints
    client = rpc.Client(endpoints, bundle.chain_id, config.rpc_timeout_secs, config.rpc_max_retries, config.finality_confirmations)
    store = Store(spark, a.store)
    store.stamp(ingest.identity(bundle, a.schema_version))
    handlers = bundle.handlers()
    start = config.start_height if config.start_height is not None else min((h.start for h in handlers), default=0)

    def canonical(height: int) -> str | None:
        return client.header(height)[1] if height <= client.latest() else None

    start = ingest.resume(store, canonical, config, start, gauges)
    gauges.observe(client)
    rpc.register(spark)
    reader = spark.readStream.format("blockloom").options(**options_of(config, endpoints, bundle.chain_id), startheight=str(start))
    # a rewind begins a new generation, and a source that is to go on elsewhere needs a state of its own
    state = f"{(a.checkpoint or a.store + '/streaming').rstrip('/')}/{store.manifest()['generation']}-{start}"
    interval = BLOCK_INTERVAL_MS.get(bundle.chain_id, DEFAULT_INTERVAL_MS)
    trigger = {"processingTime": f"{interval} milliseconds"} if a.follow else {}

    def finalized() -> int:
        gauges.observe(client)
        return int(gauges.values["finalized_height"])

    query = ingest.stream(spark, store, reader.load(), handlers, state, config.end_height, stop, gauges, finalized, bool(config.bypass), **trigger)
    query.awaitTermination()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    form = json.dumps({"level": "%(levelname)s", "message": "%(message)s"}) if a.log_json else "%(asctime)s %(levelname)s %(message)s"
    logging.basicConfig(level={"trace": 5, "warn": logging.WARNING}.get(a.log_level) or getattr(logging, a.log_level.upper()), format=form)
    stop, gauges = threading.Event(), Gauges()
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGTERM, signal.SIGINT):
            signal.signal(s, lambda *_: stop.set())
    try:
        config_of(a)  # what contradicts itself fails before a session is there
        spark = SparkSession.builder.appName("blockloom").getOrCreate()
        run(spark, a, stop, gauges)
    except BlockloomError as e:
        _log.error("%s: %s", type(e).__name__, e)
        return 1
    _log.info("%s", json.dumps(gauges.values))
    return 0


if __name__ == "__main__":
    sys.exit(main())
