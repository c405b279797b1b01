"""Blocks from a JSON-RPC node: a client, and batch and streaming data sources over it.

Executors fetch their own slices of heights. ``columns=header`` asks for headers alone, which
leaves payloads at the node. The streaming reader bounds a batch by ``batchsize`` in latestOffset.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import BlockUnavailable, ChainError, DecodeError, RateLimited, RpcFatal, TransportError, WrongNetwork
from ..operators.planning import budget, next_batch, safe_head
from ..shipping import ship
from .project import check_endpoint, redact

HEADER = "height long, hash string, parent_hash string, timestamp timestamp"
BLOCK = HEADER + ", transactions array<struct<hash:string,transaction_index:bigint,from:string,to:string,value:string,input:string>>, logs array<struct<log_index:bigint,transaction_index:bigint,transaction_hash:string,address:string,topics:array<string>,data:string>>"
# Error codes of nodes.
RATE_LIMIT_CODES = (-32005, -32016)
NO_METHOD_CODES = (-32601, -32602)


def backoff_ms(attempt: int) -> int:
    return min(100 << min(attempt, 6), 5000)


def quantity(raw: object) -> int:
    """Minimal 0x hex within 64 bits."""
    if not isinstance(raw, str) or not raw.startswith("0x") or not raw[2:] or raw[2:] != "0" and raw[2] == "0":
        raise DecodeError(f"not a quantity: {raw!r}")
    try:
        value = int(raw[2:], 16)
    except ValueError:
        raise DecodeError(f"not a quantity: {raw!r}") from None
    if value >> 64:
        raise DecodeError(f"beyond 64 bits: {raw!r}")
    return value


def fixed_hex(raw: object, size: int | None) -> str:
    try:
        if not isinstance(raw, str) or not raw.startswith("0x"):
            raise ValueError
        data = bytes.fromhex(raw[2:])
    except ValueError:
        raise DecodeError(f"not hex: {raw!r}") from None
    if size is not None and len(data) != size or len(raw) != 2 + 2 * len(data):
        raise DecodeError(f"wrong length: {raw!r}")
    return "0x" + data.hex()


class Client:
    """Retries over several endpoints; every attempt checks the network of the endpoint it uses."""

    def __init__(self, endpoints: list[str], chain_id: str, timeout: float = 30, attempts: int = 5, confirmations: int = 200, sleep: Callable[[float], None] = time.sleep):
        if not endpoints:
            raise ChainError("no endpoint")
        self.endpoints, self.chain_id = [check_endpoint(e) for e in endpoints], str(chain_id)
        self.timeout, self.attempts, self.confirmations, self.sleep = timeout, attempts, confirmations, sleep
        #: requests that failed, retried or not
        self.errors = 0

    def _post(self, endpoint: str, method: str, params: list) -> object:
        body = json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}).encode()
        request = urllib.request.Request(endpoint, body, {"content-type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                raw = answer.read()
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise RateLimited(redact(endpoint)) from None
            raise TransportError(f"{redact(endpoint)}: HTTP {e.code}") from None
        except OSError as e:
            raise TransportError(f"{redact(endpoint)}: {type(e).__name__}") from None
        try:
            answer = json.loads(raw)
        except ValueError:
            raise DecodeError("unreadable answer") from None
        if not isinstance(answer, dict):
            raise DecodeError("unreadable answer")
        if error := answer.get("error"):
            code = error.get("code", 0)
            if code in RATE_LIMIT_CODES:
                raise RateLimited(f"{redact(endpoint)}: {code}")
            raise RpcFatal(code, str(error.get("message", "")))
        return answer.get("result")

    def call(self, method: str, params: list) -> object:
        last: ChainError | None = None
        for attempt in range(self.attempts):
            endpoint = self.endpoints[attempt % len(self.endpoints)]
            try:
                found = quantity(self._post(endpoint, "eth_chainId", []))
                if str(found) != self.chain_id:
                    raise WrongNetwork(f"{redact(endpoint)} serves {found}, not {self.chain_id}")
                return self._post(endpoint, method, params)
            except ChainError as e:
                self.errors += 1
                if not e.retryable:
                    raise
                last = e
            if attempt + 1 < self.attempts:
                self.sleep(backoff_ms(attempt) / 1000)
        raise last

    def latest(self) -> int:
        return quantity(self.call("eth_blockNumber", []))

    def finalized(self) -> int:
        """By the node's own tag; nodes that don't know it give the head less the confirmations."""
        try:
            block = self.call("eth_getBlockByNumber", ["finalized", False])
            return 0 if block is None else quantity(block["number"])
        except RpcFatal as e:
            if e.code not in NO_METHOD_CODES:
                raise
            return max(0, self.latest() - self.confirmations)

    def call_at(self, height: int, to: str, data: str = "0x") -> str:
        """A contract's answer as of a block: a read, pinned to the height."""
        return fixed_hex(self.call("eth_call", [{"to": to, "data": data}, hex(height)]), None)

    def safe_head(self, unfinalized: bool = False) -> int:
        head = self.latest()
        return head if unfinalized else safe_head(head, self.finalized(), False)

    def _raw(self, height: int, full: bool) -> dict:
        raw = self.call("eth_getBlockByNumber", [hex(height), full])
        if raw is None:
            raise BlockUnavailable(str(height))
        if quantity(raw.get("number")) != height:
            raise DecodeError(f"asked for {height}, got {raw.get('number')}")
        return raw

    def header(self, height: int) -> tuple:
        raw = self._raw(height, False)
        return height, fixed_hex(raw["hash"], 32), fixed_hex(raw["parentHash"], 32), quantity(raw["timestamp"])

    def block(self, height: int) -> tuple:
        """Header, transactions and logs. Logs are asked for by the block's hash, so that all is of one fork; one row that does not fit fails the block."""
        raw = self._raw(height, True)
        head = (height, fixed_hex(raw["hash"], 32), fixed_hex(raw["parentHash"], 32), quantity(raw["timestamp"]))
        bad = lambda what: DecodeError(f"block {height}: {what}")
        txs = []
        for i, t in enumerate(raw.get("transactions") or []):
            if quantity(t["transactionIndex"]) != i or fixed_hex(t["blockHash"], 32) != head[1] or quantity(t["blockNumber"]) != height:
                raise bad(f"transaction {i} is of another place")
            value = t["value"]
            if not isinstance(value, str) or not value.startswith("0x") or len(value) > 66:
                raise bad(f"value of transaction {i}")
            txs.append((fixed_hex(t["hash"], 32), i, fixed_hex(t["from"], 20), None if t.get("to") is None else fixed_hex(t["to"], 20), str(int(value, 16)), fixed_hex(t["input"], None)))
        if len({t[0] for t in txs}) != len(txs):
            raise bad("a transaction twice")
        logs = []
        for entry in self.call("eth_getLogs", [{"blockHash": head[1]}]) or []:
            i = quantity(entry["transactionIndex"])
            if entry.get("removed") is not False or fixed_hex(entry["blockHash"], 32) != head[1] or quantity(entry["blockNumber"]) != height:
                raise bad("a log of another fork")
            if i >= len(txs) or txs[i][0] != fixed_hex(entry["transactionHash"], 32) or len(entry["topics"]) > 4:
                raise bad("a log without its transaction")
            logs.append((quantity(entry["logIndex"]), i, txs[i][0], fixed_hex(entry["address"], 20), [fixed_hex(x, 32) for x in entry["topics"]], fixed_hex(entry["data"], None)))
        logs.sort(key=lambda x: x[0])
        if [x[0] for x in logs] != list(range(len(logs))):
            raise bad("log indexes have gaps")
        return (*head, txs, logs)


class Heights(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


def _client(options: dict) -> Client:
    return Client([e for e in options["endpoints"].split(",") if e], options["chainid"], float(options.get("timeout", 30)), int(options.get("attempts", 5)), int(options.get("confirmations", 200)))


def _rows(options: dict, part: Heights) -> Iterator[tuple]:
    import datetime

    client, headers = _client(options), options.get("columns") == "header"
    for height in range(part.low, part.high + 1):
        row = client.header(height) if headers else client.block(height)
        yield (*row[:3], datetime.datetime.fromtimestamp(row[3], datetime.timezone.utc), *row[4:])


def _slices(low: int, high: int, size: int) -> list[Heights]:
    return [Heights(a, min(a + size - 1, high)) for a in range(low, high + 1, size)]


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.low = int(options.get("startheight", 0))
        self.high = int(options["endheight"]) if "endheight" in options else None
        self.only: set[int] | None = None

    def pushFilters(self, filters):  # noqa: N802
        """What bounds the height becomes bounds of the fetch; a height that equals or is among some is fetched alone."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("height",) or not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
            elif isinstance(f, EqualTo):
                self._keep({int(value)})
            elif isinstance(f, In):
                self._keep({int(v) for v in value if v is not None})
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, int(value) + isinstance(f, GreaterThan))
            else:
                last = int(value) - isinstance(f, LessThan)
                self.high = last if self.high is None else min(self.high, last)

    def _keep(self, heights: set[int]) -> None:
        self.only = heights if self.only is None else self.only & heights

    def partitions(self):
        low, high = self.low, self.high
        if self.only is not None:
            low, high = max([low, min(self.only, default=low)]), min(x for x in (high, max(self.only, default=low - 1)) if x is not None)
        if high is None or low <= high:  # else there is nothing to ask the node for
            head = _client(self.options).safe_head(self.options.get("unfinalized") == "true")
            high = head if high is None else min(high, head)
        size = int(self.options.get("slice", 16))
        if self.only is None:
            return _slices(low, high, size) or [Heights(0, -1)]
        out = []
        for h in sorted(x for x in self.only if low <= x <= high):
            if out and out[-1].high == h - 1 and h - out[-1].low < size:
                out[-1].high = h
            else:
                out.append(Heights(h, h))
        return out or [Heights(0, -1)]

    def read(self, partition):
        return _rows(self.options, partition)


class BlockStreamReader(DataSourceStreamReader):
    """Offsets are the next height. A batch is what the planner gives: bypassed spans are skipped, batches bounded by ``batchsize`` and by what ``queuecapacity`` leaves beside blocks that are planned and not yet committed. ``maxinflight`` bounds the slices that are fetched at once."""

    def __init__(self, options: dict):
        self.options, self.seen, self.done = options, None, None

    def initialOffset(self):  # noqa: N802
        return {"next": int(self.options.get("startheight", 0))}

    def _plan(self, cursor: int):
        o = self.options
        end = int(o["endheight"]) if "endheight" in o else None
        bypass = [tuple(map(int, x.split("-"))) for x in o.get("bypass", "").split(",") if x]
        capacity = int(o.get("queuecapacity", 200))
        queued = 0 if self.seen is None or self.done is None else max(0, self.seen - self.done)
        size = min(int(o.get("batchsize", 100)), budget(capacity, capacity, queued, 0))
        return next_batch(cursor, _client(o).safe_head(o.get("unfinalized") == "true"), size, end, bypass) if size else None

    def latestOffset(self):  # noqa: N802
        cursor = self.initialOffset()["next"] if self.seen is None else self.seen
        plan = self._plan(cursor)
        self.seen = cursor if plan is None else plan[1] + 1
        return {"next": self.seen}

    def partitions(self, start, end):
        self.seen = max(self.seen or 0, end["next"])
        bypass = [tuple(map(int, x.split("-"))) for x in self.options.get("bypass", "").split(",") if x]
        low = start["next"]
        plan = next_batch(low, end["next"] - 1, max(end["next"] - low, 1), None, bypass)
        if not plan:
            return [Heights(0, -1)]
        # no more slices than blocks may be in flight, for each is fetched by one task
        least = -(-(plan[1] - plan[0] + 1) // int(self.options.get("maxinflight", 8)))
        return _slices(plan[0], plan[1], max(int(self.options.get("slice", 16)), least))

    def read(self, partition):
        return _rows(self.options, partition)

    def commit(self, end):
        self.done = end["next"]


class BlockSource(DataSource):
    """spark.read.format("blockloom").option("endpoints", ...).option("chainid", "1"): blocks, or headers by columns=header."""

    @classmethod
    def name(cls):
        return "blockloom"

    def schema(self):
        return HEADER if self.options.get("columns") == "header" else BLOCK

    def reader(self, schema):
        return BlockReader(dict(self.options))

    def streamReader(self, schema):  # noqa: N802
        return BlockStreamReader(dict(self.options))


def register(spark) -> None:
    """Make the format known; bounds on height reach the node as the heights to fetch."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)
