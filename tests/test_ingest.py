import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from blockloom.errors import BlockUnavailable, ConfigError, DecodeError, HandlerError, IdentityMismatch, LineageError, RpcFatal, TransportError, UnsupportedType, WrongNetwork
from blockloom.operators import filters
from blockloom.sources import project, rpc, sdl
from blockloom.streaming import handlers, ingest
from blockloom.streaming.commit import Store

TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
CONTRACT = "0x" + "c0" * 20


class Chain(http.server.BaseHTTPRequestHandler):
    head, fork, chain, fails, tag = 8, 0, "0x1", [], True

    def log_message(self, *a):
        pass

    @classmethod
    def name(cls, h):
        return f"0x{h + 1 + (cls.fork if h > 4 else 0):064x}"

    def do_POST(self):  # noqa: N802
        q = json.loads(self.rfile.read(int(self.headers["content-length"])))
        method, params = q["method"], q["params"]
        cls = type(self)
        if method != "eth_chainId" and cls.fails:
            code = cls.fails.pop(0)
            if code > 0:
                self.send_response(code)
                self.end_headers()
                return
            return self.answer({"error": {"code": code, "message": "no"}})
        if method == "eth_chainId":
            result = cls.chain
        elif method == "eth_blockNumber":
            result = hex(cls.head)
        elif method == "eth_getLogs":
            h = next(x for x in range(cls.head + 1) if cls.name(x) == params[0]["blockHash"])
            result = [] if h % 2 else [{"blockHash": cls.name(h), "blockNumber": hex(h), "transactionHash": f"0x{h + 77:064x}", "transactionIndex": "0x0", "logIndex": "0x0", "removed": False, "address": CONTRACT, "topics": [TOPIC], "data": "0x01"}]
        elif params[0] == "finalized" and not cls.tag:
            return self.answer({"error": {"code": -32601, "message": "no method"}})
        else:
            h = cls.head if params[0] == "finalized" else int(params[0], 16)
            result = None
            if h <= cls.head:
                tx = {"hash": f"0x{h + 77:064x}", "blockHash": cls.name(h), "blockNumber": hex(h), "transactionIndex": "0x0", "from": CONTRACT, "to": None, "value": hex((1 << 255) + h), "input": "0x"}
                result = {"number": hex(h), "hash": cls.name(h), "parentHash": cls.name(h - 1) if h else "0x" + "00" * 32, "timestamp": hex(1_700_000_000 + h), "transactions": [tx] if params[1] else [tx["hash"]]}
        self.answer({"result": result})

    def answer(self, body):
        raw = json.dumps({"jsonrpc": "2.0", "id": 1} | body).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(raw)


@pytest.fixture()
def node():
    Chain.head, Chain.fork, Chain.chain, Chain.fails, Chain.tag = 8, 0, "0x1", [], True
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Chain)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def client(url, **how):
    return rpc.Client([url], "1", sleep=lambda s: None, **how)


def test_client(node):
    c = client(node)
    assert c.latest() == 8 and c.finalized() == 8 and c.header(3)[1] == Chain.name(3)
    block = c.block(2)
    assert block[4][0][4] == str((1 << 255) + 2) and block[5][0][0] == 0
    Chain.fails = [429, -32005, 500]
    assert c.latest() == 8
    Chain.fails = [500] * 5
    with pytest.raises(TransportError):
        c.latest()
    Chain.fails = [-32000]
    with pytest.raises(RpcFatal):
        c.latest()
    Chain.fails, Chain.tag = [], False
    assert client(node, confirmations=3).finalized() == 5 and client(node, confirmations=30).finalized() == 0
    with pytest.raises(BlockUnavailable):
        client(node, attempts=1).header(99)
    Chain.chain = "0x2"
    with pytest.raises(WrongNetwork):
        c.latest()
    assert [rpc.backoff_ms(i) for i in (0, 1, 6, 20)] == [100, 200, 5000, 5000]
    for bad in ("1", "0x", "0x01", "0xg", None, "0x1" + "0" * 16):
        with pytest.raises(DecodeError):
            rpc.quantity(bad)


def load(spark, url, **more):
    rpc.register(spark)
    reader = spark.read.format("blockloom").option("endpoints", url).option("chainid", "1").option("slice", "3")
    for k, v in more.items():
        reader = reader.option(k, v)
    return reader.load()


def test_batch_source(spark, node):
    blocks = load(spark, node)
    assert [r["height"] for r in blocks.select("height").orderBy("height").collect()] == list(range(9))
    assert blocks.select(F.inline("logs")).count() == 5
    assert load(spark, node, columns="header", startheight=4, endheight=6).count() == 3
    assert load(spark, node, columns="header").where("height >= 3 and height <= 5").count() == 3


def ingest_all(spark, store, url, tmp, **more):
    rpc.register(spark)
    reader = spark.readStream.format("blockloom").option("endpoints", url).option("chainid", "1").option("batchsize", "4").option("slice", "2")
    for k, v in more.items():
        reader = reader.option(k, v)
    own = [filters.Handler("transfers", filters.LOG, filters.LogFilter(CONTRACT, (TOPIC,)))]
    q = ingest.stream(spark, store, reader.load(), own, str(tmp), processingTime="0 seconds")
    return q


def wait_for(store, q, height):
    import time

    until = time.time() + 90
    while time.time() < until and q.isActive:
        tip = store.manifest()["checkpoint"]
        if tip and tip["height"] >= height:
            break
        time.sleep(0.5)
    error = q.exception()
    q.stop()
    if error:
        raise error


def test_ingestion_restart_and_fork(spark, node, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    wait_for(store, ingest_all(spark, store, node, tmp_path / "ck"), 8)
    assert [r[0] for r in store.table("journal").select("height").orderBy("height").collect()] == list(range(9))
    counts = {r["height"]: r["n"] for r in store.table("matches").collect()}
    assert counts == {h: 1 - h % 2 for h in range(9)}
    # more blocks, the same checkpoint: goes on where it was
    Chain.head = 10
    wait_for(store, ingest_all(spark, store, node, tmp_path / "ck"), 10)
    assert store.table("journal").count() == 11
    config = project.IngestConfig(unfinalized=True, ingest_only=False)
    assert ingest.resume(store, lambda h: Chain.name(h), config, 0) == 11
    with pytest.raises(LineageError):
        ingest.resume(store, lambda h: Chain.name(h), config, 50)
    # a fork above block 4
    Chain.fork = 100
    with pytest.raises(LineageError):
        ingest.resume(store, Chain.name, project.IngestConfig(), 0)
    assert ingest.resume(store, Chain.name, config, 0) == 5
    assert store.manifest()["generation"] == 1 and store.table("journal").count() == 5


def test_commits(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.range(3)
    assert store.table("t") is None and store.commit({"t": ("append", rows)}, batch=0)
    assert not store.commit({"t": ("append", rows)}, batch=0) and store.table("t").count() == 3
    assert store.commit({"t": ("append", rows)}, batch=1) and store.table("t").count() == 6
    assert store.update("t", lambda t: t.where("id = 1")) and store.table("t").count() == 2
    store.stamp({"chain_id": "1"})
    store.stamp({"chain_id": "1", "project_id": "p"})
    with pytest.raises(IdentityMismatch):
        store.stamp({"chain_id": "2"})
    assert store.manifest()["facts"] == {"chain_id": "1", "project_id": "p"}


SDL = '''
# a comment
"""doc"""
type Transfer @entity { id: ID!  amount: BigInt! @index(unique: true)  recipient: String  blockHeight: Int!  tags: [[String!]!]  }
enum Kind { A B }
type Helper { x: Int }
type Odd @entity { id: ID! k: Kind }
'''


def test_schema_language():
    got = sdl.parse(SDL)
    assert [e.name for e in got] == ["Transfer", "Odd"] and got[0].table == "transfers"
    assert [(f.column, f.base, f.is_list, f.nullable) for f in got[0].fields] == [("id", "ID", False, False), ("amount", "BigInt", False, False), ("recipient", "String", False, True), ("block_height", "Int", False, False), ("tags", "String", True, True)]
    assert got[0].struct()["tags"].dataType.simpleString() == "array<string>"
    with pytest.raises(UnsupportedType):
        got[1].struct()
    with pytest.raises(ConfigError):
        sdl.parse("type A @entity { key: ID! }")[0].struct()


MANIFEST = """
specVersion: "1.0"
name: demo
version: "1"
network: {family: evm, chainId: "1", endpoint: ["http://localhost"]}
startBlock: 100
schema: {file: ./schema.graphql}
dataSources:
  - kind: evm/Runtime
    name: token
    options: {address: "0xC0C0C0C0C0C0C0C0C0C0C0C0C0C0C0C0C0C0C0C0"}
    assets: {abi: {file: ./abi.json}}
    handlers:
      - {handler: on_transfer, kind: evm/LogHandler, filter: {event: "Transfer(address indexed from, address indexed to, uint value)"}}
      - {handler: on_call, kind: evm/TransactionHandler, filter: {function: "transfer(address,uint256)"}}
      - {handler: on_block, kind: evm/BlockHandler, filter: {modulo: 10}}
"""


def bundle(tmp_path, text=MANIFEST):
    (tmp_path / "project.yaml").write_text(text)
    (tmp_path / "schema.graphql").write_text(SDL)
    (tmp_path / "abi.json").write_text("[]")
    return tmp_path


def test_project(tmp_path):
    p = project.load(bundle(tmp_path))
    log, tx, block = p.handlers()
    assert log.filter == filters.LogFilter(CONTRACT, (TOPIC,)) and log.start == 100
    assert tx.filter == filters.TransactionFilter(CONTRACT, None, "0xa9059cbb") and block.filter.modulo == 10
    before = p.fingerprint
    (tmp_path / "abi.json").write_text("[ ]")
    assert project.load(tmp_path).fingerprint != before
    for old, new in (("modulo: 10", "modulo: 0"), ("modulo: 10", "timestamp: x"), ("evm/Runtime", "sol/Runtime"), ("./abi.json", "../abi.json"), ("{address:", "{adress:"), ("transfer(address,uint256)", "not a signature")):
        with pytest.raises(ConfigError):
            project.load(bundle(tmp_path, MANIFEST.replace(old, new))).handlers()
    bundle(tmp_path)
    (tmp_path / "project.yml").write_text("")
    with pytest.raises(ConfigError):
        project.load(tmp_path)


def test_config():
    for bad in ({"batch_size": 0}, {"unfinalized": True}, {"start_height": 5, "end_height": 4}, {"queue_capacity": 10}, {"start_height": 1 << 63}, {"unfinalized": True, "ingest_only": False, "historical": "disabled"}):
        with pytest.raises(ConfigError):
            project.IngestConfig(**bad)
    d = project.DatabaseConfig.resolve("postgres://us%40er:p%2Fw@db:99/name?schema=s", {})
    assert (d.host, d.port, d.username, d.password, d.database, d.schema) == ("db", 99, "us@er", "p/w", "name", "s")
    assert project.DatabaseConfig.resolve(None, {"DB_HOST": "h", "DB_PORT": "x"}).port == 5432
    for bad in ("mysql://a/b", "postgres://a/"):
        with pytest.raises(ConfigError):
            project.DatabaseConfig.resolve(bad, {})
    assert project.redact("https://u:p@host:8545/key?x=1") == "https://host:8545"
    for bad in ("ftp://x", "http://", "http://x#y"):
        with pytest.raises(ConfigError):
            project.check_endpoint(bad)


def transfer(ctx, record):
    p = record["payload"]
    assert ctx.set("Nope", "1", {}) == handlers.UNKNOWN_ENTITY and ctx.set("Transfer", "1", []) == handlers.INVALID_ARGUMENT and ctx.set("Transfer", "1", {"id": "2"}) == handlers.INVALID_ARGUMENT
    if p.get("fail"):
        return handlers.STORE_ERROR
    ctx.set("Transfer", p["id"], {"id": p["id"], "n": p["n"]})
    return handlers.OK


def running(ctx, record):
    p = record["payload"]
    status, old = ctx.get("Transfer", p["id"])
    ctx.set("Transfer", p["id"], {"id": p["id"], "n": p["n"] + (old["n"] if status == handlers.OK else 0)})


def test_handlers(spark):
    registry = handlers.Registry(["Transfer"])
    registry.add(handlers.Registered("transfer", transfer))
    registry.add(handlers.Registered("running", running, reads=True))
    with pytest.raises(HandlerError):
        registry.add(handlers.Registered("old", transfer, version=2))
    rows = [(h, 0, i, json.dumps({"id": str(i % 2), "n": h})) for h in range(4) for i in range(3)]
    inputs = spark.createDataFrame(rows, "height long, tx_index long, log_index long, payload string")
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    got = handlers.run_pure(inputs, registry, "transfer")
    assert got.count() == 12 and got.first()["op"] == "Set"
    with pytest.raises(HandlerError):
        handlers.run_pure(inputs, registry, "running")
    out = handlers.run_ordered(inputs, registry, "running")
    assert json.loads(out[-1][-1])["n"] == sum(h * 2 for h in range(4))
    bad = spark.createDataFrame([(1, 0, 0, '{"fail": 1}')], inputs.schema)
    with pytest.raises(Exception, match="status -3"):
        handlers.run_pure(bad, registry, "transfer").collect()
    keyed = inputs.withColumn("k", F.get_json_object("payload", "$.id"))
    folds = handlers.run_folds(keyed, "k", dict, lambda s, p: {"id": p["id"], "n": s.get("n", 0) + p["n"]}, "Transfer")
    last = folds.groupBy("id").agg(F.max_by("data", F.struct("height", "log_index"))).collect()
    assert sorted(json.loads(r[1])["n"] for r in last) == [6, 12]
