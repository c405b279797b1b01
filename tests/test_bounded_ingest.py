import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from blockloom import __main__ as cli
from blockloom.errors import ConfigError, HandlerError, StoreError
from blockloom.operators import changelog, filters
from blockloom.sources import project, rpc, sdl
from blockloom.streaming import commit, handlers, ingest
from blockloom.streaming.commit import Store
from blockloom.streaming.entity_store import CheckpointStore, EntityStore
from blockloom.streaming.metrics import Gauges
from blockloom.operators.lineage import Header

from test_ingest import CONTRACT, MANIFEST, Chain, bundle, load, node  # noqa: F401


def source(spark, url, **more):
    rpc.register(spark)
    reader = spark.readStream.format("blockloom").option("endpoints", url).option("chainid", "1").option("batchsize", "4").option("slice", "2")
    for k, v in more.items():
        reader = reader.option(k, v)
    return reader.load()


def ended(query):
    assert query.awaitTermination(240)
    if error := query.exception():
        raise error


def test_default_trigger_reaches_the_head(spark, node, tmp_path):  # noqa: F811
    Chain.head = 30
    store, gauges = Store(spark, f"file://{tmp_path}/store"), Gauges()
    assert not gauges.caught_up
    gauges.observe(rpc.Client([node], "1"))
    ended(ingest.stream(spark, store, source(spark, node), [], str(tmp_path / "ck"), gauges=gauges))
    assert store.manifest()["checkpoint"]["height"] == 30 and store.manifest()["batch"] >= 7
    assert [r[0] for r in store.table("journal").select("height").orderBy("height").collect()] == list(range(31))
    assert gauges.caught_up and gauges.values["finalized_height"] == 30 and gauges.values["commit_duration"] > 0 and gauges.values["queue_depth"] == 0
    # the last header comes from the manifest, not from the journal
    assert ingest.last_header(store).parent_hash == Chain.name(29)
    # a new stream that counts its batches from 0 goes on behind the last height
    Chain.head = 33
    ended(ingest.stream(spark, store, source(spark, node, startheight=31), [], str(tmp_path / "other")))
    assert store.table("journal").count() == 34


def test_stops_at_a_height_and_on_demand(spark, node, tmp_path):  # noqa: F811
    Chain.head = 30
    store = Store(spark, f"file://{tmp_path}/store")
    ended(ingest.stream(spark, store, source(spark, node), [], str(tmp_path / "ck"), until=7))
    first = store.manifest()["checkpoint"]["height"]
    assert 7 <= first < 30 and store.table("journal").count() == first + 1
    stop = threading.Event()
    query = ingest.stream(spark, store, source(spark, node), [], str(tmp_path / "ck"), stop=stop, processingTime="0 seconds")
    time.sleep(1)
    stop.set()
    ended(query)
    tip = store.manifest()["checkpoint"]["height"]
    assert store.table("journal").count() == tip + 1


def count_calls(read):
    calls = []
    answer = Chain.do_POST

    def counted(self):
        calls.append(1)
        answer(self)

    Chain.do_POST = counted
    try:
        return read(), len(calls)
    finally:
        Chain.do_POST = answer


@pytest.mark.parametrize("where,want", [("height = 5", [5]), ("height in (2, 6, 7)", [2, 6, 7]), ("height > 6", [7, 8]), ("height < 2", [0, 1]), ("height between 5 and 5", [5]), ("height = 5 and height = 6", []), ("height > 20", [])])
def test_heights_reach_the_node(spark, node, where, want):  # noqa: F811
    got, calls = count_calls(lambda: sorted(r["height"] for r in load(spark, node).where(where).select("height").collect()))
    # a block is two requests and the head two, each behind one for the chain's id
    assert got == want and calls <= 4 + 4 * len(want)


def test_commits_stay_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit, "MERGE", 3)
    store = Store(spark, f"file://{tmp_path}/s")
    for i in range(11):
        store.commit({"t": ("append", spark.range(i, i + 1))}, {"height": i}, i)
    parts = store.manifest()["tables"]["t"]["parts"]
    assert len(parts) <= 5 and max(map(commit.level, parts)) == 2
    assert sorted(r[0] for r in store.table("t").collect()) == list(range(11))
    store.vacuum(kept=2)
    assert store._commits() == [10, 11] and store.table("t").count() == 11
    (tmp_path / "s" / "last").write_text("1")  # a hint of no use
    assert store.manifest()["version"] == 11
    # the slower of two writers loses
    with pytest.raises(StoreError):
        store._publish(store.manifest())


def test_block_is_one_commit(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    e = EntityStore(store, sdl.parse("type Account @entity { id: ID! n: Int }"))
    block = e.block(5)
    block.set("Account", {"id": "a", "n": 1})
    block.set("Account", {"id": "a", "n": 2})
    block.remove("Account", "b")
    with pytest.raises(StoreError):
        block.set("Nope", {"id": "a"})
    before = store.manifest()["version"]
    assert block.commit(Header(5, "0x5", "0x4"), 3, batch=0) and not block.commit(Header(5, "0x5", "0x4"), 3, batch=0)
    assert store.manifest()["version"] == before + 1 and store.manifest()["checkpoint"]["height"] == 5
    assert e.get("Account", "a")["n"] == 2 and CheckpointStore(store).header_at(5).parent_hash == "0x4"
    plan = e.frame("Account", ids=["a"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "id" in plan.split("PushedFilters")[1].split("]")[0]


def test_upserts_converge(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    twice = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id long, v string, turn int")
    assert sorted(map(tuple, changelog.upserted(now, twice, order=("turn",)).collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert changelog.upserted(now, twice.drop("turn")).count() == 3


def create(ctx, record):
    ctx.log("info", "seen")
    assert ctx.call("0x0") == (handlers.CAPABILITY_DENIED, None)
    ctx.set("Transfer", str(record["height"]), {"id": str(record["height"]), "at": record["block"]["timestamp"], "of": record["dataSource"], "kind": record["kind"], "parent": record["block"]["parentHash"]})
    ctx.add_source("pool", {"address": CONTRACT})


def slow(ctx, record):
    while True:
        pass


def test_handlers_see_the_block_and_create_sources(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    registry = handlers.Registry(["Transfer"])
    registry.add(handlers.Registered("create", create))
    registry.add(handlers.Registered("slow", slow))
    rows = spark.createDataFrame([(7, 0, 0, "{}", "0xaa", "0xbb", 1_700_000_000, "log", "token", '{"x":1}')], "height long, tx_index long, log_index long, payload string, hash string, parent_hash string, t long, kind string, source string, parameters string")
    rows = rows.withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    out = handlers.run_pure(rows, registry, "create")
    data = json.loads(handlers.operations_of(out).first()["data"])
    assert data == {"id": "7", "at": "2023-11-14T22:13:20Z", "of": {"name": "token", "parameters": {"x": 1}}, "kind": "log", "parent": "0xbb"}
    made = [(r["template"], json.loads(r["parameters"]), r["height"]) for r in handlers.sources_of(out).collect()]
    assert made == [("pool", {"address": CONTRACT}, 7)]
    import yaml

    manifest = yaml.safe_load(MANIFEST)
    manifest["templates"] = [{"name": "pool", "kind": "evm/Runtime", "handlers": [{"handler": "on_pool", "kind": "evm/LogHandler"}]}]
    active = project.active_handlers(manifest, made + made)
    assert [h.name for h in active][-1] == "on_pool" and active[-1].filter == filters.LogFilter(CONTRACT, ()) and len(active) == 4 and active[-1].start == 100
    with pytest.raises(ConfigError):
        project.active_handlers(manifest, [("nope", {}, 1)])
    assert len(handlers.run_ordered(rows, registry, "create")) == 2
    with pytest.raises(HandlerError, match="status -5"):
        handlers.run_ordered(rows, registry, "slow", limits=handlers.Limits(timeout_ms=50))


def test_calls_are_pinned(spark, node):  # noqa: F811
    asked = []
    client = rpc.Client([node], "1")
    client.call = lambda method, params: asked.append((method, params)) or "0xab"
    ctx = handlers.Context(frozenset(), height=9, chain=client.call_at)
    assert ctx.call("0x01", "0x02") == (handlers.OK, "0xab") and asked == [("eth_call", [{"to": "0x01", "data": "0x02"}, "0x9"])]


def test_signatures_with_tuples():
    assert project.canonical_signature("f((address,uint256)[])") == "f((address,uint256)[])"
    assert project.canonical_signature("function g(tuple(uint a, (bytes32 b, int[] c)[2] d) calldata x, bool) external returns (uint)") == "g((uint256,(bytes32,int256[])[2]),bool)"
    for bad in ("f((uint)", "f(,)", "f(Address)", "f"):
        with pytest.raises(ConfigError):
            project.canonical_signature(bad)


def test_command_line(spark, node, tmp_path):  # noqa: F811
    Chain.head = 12
    home = bundle(tmp_path, MANIFEST.replace("http://localhost", node).replace("startBlock: 100\n", ""))
    args = ["ingest", "--project", str(home), "--store", f"file://{tmp_path}/store", "--batch-size", "5", "--end-height", "9"]
    assert cli.main(args) == 0
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.manifest()["checkpoint"]["height"] == 9 and store.table("journal").count() == 10
    assert store.manifest()["facts"]["chain_id"] == "1"
    assert cli.main(args[:-1] + ["11"]) == 0  # goes on
    assert store.table("journal").count() == 12
    assert cli.main([*args, "--start-height", "50"]) == 1  # would skip heights
    assert cli.main([*args, "--queue-capacity", "2"]) == 1 and cli.main([*args, "--bypass", "9-5"]) == 1
    assert cli.main([*args, "--unfinalized-blocks", "--historical", "disabled"]) == 1
