import pytest

from blockloom.errors import StoreError, UnsupportedType
from blockloom.operators.lineage import Header
from blockloom.sources import sdl
from blockloom.streaming.commit import Store
from blockloom.streaming.entity_store import CheckpointStore, EntityStore, Metadata

SDL = "type Transfer @entity { id: ID! amount: BigInt! recipient: String blockHeight: Int! tags: [String!] raw: Bytes extra: Json at: Date ok: Boolean x: Float }"
BIG = str(10**24)


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_entities(store):
    e = EntityStore(store, sdl.parse(SDL))
    e.initialize()
    assert e.frame("Transfer").count() == 0
    first = {"id": "t1", "amount": BIG, "recipient": "r", "blockHeight": 5, "tags": ["a", "b"], "raw": "0xABcd", "extra": {"k": [1, 2]}, "at": "2024-01-02T03:04:05Z", "ok": True, "x": 1.5}
    e.set("Transfer", first, 5)
    got = e.get("Transfer", "t1")
    assert (got["amount"], got["block_height"], got["tags"], bytes(got["raw"]), got["ok"], got["x"], got["at"].isoformat()) == (BIG, 5, ["a", "b"], b"\xab\xcd", True, 1.5, "2024-01-02T03:04:05")
    row = e.dump("Transfer").first()
    assert list(row.asDict()) == ["amount", "at", "block_height", "extra", "id", "ok", "raw", "recipient", "tags", "x"] and row["raw"] == "abcd" and row["tags"] == '["a","b"]' and row["extra"] == '{"k":[1,2]}'
    e.set("Transfer", {"id": "t1", "amount": "42", "blockHeight": 6}, 6)
    assert e.get("Transfer", "t1")["amount"] == "42" and e.get("Transfer", "t1")["recipient"] is None
    e.bulk_create("Transfer", [{"id": f"t{i}", "amount": str(i), "blockHeight": i} for i in (2, 3, 4)], 7)
    assert [r["id"] for r in e.get_by_fields("Transfer", ("blockHeight", "gt", 2), order_by="blockHeight", descending=True, limit=2).collect()] == ["t1", "t4"]
    assert e.get_one_by_field("Transfer", "amount", "3")["id"] == "t3" and e.get("Transfer", "zz") is None
    e.bulk_remove("Transfer", ["t1", "t2"], 8)
    assert sorted(r["id"] for r in e.frame("Transfer").collect()) == ["t3", "t4"]
    assert e.frame("Transfer", 5).first()["amount"] == BIG and e.frame("Transfer", 7).count() == 4
    e.compact_log(5)
    assert e.frame("Transfer", 7).count() == 4
    e.rewind(6)
    assert [r["amount"] for r in e.frame("Transfer").collect()] == ["42"]
    assert e.versions("Transfer").where("valid_to is null").count() == 1
    assert dict(e.introspect()["transfers"])["tags"] == "array<string>"
    for bad in (lambda: e.set("Nope", {"id": "1"}, 9), lambda: e.set("Transfer", {"amount": "1"}, 9), lambda: e.set("Transfer", {"id": "1", "colour": 1}, 9), lambda: e.get_by_fields("Transfer", ("colour", "eq", 1))):
        with pytest.raises((StoreError, ValueError)):
            bad()
    e.set("Transfer", {"id": "b", "amount": "1.5", "blockHeight": 9}, 9)
    with pytest.raises(Exception, match="not an integer"):
        e.frame("Transfer").collect()
    with pytest.raises(UnsupportedType):
        EntityStore(store, sdl.parse("type A @entity { id: ID! k: Kind }"))


def test_checkpoints(store):
    c = CheckpointStore(store)
    assert c.load() is None and c.header_at(1) is None
    for h in range(100, 105):
        c.commit(Header(h, hex(h), hex(h - 1)), h - 2, "final" if h < 103 else "unfinalized")
    c.commit(Header(104, "0xff", hex(103)), 90)
    assert c.load() == {"height": 104, "hash": "0xff", "finalized": 102} and c.header_at(104).hash == "0xff"
    assert [r["height"] for r in c.descending(101, 103).collect()] == [103, 102, 101]
    c.prune_below(104)
    assert sorted(r["height"] for r in c.headers().collect()) == [103, 104]
    c.truncate_above(103)
    assert [r["height"] for r in c.headers().collect()] == [103]


def test_facts(store):
    m = Metadata(store)
    store.stamp({"chain_id": "1", "name": "x"})
    assert m.number("chain_id") == 1 and m.number("none") is None
    with pytest.raises(StoreError):
        m.number("name")
    assert {r["key"]: r["status"] for r in m.verify({"chain_id": "2", "name": "x", "more": "1"}).collect()} == {"chain_id": "mismatch", "name": "match", "more": "stamp"}
