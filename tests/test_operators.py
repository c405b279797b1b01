import datetime
import itertools

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from blockloom.errors import LineageError
from blockloom.operators import changelog, decode, entities, filters, heightmap, lineage, metadata, ordered, planning

SIG, ALICE, BOB = "0x" + "11" * 32, "0x" + "aa" * 32, "0x" + "bb" * 32


def matches(spark, rows, f):
    df = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(rows)], "i long, address string, topics array<string>")
    return [r[0] for r in df.orderBy("i").select(f.column()).collect()]


def test_topic_filters(spark):
    rows = [("0xAA", [SIG, ALICE, BOB]), ("0xaa", [SIG, BOB, BOB]), ("0xbb", [SIG, BOB, ALICE]), (None, [SIG]), ("0xaa", [])]
    assert matches(spark, rows, filters.LogFilter(topics=(SIG, None, BOB))) == [True, True, False, False, False]
    assert matches(spark, rows, filters.LogFilter(topics=((ALICE, SIG.upper().replace("0X", "0x")),))) == [True, True, True, True, False]
    assert matches(spark, rows, filters.LogFilter(topics=(SIG, ALICE))) == [True, False, False, False, False]
    assert matches(spark, rows, filters.LogFilter(topics=(SIG, None, None))) == [True, True, True, True, False]
    assert matches(spark, rows, filters.LogFilter("AA")) == [True, True, False, False, True]
    assert matches(spark, rows, filters.LogFilter()) == [True] * 5
    assert filters.LogFilter(topics=(SIG,)).pinned_topic0() == SIG and filters.LogFilter(topics=((SIG,),)).pinned_topic0() is None and filters.LogFilter().pinned_topic0() is None


def test_transaction_filters(spark):
    df = spark.createDataFrame([(0, "0xAA", "0x1", "0xa9059cbb01"), (1, None, "0x1", "0xa905"), (2, "0xbb", "0x2", "0x")], "i long, to string, from string, input string").orderBy("i")
    run = lambda f: [r[0] for r in df.select(f.column()).collect()]
    assert run(filters.TransactionFilter(to="0xaa")) == [True, False, False]
    assert run(filters.TransactionFilter(sender="1")) == [True, True, False]
    assert run(filters.TransactionFilter(function="0xA9059CBB")) == [True, False, False]
    assert run(filters.TransactionFilter(function="")) == [False, False, False]



def test_generic_params_match_nothing(spark):
    df = spark.createDataFrame([("0x1", [SIG], "0x9")], "address string, topics array<string>, tx_hash string")
    for kind, params in (("log", '{"address": 42}'), ("log", '{"topics": [4]}'), ("log", "[]"), ("log", "not json"), ("block", None)):
        assert df.select(filters.event_matches(kind, params)).first()[0] is False
    assert df.select(filters.event_matches("log", None)).first()[0] is True


def test_modulo(spark):
    df = spark.createDataFrame([(0,), (3,), (20,), (21,)], "height long")
    run = lambda m: [r[0] for r in df.orderBy("height").select(filters.BlockFilter(m).column()).collect()]
    assert run(10) == [True, False, True, False] and run(0) == run(None) == [True] * 4


def test_height_map(spark):
    m = spark.createDataFrame([(1, "a"), (10, "b"), (20, "c")], "start_height long, value string")
    h = spark.createDataFrame([(x,) for x in (0, 1, 9, 10, 19, 20, 5000)], "height long")
    assert [r[1] for r in heightmap.as_of(h, m, bucket=7).orderBy("height").collect()] == [None, "a", "a", "b", "b", "c", "c"]
    with pytest.raises(Exception, match="no entry in force"):
        heightmap.as_of(h, m, strict=True).collect()
    within = lambda a, b: sorted(r[0] for r in heightmap.within(m, a, b).collect())
    assert within(12, 18) == [10] and within(5, 25) == [1, 10, 20] and within(10, 15) == [1, 10] and within(25, 30) == []
    assert heightmap.as_of(h.limit(0), m).count() == 0


def decision(spark, rows):
    df = spark.createDataFrame(rows, "height long, matches boolean")
    return tuple(lineage.common_ancestor(df).first())


def test_reorg_decisions(spark):
    assert decision(spark, [(100, True), (99, True)]) == ("canonical", None, 0)
    assert decision(spark, [(100, False), (99, True)]) == ("rewind", 99, 1)
    assert decision(spark, [(103, False), (102, False), (101, False), (100, True)]) == ("rewind", 100, 3)
    assert decision(spark, [(99, False), (98, False)]) == ("beyond_history", 98, 0)
    assert decision(spark, []) == ("canonical", None, 0)


def test_journal_rules():
    a = lineage.Header(10, "0xa")
    assert lineage.check_append(None, a) and lineage.check_append(a, lineage.Header(11, "0xb", "0xa")) and not lineage.check_append(a, a)
    for bad in (lineage.Header(11, "0xb", "0xz"), lineage.Header(12, "0xb", "0xa"), lineage.Header(11, "0xb"), lineage.Header(11, ""), lineage.Header(10, "0xc")):
        with pytest.raises(LineageError):
            lineage.check_append(a, bad)


@pytest.mark.parametrize("args,want", [
    ((100, 1000, 10), (100, 109)), ((100, 102, 100), (100, 102)), ((101, 100, 10), None), ((100, 100, 10), (100, 100)), ((100, 1000, 0), None),
    ((100, 1000, 20, None, [(105, 110)]), (100, 104)), ((100, 1000, 10, None, [(100, 110)]), (111, 120)), ((100, 1000, 10, None, [(100, 105), (106, 110)]), (111, 120)), ((100, 150, 10, None, [(100, 200)]), None), ((5, 50, 10, 8), (5, 8)),
])
def test_next_batch(spark, args, want):
    assert planning.next_batch(*args) == want
    cursor, head, size, end, bypass = (*args, None, [])[:5] if len(args) == 3 else (*args, [])[:5]
    row = planning.plan_batches(spark.createDataFrame([(cursor, head, size, end)], "cursor long, head long, size long, end long"), bypass).first()
    assert ((row["start"], row["last"]) if row["start"] is not None else None) == want


def test_budget_and_head():
    assert planning.budget(50, 100, 10, 90) == 0 and planning.budget(50, 100, 10, 80) == 0 and planning.budget(8, 200, 0, 0) == 8 and planning.budget(50, 100, 90, 5) == 5
    assert [planning.safe_head(1000, 900, True), planning.safe_head(1000, 900, False), planning.safe_head(1000, 0, False), planning.safe_head(500, 900, False)] == [1000, 900, 0, 500]
    with pytest.raises(ValueError):
        planning.budget(0, 1, 0, 0)


def test_every_arrival_order_releases_alike(spark):
    rows = [(n, p, 1, h) for n, order in enumerate(itertools.permutations([100, 101, 102, 103])) for p, h in enumerate(order)]
    for n in (0, 7, 13, 23):
        own = spark.createDataFrame([r[1:] for r in rows if r[0] == n], "arrival_pos long, generation long, height long")
        got = [tuple(r) for r in ordered.release_order(own, 100, 1).orderBy("height").collect()]
        seen = {r[3]: r[1] for r in rows if r[0] == n}
        assert got == [(h, max(seen[x] for x in range(100, h + 1))) for h in range(100, 104)]


def test_stale_generations_and_gaps(spark):
    own = spark.createDataFrame([(0, 1, 101), (1, 2, 105), (2, 2, 107), (3, 1, 100)], "arrival_pos long, generation long, height long")
    assert tuple(ordered.stall_gap(own, 100, 2).first()) == (100, 105)
    assert ordered.release_order(own, 100, 2).count() == 0
    assert [tuple(r) for r in ordered.release_order(own, 100, 1).orderBy("height").collect()] == [(100, 3), (101, 3)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 300), max_size=120), st.sampled_from([1, 7, 4096]))
def test_islands(spark, heights, bucket):
    got = [tuple(r) for r in ordered.islands(spark.createDataFrame([(h,) for h in heights], "height long"), bucket=bucket).orderBy("start").collect()]
    want = []
    for h in sorted(heights):
        if want and want[-1][1] == h - 1:
            want[-1][1] = h
        else:
            want.append([h, h])
    assert got == [(a, b, b - a + 1) for a, b in want]


def test_rewind_of_versions(spark):
    v = spark.createDataFrame([("A", "1", "x", 90, 105), ("A", "1", "y", 105, None), ("A", "2", "z", 95, 98)], "entity string, id string, data string, valid_from long, valid_to long")
    assert sorted(tuple(r)[2:] for r in changelog.rewound(v, 100).collect()) == [("x", 90, None), ("z", 95, 98)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_rewind_and_replay_equals_a_clean_run(spark, data):
    op = st.tuples(st.sampled_from(["Set", "Remove"]), st.sampled_from("abc"), st.integers(0, 9))
    chain = lambda low: [(h, 0, i, o, "A", k, str(v)) for h in range(low, 8) for i, (o, k, v) in enumerate(data.draw(st.lists(op, max_size=3)))]
    schema = "height long, handler_seq long, op_seq long, op string, entity string, id string, data string"
    common, fork = chain(0), data.draw(st.integers(0, 7))
    other = [r for r in common if r[0] <= fork] + chain(fork + 1)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    kept = changelog.rewound(changelog.versions(frame(common)), fork)
    clean_at_fork = changelog.versions(frame([r for r in common if r[0] <= fork]))
    assert sorted(map(str, kept.collect())) == sorted(map(str, clean_at_fork.collect()))
    state = {}
    for h, _, _, o, _, k, v in other:
        state[k] = v if o == "Set" else None
    got = {r["id"]: r["data"] for r in changelog.compact(frame(other)).collect()}
    assert got == {k: v for k, v in state.items() if v is not None}
    assert {r["id"]: r["data"] for r in changelog.as_of(changelog.versions(frame(other)), 100).collect()} == got


def test_upsert_nulls_missing_fields(spark):
    old = spark.createDataFrame([("1", 7, "r"), ("2", 8, "s")], "id string, amount long, recipient string")
    new = spark.createDataFrame([("1", 42), ("3", 1)], "id string, amount long")
    assert sorted(map(tuple, changelog.upserted(old, new).collect())) == [("1", 42, None), ("2", 8, "s"), ("3", 1, None)]
    only_id = spark.createDataFrame([("1",)], "id string")
    assert changelog.upserted(only_id, only_id).count() == 1


def test_entity_reads(spark):
    df = spark.createDataFrame([(1, "b", None), (2, None, 1), (3, "a", 2), (4, "b", 2)], "id long, name string, n long")
    assert [r[0] for r in entities.page(df, "name").collect()] == [3, 1, 4, 2] and [r[0] for r in entities.page(df, "name", True, 2, 1).collect()] == [1, 4]
    assert [r[0] for r in entities.by_fields(df, ("n", "ne", 1)).collect()] == [3, 4] and entities.by_fields(df, ("n", "eq", None)).count() == 0
    assert [r[0] for r in entities.by_fields(df, ("n", "not_in", [1]), ("name", "eq", "b")).collect()] == [4]
    for bad in (lambda: entities.by_fields(df, ("x", "eq", 1)), lambda: entities.page(df, "x; drop"), lambda: entities.by_fields(df, ("n", "like", 1))):
        with pytest.raises(ValueError):
            bad()


def test_checkpoint_rows(spark):
    kv = lambda rows: spark.createDataFrame(rows, "key string, value string")
    assert metadata.checkpoint(kv([("project_id", "p")])).count() == 0
    assert tuple(metadata.checkpoint(kv([("indexed_height", "5"), ("indexed_block_hash", "0xa"), ("finalized_height", "4")])).first()) == (5, "0xa", 4)
    with pytest.raises(Exception, match="incomplete checkpoint"):
        metadata.checkpoint(kv([("indexed_height", "5")])).collect()


def raw_block(**change):
    h = "0x" + "ab" * 32
    tx = {"hash": "0x" + "cd" * 32, "blockHash": h, "blockNumber": "0x2", "transactionIndex": "0x0", "from": "0x" + "11" * 20, "to": None, "value": hex((1 << 256) - 1), "input": "0x"} | change
    return [("0x2", h, "0x" + "00" * 32, "0x10", [tx])]


def test_decode(spark):
    schema = "number string, hash string, parentHash string, timestamp string, transactions array<struct<hash:string,blockHash:string,blockNumber:string,transactionIndex:string,from:string,to:string,value:string,input:string>>"
    rows = decode.transactions(spark.createDataFrame(raw_block(), schema)).collect()
    assert rows[0]["ok"] and rows[0]["to"] is None and rows[0]["value"] == str((1 << 256) - 1)
    for bad in ({"blockHash": "0x" + "00" * 32}, {"transactionIndex": "0x1"}, {"blockNumber": "0x3"}, {"value": "0x01"}, {"to": "0x12"}, {"input": "0x1"}):
        assert not decode.transactions(spark.createDataFrame(raw_block(**bad), schema)).first()["ok"], bad
    head = decode.checked_header(spark.createDataFrame(raw_block(), schema).withColumn("requested", F.lit(2))).first()
    assert head["height"] == 2 and head["timestamp"] == datetime.datetime.fromtimestamp(16, datetime.timezone.utc).replace(tzinfo=None)
    with pytest.raises(Exception, match="not the requested"):
        decode.checked_header(spark.createDataFrame(raw_block(), schema).withColumn("requested", F.lit(3))).collect()


def test_quarantine_takes_whole_blocks(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "height long, x string")
    faults = spark.createDataFrame([(1, "bad log")], "height long, reason string")
    good, side = decode.accepted(rows, faults, "quarantine")
    assert [r["x"] for r in good.collect()] == ["c"] and side.count() == 1
    with pytest.raises(Exception, match="bad log"):
        decode.accepted(rows, faults)[0].collect()
