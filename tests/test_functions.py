import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from blockloom.functions import bignum, hexcols, keccak, naming


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_keccak_known_values():
    assert keccak.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak.event_topic("Transfer(address,address,uint256)") == "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert keccak.event_topic("Approval(address,address,uint256)") == "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"
    assert keccak.selector("transfer(address,uint256)") == "0xa9059cbb"


@pytest.mark.parametrize("name,table", [("MyEntity", "my_entities"), ("category", "categories"), ("box", "boxes"), ("status", "statuses"), ("person", "people"), ("Cow", "kine"), ("sheep", "sheep"), ("Matrix", "matrices"), ("wife", "wives"), ("Quiz", "quizzes"), ("Transfer", "transfers")])
def test_table_names(name, table):
    assert naming.table_name(name) == table


def test_underscore_and_identifiers():
    assert naming.underscore("HTTPServer") == "http_server" and naming.underscore("blockHeight") == "block_height"
    for bad in ("", "1a", "a-b", "a" * 64, "x;drop"):
        with pytest.raises(ValueError):
            naming.checked_identifier(bad)


def test_hex_equality(spark):
    assert column(spark, ["0xABCD", "abcd", "0xabcdef", "0xabce", None], lambda c: hexcols.equals(c, "0xabcd")) == [True, True, False, False, None]
    assert column(spark, ["0xA9059CBB00", "0xa905", None, ""], lambda c: hexcols.begins(c, "a9059cbb")) == [True, False, None, False]
    assert column(spark, ["0xa9"], lambda c: hexcols.begins(c, "0x")) == [False]


def test_quantities(spark):
    got = column(spark, ["0x0", "0x1f", "0x01", "0x", "1f", "0x7fffffffffffffff", "0x8000000000000000", "0x1ffffffffffffffff", None, "0xG"], hexcols.quantity)
    assert got == [0, 31, None, None, None, (1 << 63) - 1, None, None, None, None]


def test_bytes(spark):
    assert column(spark, ["0xABcd", "abcd", None], lambda c: hexcols.from_binary(hexcols.to_binary(c))) == ["abcd", "abcd", None]
    with pytest.raises(Exception, match="hexadecimal"):
        column(spark, ["0xzz"], hexcols.to_binary)
    assert column(spark, ["0x" + "A" * 64, "0x" + "a" * 63], hexcols.hash32) == ["0x" + "a" * 64, None]


def test_256_bit_sums_and_hex(spark):
    rnd = random.Random(1)
    values = [rnd.getrandbits(rnd.choice([1, 64, 200, 256])) for _ in range(300)] + [(1 << 256) - 1] * 3 + [0]
    rows = spark.createDataFrame([(str(v), hex(v)) for v in values] + [(None, None)], "v string, h string")
    assert rows.agg(bignum.total(F.col("v"))).first()[0] == str(sum(values))
    got = rows.select(bignum.from_hex(F.col("h"))).collect()
    assert [r[0] for r in got] == [*map(str, values), None]
    a, b = values[:150], values[150:300]
    rows = spark.createDataFrame([(str(x), str(y)) for x, y in zip(a, b)], "a string, b string")
    got = rows.select(bignum.difference(F.col("a"), F.col("b")), bignum.sort_key(F.col("a")) < bignum.sort_key(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(str(x - y), x < y) for x, y in zip(a, b)]
    assert rows.limit(0).agg(bignum.total(F.col("a"))).first()[0] == "0"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ABCabc019-_", max_size=12))
def test_underscore_is_lower_case_and_stable(text):
    once = naming.underscore(text)
    assert once == once.lower() and naming.underscore(once) == once
