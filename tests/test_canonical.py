"""Golden values and properties of the canonical texts, against plain Python."""

import unicodedata
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import canonical as C
from siltstone.functions import exact
from siltstone.types import CollectionDefinition, EngineError, Field, canonical_instant, instant_key


@pytest.mark.parametrize(
    ("x", "text"),
    [(1e21, "1e+21"), (1e20, "100000000000000000000"), (5e-324, "5e-324"), (1e-7, "1e-7"), (1e-6, "0.000001"), (-0.1, "-0.1"), (-0.0, "0"), (2**53, "9007199254740992"), (123456789.123, "123456789.123"), (2e23, "2e+23"), (7, "7")],
)
def test_js_number(x, text):
    assert C.js_number(x) == text


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_js_number_round_trips(x):
    assert float(C.js_number(x)) == x


def test_canonical_json_orders_keys_by_bytes():
    assert C.canonical_json({"b": [1.0, None, True], "a": "é\n", "\uffff": 1, "😀": 2}) == '{"a":"é\\n","b":[1,null,true],"\uffff":1,"😀":2}'
    with pytest.raises(EngineError):
        C.canonical_json("\ud800")


def test_pointer():
    doc = {"a": [10, {"b/c": 1, "~": None}], "": 5}
    assert C.pointer(doc, "/a/1/b~1c") == 1 and C.pointer(doc, "/a/1/~0") is None and C.pointer(doc, "/") == 5 and C.pointer(doc, "") is doc
    for bad in ("a", "/a/01", "/a/2", "/a/-", "/x", "/a/~2", "/__class__"):
        assert C.pointer(doc, bad) is C.MISSING


def test_instants():
    assert canonical_instant("2016-12-31T23:59:60.500Z") == "2016-12-31T23:59:60.5Z"
    assert canonical_instant("2024-02-29T00:00:00.000Z") == "2024-02-29T00:00:00Z"
    for bad in ("2023-02-29T00:00:00Z", "2015-12-31T23:59:60Z", "2024-01-01T24:00:00Z", "2024-01-01 00:00:00Z", "0000-01-01T00:00:00Z", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.Z"):
        with pytest.raises(EngineError):
            canonical_instant(bad)
    keys = [instant_key(x) for x in ("2016-12-31T23:59:59Z", "2016-12-31T23:59:59.9999999Z", "2016-12-31T23:59:60Z", "2016-12-31T23:59:60.5Z", "2017-01-01T00:00:00Z")]
    assert keys == sorted(keys)


def test_instant_columns(spark):
    rows = [("2016-12-31T23:59:60Z",), ("2024-01-01T00:00:00.1234569Z",), ("2024-01-01T00:00:00Z",), (None,)]
    got = spark.createDataFrame(rows, "x string").select(C.instant_sort_key(F.col("x")).alias("k"), F.date_format(C.instant_timestamp(F.col("x")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).collect()
    assert [tuple(r) for r in got] == [("2016-12-31T23:59:60", "2016-12-31 23:59:59.999999"), ("2024-01-01T00:00:00.1234569", "2024-01-01 00:00:00.123456"), ("2024-01-01T00:00:00", "2024-01-01 00:00:00.000000"), (None, None)]


def test_keys_and_tuples(spark):
    raw = "\u2003 e\u0301 x\ufeff\u3000"
    got = spark.createDataFrame([(raw, 3, None)], "a string, b long, c string").select(C.key_column(F.col("a")).alias("k"), C.unique_tuple([("string", F.col("a")), ("number", F.col("b"))]).alias("t"), C.unique_tuple([("string", F.col("c"))]).alias("none")).first()
    assert got.k == C.normal_key(raw) == "\u00e9 x\ufeff"
    assert got.t == C.encode_unique([("string", raw), ("number", 3)]) and got.none is None
    assert got.t.startswith(f"string:{len(unicodedata.normalize('NFC', raw).encode())}:")


def test_exact_sums_take_the_shortest_text(spark):
    xs = [0.1, 0.2, 0.3, 1e21, 5e-324, -2.5, 123456789.123, 2.0**53, None]
    rows = [("odd", x) for x in xs] + [("even", 0.1), ("even", 0.2), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    fast = {r.g: r.s for r in df.groupBy("g").agg(*exact.partial_sums(F.col("x"), "x")).select("g", exact.settled("x").alias("s")).collect()}
    slow = {r.g: r.total for r in exact.slow_sums(df, ["g"], "x").collect()}
    whole = exact._EXACT.create_decimal(0)
    for x in xs:
        whole = exact._EXACT.add(whole, Decimal(repr(x))) if x is not None else whole
    assert fast == {"odd": None, "even": "0.3", "none": "0"}
    assert slow == {"odd": exact.decimal_text(whole), "even": "0.3", "none": "0"}


@given(st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=20), st.integers(1, 1000))
def test_quotients_have_twenty_digits_half_away(xs, n):
    got = Decimal(exact.quotient(str(sum(xs)), n))
    assert abs(got * n - sum(xs)) <= abs(Decimal(sum(xs))) * Decimal("1e-19") + Decimal("1e-30") and len(got.normalize().as_tuple().digits) <= 20


def test_evolution_is_additive():
    one = CollectionDefinition("c", (Field("a", "string", required=True),))
    two = one.evolve((Field("a", "string", required=True), Field("b", "number", ready=False)))
    assert two.version == 2
    for fields in ((Field("a", "number", required=True),), (), (Field("a", "string", required=True), Field("b", "number", required=True, ready=False))):
        with pytest.raises(EngineError) as e:
            one.evolve(fields)
        assert e.value.code == "SCHEMA_BREAKING"
    with pytest.raises(EngineError) as e:
        two.ready("b", "number")
    assert e.value.code == "SCHEMA_CONFLICT"
