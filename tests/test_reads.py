"""Predicates, pages and aggregates against plain Python over a small edge fixture."""

import itertools
import zoneinfo
from datetime import UTC, datetime, timedelta
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from siltstone.functions import timebuckets
from siltstone.operators import records
from siltstone.operators.aggregate import Key, Metric, Spec, aggregated, evaluate
from siltstone.operators.pages import Cursors, Sort, page
from siltstone.operators.predicates import admit, condition, where
from siltstone.operators.projection import drift, project, require_complete
from siltstone.types import CollectionDefinition, EngineError, Field

DEF = CollectionDefinition("edges", (Field("team", "string"), Field("score", "number"), Field("active", "boolean"), Field("at", "date-time")))
TEAMS = ['"red"', '"blue"', '"Ä"', '"a"', "null", None]
SCORES = ["0.1", "0.2", "-2.5", "1e21", "123456789.123", "7", "null", None]
INSTANTS = ['"2026-03-08T06:59:59.9999999Z"', '"2026-03-08T07:00:00Z"', '"2026-11-01T05:30:00Z"', '"2026-11-01T06:30:00Z"', '"2016-12-31T23:59:60.5Z"', '"2027-01-03T23:00:00Z"', None]


def documents():
    """Every 7th or so of the combinations, each with an id."""
    out = []
    for n, (t, s, a, i) in enumerate(itertools.product(TEAMS, SCORES, ["true", "false", "null", None], INSTANTS)):
        if n % 5 == 0:
            out.append((f"rec_{n:05d}", "{" + ",".join(f'"{k}":{v}' for k, v in (("team", t), ("score", s), ("active", a), ("at", i)) if v is not None) + "}"))
    return out


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame(documents(), "record_id string, canonical_data string").withColumn("created_at", F.timestamp_seconds(F.substring("record_id", 5, 5).cast("long") % 50).cast("timestamp_ntz")).withColumn("n_bytes", F.octet_length("canonical_data"))
    return project(df, DEF).cache()


def plain():
    import json

    return {k: json.loads(d, parse_float=lambda x: x, parse_int=lambda x: x) for k, d in documents()}


def kind(d, f):
    return "missing" if f not in d else "null" if d[f] is None else DEF.field(f).kind


def test_projection_tells_null_from_missing(edges):
    got = {r.record_id: r for r in edges.collect()}
    for k, d in plain().items():
        for f in ("team", "score", "active", "at"):
            assert got[k][f"{f}__kind"] == kind(d, f)
            if kind(d, f) == "string":
                assert got[k][f"{f}__val"] == d[f]
            if kind(d, f) == "number":
                assert got[k][f"{f}__val"] == float(d[f])


def test_projection_flags_other_types(spark):
    df = project(spark.createDataFrame([("r", '{"team":1,"score":"x"}'), ("s", "not json")], "record_id string, canonical_data string"), DEF)
    assert [r.team__kind for r in df.orderBy("record_id").collect()] == ["other", "missing"]
    with pytest.raises(EngineError):
        require_complete(df, list(DEF.fields))


def ids(df):
    return {r.record_id for r in df.select("record_id").collect()}


def p(f, k, o, v=None):
    return {"field": f, "kind": k, "operator": o} | ({} if o == "isNull" else {"value": v})


def test_predicates(edges):
    docs = plain()
    number = lambda d: kind(d, "score") == "number"
    assert ids(where(edges, [p("score", "number", "gte", 0.2)], DEF)) == {k for k, d in docs.items() if number(d) and float(d["score"]) >= 0.2}
    assert ids(where(edges, [p("score", "null", "isNull")], DEF)) == {k for k, d in docs.items() if kind(d, "score") == "null"}
    assert ids(where(edges, [p("team", "string", "in", ["red", "Ä"])], DEF)) == {k for k, d in docs.items() if d.get("team") in ("red", "Ä")}
    assert ids(where(edges, [p("team", "string", "gt", "red")], DEF)) == {k for k, d in docs.items() if kind(d, "team") == "string" and d["team"].encode() > b"red"}
    assert ids(where(edges, [p("at", "date-time", "gt", "2016-12-31T23:59:59.9Z"), p("at", "date-time", "lt", "2017-01-01T00:00:00Z")], DEF)) == {k for k, d in docs.items() if d.get("at") == "2016-12-31T23:59:60.5Z"}
    assert ids(where(edges, [p("at", "date-time", "eq", "2026-03-08T07:00:00.000Z")], DEF)) == {k for k, d in docs.items() if d.get("at") == "2026-03-08T07:00:00Z"}


def test_admission_refuses_what_the_grammar_lacks():
    for bad in ([p("a", "string", "like", "x")], [p("a", "string", "eq", 1)], [p("a", "number", "eq", True)], [p("a", "number", "in", [])], [p("a", "string", "isNull")], [p("a", "number", "eq", 1)] * 17, [p("a", "number", "eq", float("nan"))], [{"field": "a"}], "x"):
        with pytest.raises(EngineError) as e:
            admit(bad)
        assert e.value.code == "INVALID_ARGUMENT"
    for bad in ([p("nope", "string", "eq", "x")], [p("team", "number", "eq", 1)]):
        with pytest.raises(EngineError) as e:
            condition(bad, DEF)
        assert e.value.code == "SCHEMA_CONFLICT"


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_join_up_to_the_whole_order(edges, direction):
    docs = plain()
    rank = {"missing": 0, "null": 1, "number": 2}
    order = sorted(docs, key=lambda k: (rank[kind(docs[k], "score")], float(docs[k]["score"]) if kind(docs[k], "score") == "number" else 0), reverse=direction == "desc")
    order = [k for _, g in itertools.groupby(order, key=lambda k: (kind(docs[k], "score"), docs[k].get("score"))) for k in sorted(g)]
    seen, last = [], None
    while True:
        rows = page(edges, Sort("score", "number", direction), last, 70).orderBy("position").collect()
        seen += [r.record_id for r in rows]
        if not rows or not rows[0].more:
            break
        r = rows[-1]
        last = (rank[r.score__kind], r.score__val, r.record_id)
    assert seen == order


def test_page_bytes_always_take_one(edges):
    assert page(edges, max_bytes=1).count() == 1
    rows = page(edges, max_bytes=300).orderBy("position").collect()
    assert sum(r.n_bytes for r in rows) <= 300 and rows[0].more


def test_pages_are_a_top_k(edges, spark):
    plan = page(edges, Sort("score", "number"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_cursors():
    now = [1000.0]
    c = Cursors(b"k", clock=lambda: now[0])
    token = c.issue({"q": 1}, [2, "x"])
    assert c.read({"q": 1}, token) == (2, "x")
    for scope, t in (({"q": 2}, token), ({"q": 1}, "A" + token[1:]), ({"q": 1}, "?")):
        with pytest.raises(EngineError):
            c.read(scope, t)
    now[0] += 901
    with pytest.raises(EngineError):
        c.read({"q": 1}, token)


def test_aggregate_against_plain_python(edges):
    docs = plain()
    out = evaluate(edges, Spec(group_by=(Key("team"),), metrics=(Metric("count"), Metric("sum", "score"), Metric("avg", "score"), Metric("max", "at")), max_groups=10), DEF)
    assert [(g["key"][0]["kind"], g["key"][0]["value"]) for g in out["groups"]] == [("string", x) for x in sorted(["red", "blue", "Ä", "a"], key=str.encode)] + [("null", None), ("missing", None)]
    for g in out["groups"]:
        mine = [d for d in docs.values() if kind(d, "team") == g["key"][0]["kind"] and d.get("team") == g["key"][0]["value"]]
        numbers = [Decimal(d["score"]) for d in mine if kind(d, "score") == "number"]
        assert g["count"] == len(mine) and Decimal(g["metrics"][1]["value"]) == sum(numbers) and g["metrics"][1]["values"] == len(numbers)
        assert g["metrics"][1]["missing"] == sum(kind(d, "score") == "missing" for d in mine)
        assert g["metrics"][3]["value"] == "2027-01-03T23:00:00Z"
    assert out["complete"] is True


def test_sums_are_exact_whatever_the_keys_and_magnitudes(spark):
    definition = CollectionDefinition("m", (Field("g", "number"), Field("s", "string"), Field("x", "number")))
    values = {1e14: [1e14, 1e-5, 0.1], 2.5: [0.1, 0.2], -0.0: [1e300, -1e300, 1.7976931348623157e308, 5e-324], 7.0: [12345678901234567.0, 0.30000000000000004], None: [1e14, 1e-5]}
    rows = [("null" if k is None else "number", k, "string", s, "number", float(x)) for k, xs in values.items() for x in xs for s in ("a", "b")]
    df = spark.createDataFrame(rows, "g__kind string, g__val double, s__kind string, s__val string, x__kind string, x__val double")
    metrics = (Metric("count"), Metric("sum", "x"), Metric("avg", "x"))
    exact = lambda xs: sum((Fraction(Decimal(repr(x))) for x in xs), Fraction(0))
    for keys in ((Key("g"),), (Key("s"), Key("g")), (Key("s"),), ()):
        out = evaluate(df, Spec(group_by=keys, metrics=metrics), definition)
        seen = 0
        for g in out["groups"]:
            told = dict(zip([k.field for k in keys], [k["value"] for k in g["key"]], strict=True))
            mine = [r[5] for r in rows if ("g" not in told or r[1] == told["g"]) and ("s" not in told or r[3] == told["s"])]
            seen += len(mine)
            assert g["count"] == len(mine) and Fraction(Decimal(g["metrics"][1]["value"])) == exact(mine)
            mean = Fraction(Decimal(g["metrics"][2]["value"]))
            assert mean == 0 or abs(mean - exact(mine) / len(mine)) <= abs(mean) * Fraction(1, 10**19)
        assert seen == len(rows)
    with pytest.raises(Exception, match="INEXACT"):
        aggregated(df, Spec(group_by=(Key("g"),), metrics=metrics), definition).collect()
    assert all(r.x_sum is not None for r in aggregated(df, Spec(group_by=(Key("g"),), metrics=metrics), definition, "exact").collect())


def test_group_caps_are_errors(edges):
    with pytest.raises(EngineError) as e:
        evaluate(edges, Spec(group_by=(Key("team"),), max_groups=3), DEF)
    assert (e.value.code, e.value.limit) == ("BACKPRESSURE", "groups")
    for spec in (Spec(group_by=(Key("at"),)), Spec(group_by=(Key("team", "day"),)), Spec(metrics=(Metric("sum", "team"),)), Spec(max_groups=1001), Spec(group_by=(Key("at", "day", "EST"),))):
        with pytest.raises(EngineError):
            evaluate(edges, spec, DEF)


def test_ungrouped_empty_is_one_group(edges):
    out = evaluate(edges, Spec((p("team", "string", "eq", "none"),), metrics=(Metric("count"), Metric("sum", "score"), Metric("avg", "score"))), DEF)
    assert out["groups"] == [{"key": [], "count": 0, "metrics": [{"value": 0}, {"value": "0", "values": 0, "nulls": 0, "missing": 0}, {"value": None, "values": 0, "nulls": 0, "missing": 0}]}]


ZONES = ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Pacific/Kiritimati", "Asia/Kolkata", "UTC", "America/Havana", "America/Santiago"]


def start_of(ts: datetime, unit: str, zone: str) -> datetime:
    z = zoneinfo.ZoneInfo(zone)
    local = ts.astimezone(z)
    if unit == "hour":
        offset = local.utcoffset()
        return (local.replace(tzinfo=None).replace(minute=0, second=0, microsecond=0) - offset).replace(tzinfo=UTC)
    day = local.replace(tzinfo=None, hour=0, minute=0, second=0, microsecond=0)
    day = {"day": day, "week": day - timedelta(days=day.weekday()), "month": day.replace(day=1), "quarter": day.replace(month=(day.month - 1) // 3 * 3 + 1, day=1), "year": day.replace(month=1, day=1)}[unit]
    a, b = (day.replace(tzinfo=z, fold=f).astimezone(UTC) for f in (0, 1))
    if a.astimezone(z).replace(tzinfo=None) != day:  # skipped: the first instant after
        return max(a, b)
    return b


@pytest.mark.parametrize("zone", ZONES)
def test_buckets_against_zoneinfo(spark, zone):
    base = [datetime(2026, m, d, h, 29, 59, tzinfo=UTC) for m, d in ((3, 7), (3, 8), (3, 29), (4, 4), (4, 5), (9, 5), (9, 6), (10, 3), (10, 4), (10, 25), (10, 31), (11, 1), (12, 31)) for h in range(24)]
    df = spark.createDataFrame([(int(t.timestamp()),) for t in base], "s long").withColumn("t", F.timestamp_seconds("s"))
    got = df.select("s", *[F.unix_seconds(timebuckets.bucket(F.col("t"), u, zone)).alias(u) for u in ("hour", "day", "week", "month", "quarter", "year")]).collect()
    for r in got:
        t = datetime.fromtimestamp(r.s, UTC)
        for u in ("hour", "day", "week", "month", "quarter", "year"):
            assert r[u] == int(start_of(t, u, zone).timestamp()), (zone, u, t)


def test_labels_tell_seconds_and_years(spark):
    instants = ["1880-05-01T05:00:00Z", "2024-07-01T04:00:00Z", "2024-01-01T00:00:00Z"]
    df = spark.createDataFrame([(t,) for t in instants], "t string").select("t", F.to_timestamp("t").alias("ts"))
    ny = {r.t: r.label for r in df.select("t", timebuckets.local_label(F.col("ts"), "America/New_York").alias("label")).collect()}
    assert ny == {instants[0]: "1880-05-01T00:03:58-04:56:02", instants[1]: "2024-07-01T00:00:00-04:00", instants[2]: "2023-12-31T19:00:00-05:00"}
    kolkata = df.select(timebuckets.local_label(F.col("ts"), "Asia/Kolkata").alias("x")).collect()[1].x
    assert kolkata == "2024-07-01T09:30:00+05:30"
    year = 365.2425 * 86400
    far = spark.createDataFrame([(int(-1970 * year - 3e7 + 1),), (int(8031 * year),), (int(-1971.5 * year),)], "s long").select(timebuckets.label(F.timestamp_seconds("s")).alias("x"))
    got = [r.x for r in far.collect()]
    assert got[1].startswith("+010001-") or got[1].startswith("+010000-"), got
    assert got[2].startswith("-000002-") or got[2].startswith("-000001-"), got


def test_instants_are_compared_as_timestamps_where_they_are_exact(spark):
    rows = [(f"r{i}", "date-time", f"2024-01-{i + 1:02d}T00:00:00Z") for i in range(9)] + [("n", "null", None)]
    df = spark.createDataFrame(rows, "record_id string, at__kind string, at__val string").withColumn("at__ts", F.to_timestamp("at__val"))
    p = [{"field": "at", "kind": "date-time", "operator": "gt", "value": "2024-01-04T00:00:00Z"}]
    text, stamped = where(df.drop("at__ts"), p), where(df, p)
    assert {r.record_id for r in text.collect()} == {r.record_id for r in stamped.collect()} == {"r4", "r5", "r6", "r7", "r8"}
    assert "at__ts" in stamped._jdf.queryExecution().optimizedPlan().toString()
    # A fraction finer than a microsecond is compared as text.
    fine = [p[0] | {"value": "2024-01-04T00:00:00.0000001Z"}]
    assert {r.record_id for r in where(df, fine).collect()} == {"r4", "r5", "r6", "r7", "r8"}


def test_zones():
    assert timebuckets.resolve("GMT") == "Etc/UTC"
    for bad in ("CET", "EST", "Mars/Base", "../etc", ""):
        with pytest.raises(EngineError):
            timebuckets.resolve(bad)


def test_drift(edges):
    changed = edges.filter("record_id <> 'rec_00005'").withColumn("team__val", F.when(F.col("record_id") == "rec_00010", "other").otherwise(F.col("team__val")))
    got = {(r.record_id, r.field, r.difference) for r in drift(edges, changed, ["team", "score"]).collect()}
    assert got == {("rec_00005", "team", "missing"), ("rec_00005", "score", "missing"), ("rec_00010", "team", "value")}


def test_filters_reach_the_scan(spark, tmp_path, edges):
    edges.select("team__kind", "team__val", "score__val").write.parquet(str(tmp_path / "p"))
    df = where(spark.read.parquet(str(tmp_path / "p")), [p("team", "string", "in", ["red", "a"])]).select("team__val")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(team__val" in plan and "score__val" not in plan


def test_partial_order_does_not_matter(edges):
    spec = Spec(group_by=(Key("active"), Key("at", "month", "UTC")), metrics=(Metric("count"), Metric("max", "score")))
    a = [tuple(r) for r in aggregated(edges, spec, DEF).collect()]
    assert a == [tuple(r) for r in aggregated(edges.repartition(7), spec, DEF).collect()]


def test_records_by_id_and_key(spark):
    rows = [(1, "c", "a", "g1", "Caf\u00e9", False), (1, "c", "b", "g2", "  x\u2003", False), (1, "c", "d", "g3", "x", True), (2, "c", "e", "g4", None, False), (1, "k", "f", "g5", "y", False), (1, "k", "h", "g6", "y ", False)]
    df = spark.createDataFrame(rows, "space_id int, collection_id string, record_id string, generated_key string, external_key string, tombstone boolean")
    ids = lambda found: sorted(r.record_id for r in found.collect())
    assert ids(records.live(df, 1, "c")) == ["a", "b"] and ids(records.get(df, "d")) == [] and ids(records.get(df, "d", True)) == ["d"]
    assert ids(records.by_key(df, "external", "Cafe\u0301 ")) == ["a"] and ids(records.by_key(df, "external", "x")) == ["b"] and ids(records.by_key(df, "generated", "g4")) == ["e"] and ids(records.by_key(df, "generated", "g3")) == []
    with pytest.raises(EngineError):
        records.by_key(df, "external", "y")
    assert records.viewed(df, "id").columns == ["record_id"]
    for bad in (lambda: records.by_key(df, "other", "x"), lambda: records.viewed(df, "all")):
        with pytest.raises(EngineError):
            bad()


def test_an_incomplete_projection_answers_nothing(spark):
    df = project(spark.createDataFrame([("a", '{"team":"red"}'), ("b", '{"team":3}')], "record_id string, canonical_data string"), DEF)
    with pytest.raises(EngineError):
        evaluate(df, Spec(group_by=(Key("team"),)), DEF)
    assert evaluate(df, Spec(group_by=(Key("active"),)), DEF)["groups"][0]["count"] == 2
