"""The change log, mutations and evidence against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import evidence, history, mutate, projection
from siltstone.streaming import feeds
from siltstone.types import CollectionDefinition, Field

DEF = CollectionDefinition(
    "tickets", (Field("label", "string", required=True), Field("score", "number", nullable=True), Field("state", "string", enum=("open", "closed"))), lifecycle="state", initial=("open", None), transitions={"open": ("closed",), None: ("open",)}
)


def test_fold_applies_requests_in_order(spark):
    rows = [
        ("a", 1, "create", '{"label":"x","state":"open"}', None, None, None), ("a", 2, "create", '{"label":"y"}', None, None, None), ("a", 3, "patch", None, '{"score":2}', ["state"], 1),
        ("a", 4, "patch", None, '{"score":"no"}', None, None), ("a", 5, "replace", '{"label":"z","state":"closed"}', None, None, 9), ("a", 6, "delete", None, None, None, 1), ("a", 7, "patch", None, '{"score":3}', None, None),
        ("b", 1, "patch", None, "{}", None, None), ("b", 2, "create", '{"label":"q","state":"closed"}', None, None, None), ("b", 3, "create", '{"label":"q","state":"open"}', None, None, None),
        ("b", 4, "patch", None, '{"state":"closed"}', None, 1), ("b", 5, "patch", None, '{"state":"open"}', None, None), ("b", 6, "delete", None, None, None, 2), ("b", 7, "create", '{"label":"r"}', None, None, None), ("b", 8, "create", "{", None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id string, ordinal long, operation string, data string, set string, unset array<string>, expected_revision long")
    got = {(r.record_id, r.ordinal): (r.outcome, r.revision, r.canonical_data) for r in mutate.fold(df, DEF).collect()}
    assert got["a", 1] == ("ok", 1, '{"label":"x","state":"open"}') and got["a", 2][0] == "CONFLICT"
    # Unsetting the state of an open ticket is no declared move.
    assert got["a", 3][0] == "SCHEMA_INVALID" and got["a", 4][0] == "SCHEMA_INVALID" and got["a", 5][0] == "REVISION_CONFLICT" and got["a", 6][:2] == ("ok", 2) and got["a", 7][0] == "NOT_FOUND"
    assert got["b", 1][0] == "NOT_FOUND" and got["b", 2][0] == "SCHEMA_INVALID" and got["b", 3][:2] == ("ok", 1) and got["b", 4] == ("ok", 2, '{"label":"q","state":"closed"}')
    assert got["b", 5][0] == "SCHEMA_INVALID" and got["b", 6][:2] == ("ok", 3) and got["b", 7][0] == "KEY_RESERVED" and got["b", 8][0] == "KEY_RESERVED"


@pytest.mark.parametrize(
    ("document", "code"),
    [({"label": "x"}, None), ({}, "SCHEMA_INVALID"), ({"label": None}, "SCHEMA_INVALID"), ({"label": "x", "score": None}, None), ({"label": "x", "extra": 1}, "SCHEMA_INVALID"), ({"label": "x", "state": "gone"}, "SCHEMA_INVALID"), ([], "SCHEMA_INVALID"), ({"label": "\ud800"}, "SCHEMA_INVALID")],
)
def test_check(document, code):
    assert mutate.check(document, DEF) == code


def test_uniques_receipts_batches(spark):
    df = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None), (5, "dead"), (6, "held"), (7, "m")], "ordinal long, t string")
    held = spark.createDataFrame([("dead", True), ("held", False)], "t string, tombstone boolean")
    assert [r.outcome for r in mutate.unique_outcomes(df, "t", held).orderBy("ordinal").collect()] == ["ok", "UNIQUE_CONFLICT", "ok", "ok", "KEY_RESERVED", "UNIQUE_CONFLICT", "ok"]
    calls = spark.createDataFrame([("c", "1", "x", 1), ("c", "1", "x", 2), ("c", "1", "y", 3), ("d", "1", "y", 4)], "who string, key string, digest string, n int")
    assert [r.outcome for r in mutate.receipts(calls, ["who", "key"], "digest", "n").orderBy("n").collect()] == ["applied", "replayed", "IDEMPOTENCY_MISMATCH", "applied"]
    items = spark.createDataFrame([(1, 2, "b", True), (1, 1, "a", False), (2, 1, "c", True)], "batch int, ordinal int, item string, good boolean")
    got = {r.batch: r for r in mutate.batch_status(items, "batch", F.col("good")).collect()}
    assert (got[1].succeeded, got[1].failed, got[1].retry, got[1].digest) == (1, 1, True, hashlib.sha256(b"a\nb").hexdigest()) and got[2].retry is False


def log(spark, n=400):
    rng, state, rows = random.Random(3), {}, []
    for position in range(1, n + 1):
        k = f"r{rng.randrange(40):03d}"
        revision = state.get(k, (0,))[0] + 1
        op = "create" if revision == 1 else rng.choice(["replace"] * 4 + ["delete"])
        rows.append((k, revision, position, op, rng.randrange(100)))
        state[k] = (revision, op)
    return rows, spark.createDataFrame(rows, "record_id string, revision long, position long, op string, v int").withColumn("schema_version", F.lit(1))


def test_as_of_is_the_live_state_then(spark):
    rows, df = log(spark)
    for mark in (0, 1, 57, 400):
        want = {}
        for k, revision, position, op, v in rows:
            if position <= mark and revision > want.get(k, (0,))[0]:
                want[k] = (revision, op, v)
        want = {k: (r, v) for k, (r, op, v) in want.items() if op != "delete"}
        assert {r.record_id: (r.revision, r.v) for r in history.as_of(df, mark, ["v"]).collect()} == want
    assert [r.position for r in history.feed(df, 350).collect()] == list(range(351, 401))
    assert tuple(history.freshness(df, 400, 1).first()) == (400, 0, "exact") and history.freshness(df, 399, 1).first().freshness == "stale"


def test_export_pages_hold_every_line_once(spark, tmp_path):
    rows = [(f"{i:04d}" if i % 2 else f'q"{i:04d}', i) for i in range(500)]
    df = spark.createDataFrame(rows, "record_id string, revision long").repartition(7)
    lines = history.export_lines(df, F.concat(F.lit('{"v":"'), F.expr("repeat('x', cast(revision as int))"), F.lit('"}')))
    out = f"file://{tmp_path}/pages"
    history.export_pages(lines, f"file://{tmp_path}/parts", max_rows=50, max_bytes=4000).write.parquet(out)
    pages = spark.read.parquet(out).orderBy("first_id").collect()
    text = "".join(p.body for p in pages)
    ordered = sorted(k for k, _ in rows)
    assert [json.loads(x)["id"] for x in text.splitlines()] == ordered
    seen = 0
    for i, p in enumerate(pages):
        assert p.rows <= 50 and p.bytes <= 4000 and p.sha256 == hashlib.sha256(p.body.encode()).hexdigest() and p.bytes == len(p.body.encode())
        following = pages[i + 1].body.splitlines(keepends=True)[0] if i + 1 < len(pages) else None
        seen += p.rows
        # A page ends with its fiftieth row, or because the next line would not fit.
        assert following is None or p.rows == 50 or p.bytes + len(following.encode()) > 4000
    m = history.manifest(spark.read.parquet(out)).first()
    assert m.digest == hashlib.sha256("".join(p.sha256 for p in pages).encode()).hexdigest() and m.rows == 500


def test_pages_as_of_join_up(spark):
    rows, df = log(spark)
    whole = {r.record_id: r.v for r in history.as_of(df, 300, ["v"]).collect()}
    got, after, more = {}, "", True
    while more:
        page = history.as_of_page(df, 300, ["v"], after, limit=7, max_bytes=60, size=F.lit(10), dead=True).orderBy("position").collect()
        live = [r for r in page if r.op != "delete"]
        # Records are taken until seven are, or those before have sixty bytes; the deleted have none.
        assert [r.position for r in page] == list(range(1, len(page) + 1)) and len(live) <= 6 and (len(page) == 7 or len(live) == 6 or not page[0].more)
        assert {r.record_id for r in live} == {r.record_id for r in history.as_of_page(df, 300, ["v"], after, limit=7, max_bytes=60, size=F.lit(10)).collect()}
        got |= {r.record_id: r.v for r in live}
        after, more = page[-1].cursor, page[0].more
    assert got == whole and list(got) == sorted(whole)
    first = history.as_of_page(df, 300, ["v"], "", 5, 1, F.lit(10), dead=True).orderBy("position").collect()
    assert [r.op == "delete" for r in first[:-1]] == [True] * (len(first) - 1)


def test_publication_goes_on_by_collection(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"c{min(rng.randrange(9), 3)}", rng.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "collection_id string, committed_at long, event_id long").repartition(6)
    got = {(r.collection_id, r.event_id): r.position for r in history.published(df, 10, f"file://{tmp_path}/p").collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((t, i) for k, t, i in rows if k == c)
        assert [got[c, i] for _, i in mine] == list(range(11, 11 + len(mine)))


def test_drift_is_counted_and_sampled(spark):
    rows = [(f"r{i:03d}", "number" if i % 3 else "null", float(i)) for i in range(300)]
    expected = spark.createDataFrame(rows, "record_id string, a__kind string, a__val double")
    actual = expected.filter("record_id <> 'r001'").withColumn("a__kind", F.when(F.col("record_id") == "r002", "null").otherwise(F.col("a__kind"))).withColumn("a__val", F.when(F.col("record_id") > "r100", -1.0).otherwise(F.col("a__val")))
    actual = actual.unionByName(spark.createDataFrame([("extra", "number", 1.0)], actual.schema))
    counts, sample = projection.reconciliation(projection.drift(expected, actual, ["a"]), spark.createDataFrame([("r200",)], "record_id string"))
    assert {r.difference: r.n for r in counts.collect()} == {"missing": 1, "unexpected": 1, "kind": 1, "value": 198, "underivable": 1} and sample.count() == 100


def test_claims_and_links(spark):
    claims = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "claim_id string")
    cites = spark.createDataFrame([("c1", 1), ("c1", 2), ("c2", 2), ("c2", 9)], "claim_id string, cited long")
    grants = spark.createDataFrame([("k", 1, ["sources.read"]), ("k", 2, ["sources.read", "x"]), ("k", 9, ["x"]), ("other", 9, ["sources.read"])], "credential string, collection_id long, capabilities array<string>")
    seen = evidence.visible_claims(claims, cites, evidence.readable(grants, "k", "sources.read"))
    assert {r.claim_id for r in seen.collect()} == {"c1", "c3"}
    links = spark.createDataFrame([("l1", "detach", "a", "b"), ("l2", "restrict", "c", "a2"), ("l3", "detach", "c", "d"), ("l4", "detach", "e", "e")], "link_id string, policy string, from_id string, to_id string")
    outcome, gone = evidence.delete_endpoints(links, spark.createDataFrame([("a",), ("c",), ("e",), ("z",)], "id string"))
    assert {r.id: (r.outcome, r.detached) for r in outcome.collect()} == {"a": ("ok", 1), "c": ("LINK_RESTRICTED", 0), "e": ("ok", 1), "z": ("ok", 0)}
    assert {r.link_id for r in gone.collect()} == {"l1", "l4"}


def test_extraction_is_strict(spark):
    rows = [(1, "text/plain", b"\xef\xbb\xbf\xef\xbb\xbfa\xc3\xa9"), (2, "text/plain", b"\xff"), (3, "application/pdf", b"x"), (4, "text/csv", None)]
    got = {r.source_id: r for r in evidence.extract_text(spark.createDataFrame(rows, "source_id long, mime string, content binary")).collect()}
    assert got[1].content == "\ufeffaé" and got[1].segments[0].asDict() == {"start": 0, "end": 3, "source_start": 3, "source_end": 9}
    assert got[2].code == "INVALID_TEXT" and got[3].code == "UNSUPPORTED" and got[4].content == ""


def test_stream_of_the_log_keeps_the_newest(spark, tmp_path):
    rows, df = log(spark)
    source, sink, marks = (str(tmp_path / x) for x in ("log", "sink", "marks"))
    df.drop("schema_version").repartition(5).write.parquet(source)
    for _ in range(2):  # started again, it has nothing left to do
        q = feeds.projected(feeds.feed_stream(spark, source, spark.read.parquet(source).schema, 2), sink, marks, ["record_id"])
        q.awaitTermination(120)
    want = {}
    for k, revision, _, op, v in rows:
        want[k] = (revision, op, v)
    assert {r.record_id: (r.revision, r.op, r.v) for r in feeds.current(spark, sink, ["record_id"]).collect()} == want


def test_backoff(spark):
    got = spark.range(10).select(feeds.backoff(F.col("id")).alias("w"), feeds.delivery_state(F.col("id"), F.col("id") == 9).alias("s")).collect()
    assert [r.w for r in got] == [5, 5, 10, 20, 40, 80, 160, 320, 640, 1280] and [r.s for r in got] == ["pending", *["degraded"] * 7, "dead-letter", "delivered"]
