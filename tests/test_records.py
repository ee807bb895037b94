"""Schema trees, stored uniques and receipts, facts, stateful folds, greedy pages: against plain versions and on their edges."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import evidence, facts, history, jobs, ledger, mutate, schemas, space_export
from siltstone.streaming import folds
from siltstone.types import CollectionDefinition, EngineError, Field

# -- schema trees ------------------------------------------------------------------------------------------


def tree(**properties):
    return {"$schema": schemas.DIALECT, "type": "object", "additionalProperties": False, "properties": properties}


def nested(depth):
    node = {"type": "string"}
    for _ in range(depth):
        node = {"type": "array", "items": node}
    return node


INNER = {"type": "object", "additionalProperties": False, "required": ["id"], "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 2}, "minItems": 1, "maxItems": 2}}}
WHOLE = tree(a={"type": "number", "minimum": 0, "maximum": 9}, s={"type": ["string", "null"], "minLength": 1}, t={"type": "string", "format": "date-time"}, o=INNER, l={"type": "array", "items": INNER}, e={"type": "integer", "enum": [1, 2]}, b={"type": "boolean"})


@pytest.mark.parametrize(
    ("document", "fault"),
    [
        ("{}", None), ('{"a":0,"s":null,"o":{"id":1},"l":[]}', None), ('{"a":9.5}', "/a"), ('{"a":-1e-9}', "/a"), ('{"a":"1"}', "/a"), ('{"a":true}', "/a"), ('{"a":null}', "/a"), ('{"s":""}', "/s"), ('{"s":"\\ud800"}', "/s"),
        ('{"s":"\\ud83d\\ude00"}', None), ('{"x":1}', "/x"), ('{"a/b~":1}', "/a~1b~0"), ('{"o":{}}', "/o/id"), ('{"o":{"id":1.0}}', None), ('{"o":{"id":1.5}}', "/o/id"), ('{"o":{"id":9007199254740993}}', "/o/id"), ('{"o":{"id":1e400}}', "/o/id"),
        ('{"o":{"id":1,"tags":[]}}', "/o/tags"), ('{"o":{"id":1,"tags":["ab","abc"]}}', "/o/tags/1"), ('{"l":[{"id":1},{"id":"1"}]}', "/l/1/id"), ('{"l":[null]}', "/l/0"), ('{"l":{}}', "/l"), ('{"e":3}', "/e"), ('{"e":2.0}', None), ('{"b":0}', "/b"),
        ('{"t":"2016-12-31T23:59:60Z"}', None), ('{"t":"2017-12-31T23:59:60Z"}', "/t"), ('{"t":"2024-01-01T00:00:00+00:00"}', "/t"), ("[]", ""), ("null", ""), ("{", ""), ('{"a":NaN}', ""), ('{"a":1,"a":1}', ""), ("[" * 5000 + "]" * 5000, ""), (None, ""),
    ],
)
def test_documents_are_checked_to_the_place_of_their_fault(document, fault):
    check = schemas.compiled(WHOLE)
    try:
        got = "" if document is None else check(schemas._parse(document))
    except (ValueError, RecursionError):
        got = ""
    assert got == fault


@pytest.mark.parametrize(
    "schema",
    [
        {"type": "object", "additionalProperties": False}, tree(x={"type": "null"}), tree(x={"type": ["string", "number"]}), tree(x={"type": ["array", "null"], "items": {"type": "string"}}), tree(x={"type": "array"}), tree(x={"type": "object"}),
        tree(x={"type": "string", "minimum": 1}), tree(x={"type": "number", "minimum": 2, "maximum": 1}), tree(x={"type": "string", "minLength": 2, "maxLength": 1}), tree(x={"type": "string", "format": "uri"}), tree(x={"type": "string", "pattern": "x"}),
        tree(x={"type": "integer", "enum": [1, "1"]}), tree(x={"type": "integer", "enum": []}), tree(x={"type": "integer", "enum": [1, 1.0]}), tree(x=nested(32)), tree(**{f"f{i}": {"type": "string"} for i in range(256)}), tree(**{"x" * 257: {"type": "string"}}),
        {**tree(x={"type": "string"}), "required": ["y"]}, {**tree(x={"type": "string"}), "required": ["x", "x"]}, tree(x={"type": "string", "$schema": schemas.DIALECT}), {**tree(), "type": "array", "items": {"type": "string"}},
    ],
)
def test_schemas_outside_the_subset_are_refused(schema):
    with pytest.raises(EngineError, match="SCHEMA_UNSUPPORTED"):
        schemas.admit(schema)


def test_schemas_at_the_bounds():
    schemas.admit(tree(x=nested(31)))
    schemas.admit(tree(**{f"f{i}": {"type": "string"} for i in range(255)}))
    assert schemas.spark_type(WHOLE).simpleString() == "struct<a:double,s:string,t:string,o:struct<id:bigint,tags:array<string>>,l:array<struct<id:bigint,tags:array<string>>>,e:bigint,b:boolean>"


def test_columns_of_documents(spark):
    rows = [(1, '{"l":[{"id":1,"tags":["a"]}]}', "x"), (2, '{"l":[{"id":1,"more":2}]}', "y"), (3, None, None), (4, "", "z")]
    got = schemas.checked(spark.createDataFrame(rows, "n int, doc string, other string"), "doc", WHOLE).collect()
    assert [(r.n, r.other, r.code, r.fault) for r in sorted(got)] == [(1, "x", None, None), (2, "y", "SCHEMA_INVALID", "/l/0/more"), (3, None, "SCHEMA_INVALID", ""), (4, "z", "SCHEMA_INVALID", "")]
    empty = schemas.checked(spark.createDataFrame([], "doc string"), "doc", WHOLE)
    assert empty.columns == ["doc", "code", "fault"] and empty.collect() == []


def test_evolution_adds_optional_fields_only():
    old = schemas.definition("c", WHOLE, filterable=("a", "s"), sortable=("a",), uniques=(("s",),))
    assert [(f.name, f.kind, f.nullable) for f in old.fields] == [("a", "number", False), ("s", "string", True)]
    more = tree(**{**WHOLE["properties"], "n": nested(3), "a": {**WHOLE["properties"]["a"], "description": "told now"}, "e": {"type": "integer", "enum": [2, 1]}})
    new = schemas.evolved(old, more, ("a", "s", "e"), ("a",))
    assert new.version == 2 and {f.name: f.ready for f in new.fields} == {"a": True, "s": True, "e": False} and new.uniques == old.uniques
    deeper = json.loads(json.dumps(WHOLE))
    deeper["properties"]["l"]["items"]["properties"]["tags"]["maxItems"] = 3
    for bad in (tree(**{k: v for k, v in WHOLE["properties"].items() if k != "b"}), deeper, {**more, "required": ["n"]}, {**WHOLE, "required": ["a"]}):
        with pytest.raises(EngineError, match="SCHEMA_BREAKING"):
            schemas.evolved(old, bad, ("a", "s"), ("a",))
    with pytest.raises(EngineError, match="SCHEMA_BREAKING"):
        schemas.evolved(old, more, ("a",), ("a",))
    for wrong in ({"filterable": ("o",)}, {"filterable": ("none",)}, {"lifecycle": "s"}):
        with pytest.raises(EngineError, match="SCHEMA_UNSUPPORTED"):
            schemas.definition("c", WHOLE, **wrong)


def test_mutations_under_a_tree(spark):
    schema = {**tree(state={"type": "string", "enum": ["new", "done"]}, o=INNER, s={"type": "string"}), "required": ["state"]}
    d = schemas.definition("c", schema, filterable=("state",), lifecycle="state", initial=("new",), transitions={"new": ("done",)})
    steps = [("create", '{"state":"new","o":{"id":"x"}}', None), ("create", '{"state":"new","o":{"id":1}}', None), ("patch", '{"o":{"id":2,"tags":["a"]}}', None), ("patch", '{"o":{"tags":["a"]}}', None), ("patch", "{}", ["state"]), ("patch", "{}", ["other"]), ("patch", '{"state":"done"}', ["s"]), ("patch", '{"state":"new"}', None)]
    rows = [("r", i, op, x if op == "create" else None, x if op == "patch" else None, unset) for i, (op, x, unset) in enumerate(steps)]
    out = mutate.fold(spark.createDataFrame(rows, "record_id string, ordinal long, operation string, data string, set string, unset array<string>"), d).orderBy("ordinal").collect()
    assert [r.outcome for r in out] == ["SCHEMA_INVALID", "ok", "ok", "SCHEMA_INVALID", "INVALID_ARGUMENT", "INVALID_ARGUMENT", "ok", "SCHEMA_INVALID"]
    assert out[6].canonical_data == '{"o":{"id":2,"tags":["a"]},"state":"done"}'


# -- facts and the ledger ----------------------------------------------------------------------------------


def test_a_repeated_append_leaves_what_is_committed(spark, tmp_path):
    store = facts.Store(f"file://{tmp_path}/facts")
    with pytest.raises(EngineError):
        store.read(spark, "a")
    one, other = spark.range(3), spark.range(100, 105)
    assert store.append({"a": one, "b": one}, 1) and not store.append({"a": other, "b": other}, 1)
    broken = other.select(F.raise_error(F.lit("stopped")).cast("long").alias("id"))
    # A repeat that stops half way, and an attempt at a new batch that does.
    assert not store.append({"a": other, "b": broken}, 1)
    with pytest.raises(Exception, match="stopped"):
        store.append({"a": other, "b": broken}, 2)
    assert sorted(r.id for r in store.read(spark, "a").collect()) == [0, 1, 2] and sorted(r.id for r in store.read(spark, "b").collect()) == [0, 1, 2]
    assert store.append({"a": other, "b": other}, 2)
    assert sorted(r.id for r in store.read(spark, "a").collect()) == [0, 1, 2, 100, 101, 102, 103, 104] and store.committed(spark, 2)


def plain_ledger(batches, ttl):
    receipts, keys, out = {}, {}, {}
    for now, requests, gone in batches:
        for t, r in gone:
            if keys.get(t, (None,))[0] == r:
                keys[t] = (r, True)
        for ordinal, identity, digest, t, record in requests:
            held = receipts.get(identity)
            if held and held[1] > now:
                out[ordinal] = ("replayed", held[2]) if held[0] == digest else ("IDEMPOTENCY_MISMATCH", None)
            elif t in keys:
                out[ordinal] = ("KEY_RESERVED" if keys[t][1] else "UNIQUE_CONFLICT", None)
            else:
                receipt = json.dumps({"record_id": record, "ordinal": ordinal}, separators=(",", ":"))
                out[ordinal] = ("applied", receipt)
                if identity is not None:
                    receipts[identity] = (digest, now + ttl, receipt)
                if t is not None:
                    keys[t] = (record, False)
    return out


def test_batches_against_stored_keys_and_receipts(spark, tmp_path):
    rng = random.Random(5)
    book = ledger.Ledger(f"file://{tmp_path}/ledger", buckets=4)
    kinds, batches, got = "ordinal long, identity string, digest string, tuple string, record_id string", [], {}
    for b in range(3):
        requests = [(100 * b + i, rng.choice([None, *"pqrst"]), rng.choice("xy"), rng.choice([None, *"klmnop"]), f"r{b}-{i}") for i in range(25)]
        held = [(r.tuple, r.record_id) for r in book.table(spark, "keys").collect()]
        gone = [*rng.sample(held, len(held) // 2), ("k", "another")] if held else []
        # Receipts of the first batch have expired by the third.
        batches.append((1000 + 60 * b, requests, gone))
        deleted = spark.createDataFrame(gone, "tuple string, record_id string")
        out = book.apply(spark.createDataFrame(rng.sample(requests, 25), kinds), b, 1000 + 60 * b, deleted, ttl=100)
        again = book.apply(spark.createDataFrame(requests[:3], kinds), b, 5000)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
        got |= {r.ordinal: (r.outcome, r.receipt) for r in out.collect()}
    want = plain_ledger(batches, 100)
    assert got == want and {x for x, _ in want.values()} >= {"applied", "replayed", "IDEMPOTENCY_MISMATCH", "UNIQUE_CONFLICT", "KEY_RESERVED"}
    assert book.apply(spark.createDataFrame([], kinds), 9, 0).collect() == []


def test_of_two_writers_one_commits(spark, tmp_path):
    book = ledger.Ledger(f"file://{tmp_path}/ledger", buckets=2)
    row = spark.createDataFrame([(1, "i", "d", "t", "r")], "ordinal long, identity string, digest string, tuple string, record_id string")
    decided = ledger.Ledger._decided

    def late(self, *args):
        ledger.Ledger._decided = decided
        book.apply(row, 7, 0)
        return decided(self, *args)

    ledger.Ledger._decided = late
    try:
        with pytest.raises(EngineError, match="CONFLICT"):
            book.apply(row.withColumn("record_id", F.lit("late")), 8, 0)
    finally:
        ledger.Ledger._decided = decided
    assert [tuple(r) for r in book.table(spark, "keys").collect()] == [("t", "r", False)]


# -- folds -------------------------------------------------------------------------------------------------


def test_a_stream_folds_as_a_batch_does(spark, tmp_path):
    rng = random.Random(2)
    definition = CollectionDefinition("c", (Field("v", "number", required=True), Field("w", "string")))
    rows = []
    for k in range(12):
        for n in range(rng.randrange(1, 12)):
            op = "create" if n == 0 and k % 4 else rng.choice(["create", "replace", "patch", "patch", "delete"] if rng.random() < 0.5 else ["patch"])
            data = json.dumps({"v": rng.choice([n, "text"])})
            rows.append((f"r{k}", n + 1, op, data, data if n % 3 else '{"w":"x"}', ["w"] if n % 5 == 0 else None, rng.choice([None, None, n])))
    made = spark.createDataFrame(rows, folds.REQUEST)
    want = mutate.fold(made.withColumnRenamed("sequence", "ordinal"), definition).withColumnRenamed("ordinal", "sequence")
    store, base = facts.Store(f"file://{tmp_path}/store"), f"file://{tmp_path}"
    shuffled = rng.sample(rows, len(rows)) + rng.sample(rows, len(rows) // 3)
    for i, part in enumerate(np.array_split(np.arange(len(shuffled)), 4)):
        spark.createDataFrame([shuffled[j] for j in part], folds.REQUEST).coalesce(2).write.mode("append").parquet(f"{base}/requests")
        if i % 2:  # a stop and a start between
            folds.run(folds.folded(folds.requests_from(spark, f"{base}/requests", 1), definition), store, "outcomes", f"{base}/checkpoint").awaitTermination()
    got = store.read(spark, "outcomes").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == len(rows)


def test_heads_go_forward_only(spark, tmp_path):
    kinds = "key string, generation long, revision long, requeue boolean"
    base, store = f"file://{tmp_path}", facts.Store(f"file://{tmp_path}/store")
    told = []
    for rows in ([("a", 1, 3, False), ("b", 1, 1, False)], [("a", 1, 2, False), ("a", 1, 3, True), ("b", 2, 1, False)], [("a", 1, 3, False), ("b", 1, 9, True), ("a", 1, 4, None)]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{base}/events")
        stream = spark.readStream.schema(kinds).parquet(f"{base}/events")
        folds.run(folds.delivered(stream), store, "heads", f"{base}/checkpoint").awaitTermination()
        whole = {tuple(r)[:3] + (r.requeue, r.state) for r in store.read(spark, "heads").collect()}
        told.append(whole - set().union(*told))
    assert told[0] == {("a", 1, 3, False, "deliver"), ("b", 1, 1, False, "deliver")}
    assert told[1] == {("a", 1, 2, False, "superseded"), ("a", 1, 3, True, "deliver"), ("b", 2, 1, False, "deliver")}
    assert told[2] == {("a", 1, 3, False, "superseded"), ("b", 1, 9, True, "superseded"), ("a", 1, 4, False, "deliver")}


# -- pages, cascades ---------------------------------------------------------------------------------------


def plain_pages(rows, max_rows, max_bytes):
    pages, page, size, entries = [], [], 0, 0
    for key, line in sorted(rows):
        n = len((line or "").encode())
        if entries == max_rows or size + n > max_bytes:
            pages.append(page)
            page, size, entries = [], 0, 0
        entries, size = entries + 1, size + n
        if line is not None:
            page.append((key, line))
    return [(p[0][0], len(p), sum(len(x.encode()) for _, x in p), hashlib.sha256("".join(x for _, x in p).encode()).hexdigest()) for p in [*pages, page] if p]


@pytest.mark.parametrize("case", ["rows", "bytes", "both", "few", "dead"])
def test_pages_are_cut_as_one_goes_on_after_another(spark, tmp_path, monkeypatch, case):
    monkeypatch.setattr(history, "RANGE_PAGES", 2)
    rng = random.Random(case)
    n, size = {"rows": (90, 3), "bytes": (120, 60), "both": (400, 40), "few": (3, 20), "dead": (90, 40)}[case]
    rows = [(f"k{rng.randrange(10**9)}é", None if case == "dead" and rng.random() < 0.7 or rng.random() < 0.1 else "x" * rng.randrange(1, size) + "ü\n") for _ in range(n)]
    rows = sorted(dict(rows).items())
    got = history.export_pages(spark.createDataFrame(rows, "record_id string, line string").repartition(5), f"file://{tmp_path}/p", 4, 150)
    assert sorted(tuple(r)[:4] for r in got.collect()) == plain_pages(rows, 4, 150)


def test_pages_of_twelve_lines_and_refusals(spark, tmp_path):
    lines = spark.createDataFrame([(f"k{i:02}", "x" * 49 + "\n") for i in range(12)], "record_id string, line string")
    assert [r.rows for r in history.export_pages(lines, f"file://{tmp_path}/a", 4, 150).orderBy("first_id").collect()] == [3, 3, 3, 3]
    with pytest.raises(EngineError, match="RESULT_TOO_LARGE"):
        history.export_pages(lines, f"file://{tmp_path}/b", 4, 49)
    none = spark.createDataFrame([], "record_id string, line string")
    assert history.export_pages(none, f"file://{tmp_path}/c", 4, 49).collect() == []
    log = spark.createDataFrame([(f"k{i}", 1, i + 1, "delete" if i == 1 else "create", "x" * 50) for i in range(6)], "record_id string, revision int, position long, op string, body string")
    size = F.octet_length("body")
    page = history.as_of_page(log, 100, ["body"], "", 5, 150, size).orderBy("record_id").collect()
    assert [r.record_id for r in page] == ["k0", "k2", "k3"] and {(r.more, r.cursor) for r in page} == {(True, "k3")}
    page = history.as_of_page(log, 100, ["body"], "", 3, 10**6, size).collect()
    assert sorted(r.record_id for r in page) == ["k0", "k2"]
    assert sorted(r.record_id for r in history.as_of_page(log, 100, ["body"], "k0", 1, 10, size, dead=True).collect()) == ["k1"]


def test_a_link_with_both_ends_deleted_goes_once(spark):
    links = spark.createDataFrame([("l1", "detach", "x", "y"), ("l2", "detach", "y", "z"), ("l3", "restrict", "z", "w"), ("l4", "detach", "z", "x"), ("l5", "detach", "y", "y")], "link_id string, policy string, from_id string, to_id string")
    for ids in itertools.permutations("xyzv"):
        outcome, gone = evidence.delete_endpoints(links, spark.createDataFrame([(i,) for i in ids], "id string"))
        assert {r.id: (r.outcome, r.detached) for r in outcome.collect()} == {"x": ("ok", 2), "y": ("ok", 2), "z": ("LINK_RESTRICTED", 0), "v": ("ok", 0)}
        assert sorted(r.link_id for r in gone.collect()) == ["l1", "l2", "l4", "l5"]
        break


def test_a_space_goes_out_and_comes_back(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for name in ("permissions", "sources", "records", "revisions"):
        for i in range(rng.randrange(1, 60)):
            rows.append((name, f"{i:04}", "".join(rng.choice("aé€😀 x") for _ in range(rng.choice([0, 3, 40, 900]))) + "\n"))
    made = lambda rows: spark.createDataFrame(rng.sample(rows, len(rows)), "section string, key string, line string").repartition(5)
    folder = f"file://{tmp_path}/export"
    told = space_export.export(made(rows), folder, f"file://{tmp_path}/placed", "exp_1", {"spaceId": "s"}, {"watermark": 9, "snapshotAt": "2024-01-01T00:00:00.000000Z"}, 128)
    m = space_export.verified(spark, folder, told["sha256"])
    for name in space_export.SECTIONS:
        assert space_export.section(spark, folder, name) == "".join(x for s, _, x in sorted(rows) if s == name)
    assert [s["name"] for s in m["sections"]] == list(space_export.SECTIONS) and max(p["bytes"] for p in m["parts"]) <= 128 and told["parts"] == len(m["parts"]) + 1
    assert sum(p["rows"] for p in m["parts"]) == len(rows)
    with pytest.raises(EngineError, match="manifest is not"):
        space_export.verified(spark, folder, "0" * 64)
    # A letter changed in one part, and a part that is gone.
    held = spark.read.schema(space_export._STORED).parquet(f"{folder}/parts")
    stored = held.collect()
    victim = next(r for r in stored if "a" in r.body)
    for kept in ([r if r != victim else (*victim[:4], victim.body.replace("a", "b", 1), victim.section) for r in stored], [r for r in stored if r != victim]):
        bad = f"file://{tmp_path}/bad{len(kept)}"
        spark.createDataFrame(kept, held.schema).write.partitionBy("section").parquet(f"{bad}/parts")
        facts.claim(spark, f"{bad}/manifest", facts.read_small(spark, f"{folder}/manifest"))
        with pytest.raises(EngineError, match="not what the manifest lists"):
            space_export.verified(spark, bad, told["sha256"])
    for wrong in (("none", "1", "x\n"), ("records", "1", "x"), ("records", "1", "x\ny\n"), ("records", "1", None)):
        with pytest.raises(EngineError, match="UNPROCESSABLE"):
            space_export.parts(made([*rows, wrong]), f"file://{tmp_path}/w", 128)
    assert space_export.parts(spark.createDataFrame([], "section string, key string, line string"), f"file://{tmp_path}/none").collect() == []


def test_only_a_manifest_bounds_the_parts_of_a_space(spark, tmp_path):
    n = space_export.MAX_PARTS + 500
    lines = spark.range(n).select(F.lit("events").alias("section"), F.format_string("%06d", "id").alias("key"), F.concat(F.format_string("%015d", "id"), F.lit("\n")).alias("line"))
    rows = sorted(space_export.parts(lines, f"file://{tmp_path}/placed", 16).collect(), key=lambda r: r.part)
    assert [r.part for r in rows] == list(range(-(-n * 16 // 13))) and "".join(r.body for r in rows) == "".join(f"{i:015}\n" for i in range(n))
    with pytest.raises(EngineError, match="RESULT_TOO_LARGE"):
        space_export.export(lines, f"file://{tmp_path}/export", f"file://{tmp_path}/again", "exp_1", {}, {}, 16)
    assert facts.read_small(spark, f"file://{tmp_path}/export/manifest") is None


def test_a_job_stops_between_its_cuts(spark, tmp_path):
    log = spark.createDataFrame([(f"r{i % 20}", 1 + i // 20, i + 1, "delete" if i == 25 else "create" if i < 20 else "replace", i) for i in range(60)], "record_id string, revision long, position long, op string, v long")
    partial = lambda df, cut: df.groupBy(*cut).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    total = lambda df: df.agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    job = jobs.Job(f"file://{tmp_path}/job", 40, max_records=100)
    seen = []

    def stopping(df, cut):
        seen.append(1)
        if len(seen) == 2:
            assert jobs.cancel(spark, job) and not jobs.cancel(spark, job)
        return partial(df, cut)

    with pytest.raises(EngineError, match="cancelled"):
        jobs.run_as_of(job, log, ["v"], stopping, cuts=4)
    assert len(seen) == 2
    again = jobs.Job(f"file://{tmp_path}/again", 40)

    def failing(df, cut):
        seen.append(1)
        if len(seen) == 5:
            raise RuntimeError("lost")
        return partial(df, cut)

    with pytest.raises(RuntimeError, match="lost"):
        jobs.run_as_of(again, log, ["v"], failing, cuts=4)
    # The second run has the cuts of the first, and does not see what came after the watermark or since.
    done = jobs.run_as_of(again, log.unionByName(log.withColumn("position", F.col("position") + 1000)), ["v"], failing, cuts=4)
    want = sum(range(20, 40)) - 25
    assert tuple(jobs.merged(spark, done, total).first()) == (19, want) and not jobs.cancel(spark, again)
    with pytest.raises(EngineError):
        jobs.run_as_of(jobs.Job(f"file://{tmp_path}/small", 40, max_records=3), log, ["v"], partial)


def test_owners_and_what_is_not_published(spark):
    grants = spark.createDataFrame([("k", "a", ["read"])], "credential string, collection_id string, capabilities array<string>")
    owned = spark.createDataFrame([("a", "active"), ("b", "readOnly"), ("c", "deleted")], "collection_id string, lifecycle string")
    assert [r.collection_id for r in evidence.readable(grants, "k", "read").collect()] == ["a"]
    assert sorted(r.collection_id for r in evidence.readable(grants, "owner", "read", owned).collect()) == ["a", "b"]
    log = spark.createDataFrame([(1, 1), (2, 1)], "position long, schema_version int")
    waiting = spark.range(2)
    assert tuple(history.freshness(log, 2, 1, waiting).first()) == (2, 0, 2, "stale") and tuple(history.freshness(log, 2, 1, waiting.limit(0)).first()) == (2, 0, 0, "exact")
