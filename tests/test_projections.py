"""Range digests, the feed as a data source, liveness by kind: against full comparisons and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import facts
from siltstone.retrieval import digests, generations, kinds
from siltstone.sources import feed_source
from siltstone.streaming import folds
from siltstone.types import EngineError


def ranged(tmp_path, name, **kw):
    return digests.Ranged(f"file://{tmp_path}/{name}", "k", ("a", "b"), **{"fanout": 4, "levels": 2, **kw})


def test_only_leaves_that_differ_are_read_and_written(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{i}", rng.choice([None, "", "x"]), rng.randrange(5)) for i in range(300)]
    authority, projection = ranged(tmp_path, "authority"), ranged(tmp_path, "projection")
    kinds_ = "k string, a string, b int"
    authority.write(spark.createDataFrame(rows, kinds_))
    projection.write(spark.createDataFrame(rng.sample(rows, 300), kinds_).repartition(3))
    assert digests.differing(spark, projection, authority) == [] and digests.compared(spark, projection, authority).collect() == []
    # One changed from empty to null, one gone, one too many.
    other = [(k, None if (k, a) == changed else a, b) for changed in [next((k, a) for k, a, _ in rows if a == "")] for k, a, b in rows if k != "k7"] + [("more", "x", 1)]
    projection.write(spark.createDataFrame(other, kinds_))
    leaves = digests.differing(spark, projection, authority)
    found = digests.compared(spark, projection, authority)
    want = generations.mismatches(projection.read(spark), authority.read(spark), "k", ["a", "b"]).collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) and len(want) == 3
    assert 1 <= len(leaves) <= 3 and {int(f.split("/leaf=")[1].split("/")[0]) for f in found.inputFiles()} == set(leaves)
    assert {r.same for r in digests.sampled(spark, projection, authority, size=300).collect()} == {True, False}
    before = projection._last(spark)[1]
    assert digests.repaired(spark, projection, authority) == len(leaves) and digests.repaired(spark, projection, authority) == 0
    after = projection._last(spark)[1]
    assert {k for k in after if k != "tree" and after[k] != before.get(k)} == set(map(str, leaves))
    assert sorted(map(str, projection.read(spark).collect())) == sorted(map(str, authority.read(spark).collect()))
    assert [r.same for r in digests.sampled(spark, projection, authority).collect()] == [True] * 20


def test_digests_of_empty_tables(spark, tmp_path):
    one, other = ranged(tmp_path, "one"), ranged(tmp_path, "other")
    none = spark.createDataFrame([], "k string, a string, b int")
    with pytest.raises(EngineError):
        one.read(spark)
    one.write(none)
    other.write(none)
    assert digests.differing(spark, one, other) == []
    other.write(spark.createDataFrame([("x", "a", 1)], "k string, a string, b int"))
    assert len(digests.differing(spark, one, other)) == 1 and [r.k for r in other.read(spark).collect()] == ["x"]


def test_the_feed_goes_on_from_any_cursor(spark, tmp_path):
    feed_source.register(spark)
    kinds_, folder = "position long, record_id string, body string", f"file://{tmp_path}/log"
    events = [(i, f"r{i % 7}", None if i % 5 == 0 else "x" * i) for i in range(1, 101)]
    made = lambda rows: spark.createDataFrame(rows, kinds_)
    made(events[:60]).repartition(4).write.parquet(folder)
    batch = spark.read.format("siltstone_feed").options(path=folder, cursor=50).load()
    assert batch.schema.simpleString() == "struct<position:bigint,record_id:string,body:string>" and sorted(r.position for r in batch.collect()) == list(range(51, 61))
    assert spark.read.format("siltstone_feed").options(path=folder, cursor=60).load().collect() == []
    store = facts.Store(f"file://{tmp_path}/store")
    stream = lambda: spark.readStream.format("siltstone_feed").schema(kinds_).options(path=folder, cursor=10, maxEvents=20).load()
    folds.run(stream(), store, "events", f"file://{tmp_path}/checkpoint").awaitTermination()
    first = {r.position for r in store.read(spark, "events").collect()}
    assert first and first <= set(range(11, 61))
    made(events[60:]).repartition(3).write.mode("append").parquet(folder)
    for _ in range(6):  # a bound on a batch's events: starts again until all is read
        folds.run(stream(), store, "events", f"file://{tmp_path}/checkpoint").awaitTermination()
    assert sorted(tuple(r) for r in store.read(spark, "events").collect()) == sorted(events[10:], key=lambda e: e[0])


def test_liveness_and_citations_by_kind(spark):
    records = spark.createDataFrame([("c", "r1", 2, False, "f", "héllo world"), ("c", "r2", 1, True, "f", "gone"), ("d", "r1", 1, False, "f", "other")], "collection_id string, record_id string, revision long, tombstone boolean, field string, text string")
    entities = spark.createDataFrame([("c", "source", "s1", 1, False), ("c", "source", "s2", 1, False), ("c", "claim", "q", 3, False)], "collection_id string, kind string, entity_id string, revision long, tombstone boolean")
    segments = "array<struct<start:long,end:long,source_start:long,source_end:long>>"
    extractions = spark.createDataFrame([("c", "s1", 1, "old", None), ("c", "s1", 2, "größe zählt", [(0, 6, 3, 11), (6, 11, 20, 26)])], f"collection_id string, source_id string, version long, content string, segments {segments}")
    collections = spark.createDataFrame([("c", "active"), ("d", "deleted")], "collection_id string, lifecycle string")
    refs = kinds.authority(records, entities, extractions, collections)
    assert sorted((r.kind, r.ref_id, r.revision, r.extraction) for r in refs.collect()) == [("claim", "q", 3, None), ("record", "r1", 2, None), ("record", "r2", 1, None), ("source", "s1", 1, 2)]
    chunk = [("c", "record", "r1", 1, None), ("c", "record", "r1", 2, None), ("c", "record", "r2", 1, None), ("d", "record", "r1", 1, None), ("c", "source", "s1", 1, 1), ("c", "source", "s1", 1, 2), ("c", "source", "s2", 1, 1), ("c", "claim", "q", 3, None), ("c", "claim", "q", 2, None), ("c", "claim", "r1", 2, None)]
    chunks = spark.createDataFrame(chunk, "collection_id string, kind string, ref_id string, revision long, extraction long")
    assert sorted((r.kind, r.ref_id, r.revision, r.extraction) for r in kinds.live_chunks(chunks, refs).collect()) == [("claim", "q", 3, None), ("record", "r1", 2, None), ("source", "s1", 1, 2)]
    found = spark.createDataFrame([(1, "c", "source", "s1", 1, 0), (2, "c", "record", "r1", 2, 0), (3, "c", "claim", "q", 3, 0)], "rank int, collection_id string, kind string, ref_id string, revision long, chunk_index int")
    spans = chunks.withColumn("chunk_index", F.lit(0)).withColumn("field", F.when(F.col("kind") == "record", "f")).withColumn("start", F.lit(7)).withColumn("end", F.lit(10))
    claims = spark.createDataFrame([("c", "q", 3, "that it is so"), ("c", "q", 2, "before")], "collection_id string, claim_id string, revision long, statement string")
    evidence = spark.createDataFrame([("c", "q", 3, 2, "e", "s9"), ("c", "q", 3, 1, "d", "s1"), ("c", "q", 2, 1, "x", "y")], "collection_id string, claim_id string, revision long, ordinal int, source_collection_id string, source_id string")
    got = {r["rank"]: (r.text, r.source_start, r.source_end, r.evidence and [tuple(e) for e in r.evidence]) for r in kinds.cited(found, spans, records, extractions, claims, evidence).collect()}
    assert got == {1: ("größe zählt"[7:10], 21, 25, None), 2: ("héllo world"[7:10], None, None, None), 3: ("that it is so"[7:10], None, None, [("d", "s1"), ("e", "s9")])}
