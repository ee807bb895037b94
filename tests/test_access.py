"""Access, sources, jobs and embedder choice."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.operators import access, facts, history, jobs
from siltstone.retrieval import coverage
from siltstone.sources import files
from siltstone.types import EngineError


def test_scope_order(spark):
    spaces = spark.createDataFrame([("s", "active", 1), ("r", "readOnly", 1), ("x", "suspended", 1)], "space_id string, lifecycle string, policy int")
    collections = spark.createDataFrame([("s", "a", "active"), ("s", "d", "deleted"), ("r", "a", "active"), ("x", "a", "active")], "space_id string, collection_id string, lifecycle string")
    grants = spark.createDataFrame([(s, "a", "k", ["read", "write"]) for s in "srx"], "space_id string, collection_id string, credential string, capabilities array<string>")
    asked = [("s", "a", "k", "read", 1, False, "ok"), ("s", "z", "k", "read", 1, False, "NOT_FOUND"), ("s", "a", "k", "read", 2, False, "FORBIDDEN"), ("x", "a", "k", "read", 1, False, "SPACE_UNAVAILABLE"), ("s", "d", "k", "read", 1, False, "NOT_FOUND")]
    asked += [("s", "a", "other", "read", 1, False, "FORBIDDEN"), ("s", "a", "k", "own", 1, False, "FORBIDDEN"), ("r", "a", "k", "write", 1, True, "SPACE_UNAVAILABLE"), ("r", "a", "k", "read", 1, False, "ok")]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "request_id int, space_id string, collection_id string, credential string, capability string, policy int, write boolean, want string")
    assert [(r.request_id, r.outcome) for r in access.scope_outcomes(df, spaces, collections, grants).orderBy("request_id").collect()] == [(i, a[-1]) for i, a in enumerate(asked)]


def test_exports_verify(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i:03d}", i) for i in range(30)], "record_id string, revision long")
    pages = history.export_pages(history.export_lines(df, F.lit('{"a":1}')), f"file://{tmp_path}/parts", max_rows=7)
    sealed = files.write_export(pages, f"file://{tmp_path}/x")
    assert sealed["rows"] == 30 and files.verify_export(spark, f"file://{tmp_path}/x").count() == 30
    spark.read.parquet(f"file://{tmp_path}/x/pages").withColumn("body", F.concat("body", F.lit(" "))).write.parquet(f"file://{tmp_path}/y/pages")
    spark.read.text(f"file://{tmp_path}/x/manifest").write.text(f"file://{tmp_path}/y/manifest")
    with pytest.raises(EngineError):
        files.verify_export(spark, f"file://{tmp_path}/y")


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes(b"hello")
    (tmp_path / "t" / "b.txt").write_bytes(b"x" * (files.MAX_TEXT + 1))
    got = {r.locator[-5:]: r for r in files.text_sources(spark, f"file://{tmp_path}/t").collect()}
    assert got["a.txt"].sha256 == hashlib.sha256(b"hello").hexdigest() and got["a.txt"].code is None and got["b.txt"].code == "INVALID_ARGUMENT" and got["b.txt"].content is None
    told = spark.createDataFrame([(got["a.txt"].locator, got["a.txt"].sha256), (got["b.txt"].locator, "no")], "locator string, sha256 string")
    assert {r.locator[-5:]: r.verified for r in files.binary_sources(spark, f"file://{tmp_path}/t", told).collect()} == {"a.txt": True, "b.txt": False}
    (tmp_path / "r.jsonl").write_text('{"id":"a","revision":2,"data":{"b":null,"a":1}}\nnot json\n')
    rows = files.records(spark, f"file://{tmp_path}/r.jsonl").collect()
    assert (rows[0].record_id, rows[0].revision, rows[0].canonical_data) == ("a", 2, '{"a":1,"b":null}') and rows[1].record_id is None


def test_jobs_are_admitted_and_whole(spark, tmp_path):
    rows = spark.range(100).withColumn("n_bytes", F.lit(10)).withColumn("position", F.col("id") + 1)
    partial = lambda df, cut: df.groupBy(*cut).agg(F.sum("id").alias("s"))
    job = jobs.Job(f"file://{tmp_path}/job", 60, max_records=60, max_bytes=600)
    with pytest.raises(EngineError):
        jobs.merged(spark, job, lambda df: df)
    done = jobs.run(job, rows, "id", partial, 5, "n_bytes", "position")
    assert done.state == "done" and jobs.merged(spark, done, lambda df: df.agg(F.sum("s"))).first()[0] == sum(range(60))
    again = jobs.run(job, rows, "id", partial, 5, "n_bytes", "position")
    assert jobs.merged(spark, again, lambda df: df.agg(F.sum("s"))).first()[0] == sum(range(60))
    past = datetime.datetime.now(datetime.UTC) - datetime.timedelta(seconds=1)
    for bad in (jobs.Job(job.folder, 60, max_records=59), jobs.Job(job.folder, 60, max_bytes=599), jobs.Job(job.folder, 60, expires=past), job.cancelled(), done):
        with pytest.raises(EngineError):
            jobs.run(bad, rows, "id", partial, 5, "n_bytes", "position")
    with pytest.raises(EngineError):
        done.cancelled()


def test_grants_count_together_and_expire(spark):
    spaces = spark.createDataFrame([("s", "active", 1, "eu")], "space_id string, lifecycle string, policy int, placement string")
    collections = spark.createDataFrame([("s", "a", "active")], "space_id string, collection_id string, lifecycle string")
    past, later = datetime.datetime(2001, 1, 1), datetime.datetime(2999, 1, 1)
    grants = [("s", "a", "k", ["read"], None), ("s", "a", "k", ["write", "read"], later), ("s", "a", "k", ["own"], past)]
    grants = spark.createDataFrame(grants, "space_id string, collection_id string, credential string, capabilities array<string>, expires_at timestamp")
    asked = [(i, "s", "a", "k", c, 1, False, p) for i, (c, p) in enumerate([("read", "eu"), ("write", "eu"), ("own", "eu"), ("read", "us")])]
    df = spark.createDataFrame(asked, "request_id int, space_id string, collection_id string, credential string, capability string, policy int, write boolean, placement string")
    assert [r.outcome for r in access.scope_outcomes(df, spaces, collections, grants).orderBy("request_id").collect()] == ["ok", "ok", "FORBIDDEN", "FORBIDDEN"]


def test_facts_become_visible_together(spark, tmp_path):
    store = facts.Store(f"file://{tmp_path}/facts")
    one = spark.range(3).toDF("n")
    store.append({"events": one, "outbox": one.filter("n > 0")}, 1)
    store.append({"events": one, "outbox": one.filter("n > 0")}, 1)
    # A batch that stopped before its commit is not seen.
    one.write.parquet(f"file://{tmp_path}/facts/events/batch=2/attempt=stopped")
    assert store.read(spark, "events").count() == 3 and store.read(spark, "outbox").count() == 2


def test_embedders():
    have = [{"name": n, "identity": "e", "region": r, "cost": c, "quality": q} for n, r, c, q in (("b", "eu", 1, 5), ("a", "eu", 1, 5), ("c", "us", 1, 5), ("d", "eu", 2, 9), ("e", "eu", 1, 4))]
    assert coverage.choose(have, "e", ["us", "eu"])["name"] == "c" and coverage.choose(have, "e", ["eu"])["name"] == "a"
    with pytest.raises(EngineError):
        coverage.choose(have, "x", ["eu"])
