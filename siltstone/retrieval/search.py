"""One search, from a request to its hits.

Lexical and vector candidates are taken from what is live and may be read, each ref once at its best chunk; their
ranks are fused; what the authority says now is read again, and what has gone, moved on or closed since is
rejected; and the ranks of what is left are fused anew, so that a rejected ref takes nobody's place.  All lists are
of at most 200 refs; matching and scoring run over all chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.retrieval import candidates
from siltstone.types import EngineError

#: What names a ref, and the order of refs that are otherwise equal.
REF = ["collection_id", "kind", "ref_id"]
MODES = ("lexical", "vector", "hybrid")


@dataclass(frozen=True)
class Request:
    text: str | None = None
    vector: tuple[float, ...] | None = None
    limit: int = 10
    mode: str = "hybrid"

    def admit(self) -> None:
        if self.mode not in MODES or not 1 <= self.limit <= 50:
            raise EngineError("INVALID_ARGUMENT", "1 to 50 hits, lexical, vector or hybrid")
        if self.mode != "vector" and not self.text or self.mode != "lexical" and not self.vector:
            raise EngineError("INVALID_ARGUMENT", f"a {self.mode} search needs what it searches for")
        if self.vector and not (np.isfinite(self.vector).all() and np.any(self.vector)):
            raise EngineError("INVALID_ARGUMENT", "a query vector is finite and not all zeros")


def live(authority: DataFrame, readable: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(REF, revision) of what a search may find: current, not deleted, in a readable collection, not a hidden claim.

    authority has REF, revision, tombstone, and where refs have extractions, as those of `kinds.authority`, `extraction`;
    readable collection_id; hidden the ref_id of claims that cite what cannot be read.
    """
    more = ["extraction"] if "extraction" in authority.columns else []
    rows = authority.filter(~F.col("tombstone")).join(readable.select("collection_id").distinct(), "collection_id", "left_semi").select(*REF, "revision", *more)
    if hidden is not None:
        gone = hidden.select(F.lit("claim").alias("kind"), "ref_id").distinct()
        rows = rows.join(gone, ["kind", "ref_id"], "left_anti")
    return rows


def _best(scored: DataFrame, able: DataFrame, bound: int, name: str) -> DataFrame:
    """Each ref at its best chunk, the first `bound` of them, with their `position`."""
    same = F.lit(True)
    for c in (*REF, "revision"):
        same = same & (scored[c] == able[c])
    if "extraction" in able.columns:
        same = same & scored["extraction"].eqNullSafe(able["extraction"])
    kept = scored.join(able, same, "left_semi")
    best = kept.groupBy(*REF, "revision").agg(F.max(F.struct("score", -F.col("chunk_index"))).alias("best"))
    order = [F.desc(F.round("score", 9)), *REF]
    top = best.select(*REF, "revision", F.col("best.score").alias("score"), (-F.col("best.col2")).alias("chunk_index")).orderBy(*order).limit(bound)
    return top.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).withColumn("list", F.lit(name))


def lexical_list(index: DataFrame, able: DataFrame, request: Request, bound: int) -> DataFrame:
    more = ["extraction"] if "extraction" in able.columns else []
    return _best(candidates.lexical(index, [*REF, "revision", *more, "chunk_index"], request.text), able, bound, "lexical")


def vector_list(vectors: DataFrame, able: DataFrame, request: Request, bound: int, generations: tuple[int, ...] = (1,)) -> DataFrame:
    """The nearest refs by the cosine of their best chunk, over the active generations together."""
    wanted = np.array(request.vector, np.float64)
    wanted = wanted / np.sqrt((wanted * wanted).sum())

    def run(batches):
        for batch in batches:
            rows = batch.column(batch.num_columns - 1)
            whole = np.array([x is not None and len(x) == len(wanted) for x in rows], bool)
            batch = batch.filter(pa.array(whole))
            v = batch.column(batch.num_columns - 1).flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(wanted))
            size = np.sqrt((v * v).sum(1))
            some = size > 0
            score = np.where(some, v @ wanted / np.where(some, size, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*[c.filter(pa.array(some)) for c in batch.columns[:-1]], pa.array(score[some])], names=[*batch.schema.names[:-1], "score"])

    columns = [*REF, "revision", *(["extraction"] if "extraction" in able.columns else []), "chunk_index"]
    rows = vectors.filter(F.col("generation").isin(list(generations))).select(*columns, F.col("embedding").cast("array<double>").alias("embedding"))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns) + ", score double"
    return _best(rows.mapInArrow(run, schema), able, bound, "vector")


def _fused(lists: DataFrame, limit: int) -> DataFrame:
    """The lists' refs in fused order, with `rank` from 1."""
    key = F.to_json(F.struct(*REF))
    held = lists.withColumn("key", key)
    ranked = candidates.fused(held.select(F.when(F.col("list") == "lexical", 0).otherwise(1).alias("list"), F.col("key").alias("ref_id"), "position"), limit)
    order = [F.desc(F.round("score", 12)), "best_rank", F.element_at("matched_by", 1), "ref_id"]
    placed = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).withColumnRenamed("ref_id", "key")
    refs = held.groupBy("key", *REF).agg(F.min("revision").alias("revision"), F.max_by("chunk_index", F.struct("list", -F.col("position"))).alias("chunk_index"))
    return placed.join(refs, "key").drop("key")


def candidate_lists(request: Request, index: DataFrame | None, vectors: DataFrame | None, able: DataFrame, generations: tuple[int, ...] = (1,)) -> DataFrame:
    request.admit()
    bound, lists = candidates.overfetch(request.limit), []
    if request.mode != "vector":
        lists.append(lexical_list(index, able, request, bound))
    if request.mode != "lexical":
        lists.append(vector_list(vectors, able, request, bound, generations))
    return lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])


def reread(lists: DataFrame, authority: DataFrame, readable: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """The candidates with what is true of them now: ok, deleted, unauthorized or stale."""
    open_ = readable.select("collection_id").distinct().withColumn("open", F.lit(True))
    now = authority.select(*REF, F.col("revision").alias("current"), "tombstone")
    # At most 400 candidates meet the authority, and as many of its rows are broadcast.
    told = lists.join(F.broadcast(now.join(F.broadcast(lists.select(*REF).distinct()), REF, "left_semi")), REF, "left").join(open_, "collection_id", "left")
    claims = F.lit(False)
    if hidden is not None:
        told = told.join(hidden.select("ref_id", F.lit("claim").alias("kind"), F.lit(True).alias("unseen")).distinct(), ["kind", "ref_id"], "left")
        claims = F.coalesce("unseen", F.lit(False))
    verdict = F.when(F.col("current").isNull() | F.col("tombstone"), "deleted").when(F.col("open").isNull() | claims, "unauthorized").when(F.col("current") != F.col("revision"), "stale").otherwise("ok")
    return told.select(*lists.columns, verdict.alias("verdict"))


def hits(checked: DataFrame, limit: int) -> DataFrame:
    """The fused hits of reread candidates: those that hold are ranked anew in their lists, then fused."""
    left = checked.filter("verdict = 'ok'").withColumn("position", F.row_number().over(Window.partitionBy("list").orderBy("position")))
    return _fused(left, limit).select("rank", *REF, "revision", "chunk_index", "score", "matched_by")


def cited(found: DataFrame, spans: DataFrame, texts: DataFrame) -> DataFrame:
    """One citation per hit: its chunk's start and end, and that very stretch of the text that the authority has now.

    spans: REF, chunk_index, start, end; texts: REF, field, text. Only the hits' chunks and texts are read further.
    """
    few = F.broadcast(found.select("rank", *REF, "chunk_index", "matched_by"))
    placed = spans.join(few, [*REF, "chunk_index"])
    whole = texts.join(F.broadcast(found.select(*REF)), REF, "left_semi")
    part = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return placed.join(whole, REF).select("rank", *REF, "field", "start", "end", part.alias("text"), "matched_by")


def report(checked: DataFrame, request: Request, states: DataFrame | None = None) -> DataFrame:
    """One row: refs fetched, found and rejected by cause, and the reasons of an underfilled result.

    states, where given, has a collection's projection `state` a row.
    """
    bound = candidates.overfetch(request.limit)
    refs = checked.groupBy(*REF).agg(F.max("verdict").alias("verdict"))
    per_list = checked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("fetched"))
    counts = refs.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "deleted", "stale", "unauthorized")])
    told = counts.crossJoin(per_list)
    if states is not None:
        told = told.crossJoin(states.agg(F.array_sort(F.collect_set("state")).alias("states")))
    else:
        told = told.withColumn("states", F.array().cast("array<string>"))
    short = F.col("ok") < request.limit
    reason = lambda name, when: F.when(short & when, F.lit(name))
    full = F.col("fetched") >= bound
    reasons = [
        reason("rejected", F.col("deleted") + F.col("stale") + F.col("unauthorized") > 0),
        reason("capped" if bound >= candidates.MOST else "bounded", full),
        reason("exhausted", ~full),
        *[reason(s, F.array_contains("states", s)) for s in ("degraded", "unindexed", "pending", "unprojected")],
    ]
    return told.select(F.least("ok", F.lit(request.limit)).alias("found"), "deleted", "stale", "unauthorized", F.filter(F.array(*reasons), lambda x: x.isNotNull()).alias("reasons"))


def search(request: Request, index: DataFrame | None, vectors: DataFrame | None, authority: DataFrame, readable: DataFrame, hidden: DataFrame | None = None, now: DataFrame | None = None, generations: tuple[int, ...] = (1,)) -> tuple[DataFrame, DataFrame]:
    """The hits of a request, and the reread candidates that `report` tells of; `now` is the authority at the reread."""
    found = candidate_lists(request, index, vectors, live(authority, readable, hidden), generations)
    # Two lists of at most 200 rows: read once, whatever is asked of them later.
    lists = found.sparkSession.createDataFrame(found.collect(), found.schema)
    checked = reread(lists, authority if now is None else now, readable, hidden)
    return hits(checked, request.limit), checked
