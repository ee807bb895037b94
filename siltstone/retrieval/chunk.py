"""Chunks of texts, and a feature-hash embedding."""

from __future__ import annotations

import time
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.projection import field_path
from siltstone.types import CHUNK, OVERLAP, EngineError


def spans(text: str, size: int = CHUNK, overlap: int = OVERLAP):
    """(start, end) of a text's chunks: cut after the last white space of the second half; blank ones dropped."""
    start, n = 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            cut = next((i for i in range(end - 1, start + size // 2 - 1, -1) if text[i].isspace()), None)
            end = end if cut is None else cut + 1
        if text[start:end].strip():
            yield start, end
        if end >= n:
            return
        start = end - overlap


def _chunks(size: int, overlap: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.columns
            out = [(k, i, a, b, t[a:b]) for k, t in enumerate(texts.to_pylist()) if t for i, (a, b) in enumerate(spans(t, size, overlap))]
            who, index, start, end, part = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who, pa.int64())), pa.array(index, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(part, pa.string())], names=["ref_id", "chunk_index", "start", "end", "content"])

    return run


def chunked(texts: DataFrame, ref: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(ref_id, chunk_index, start, end, content), offsets in code points."""
    kind = texts.schema[ref].dataType.simpleString()
    return texts.select(F.col(ref).alias("ref_id"), F.col(text).alias("t")).mapInArrow(_chunks(size, overlap), f"ref_id {kind}, chunk_index int, start bigint, end bigint, content string")


def _fnv(text: str) -> int:
    h = 2166136261
    for c in text:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def embed(text: str, dimensions: int, memo: dict) -> np.ndarray:
    """Signed feature hashing of a text's words, of length one; all zeros without words."""
    import regex

    v = np.zeros(dimensions)
    for word in regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", text).lower()):
        h = memo.get(word)
        if h is None:
            h = memo[word] = _fnv(word)
        v[h % dimensions] += -1.0 if h >> 31 else 1.0
    size = np.sqrt((v * v).sum())
    return v / size if size else v


class Outage(Exception):
    """A provider that cannot be reached just now."""


#: Seconds between the tries of a batch; fixed values.
WAITS = (0.25, 1.0)


def provided(embed_batch, texts: list[str], dimensions: int, sleep=time.sleep) -> np.ndarray:
    """A provider's vectors for a batch, tried again after an outage; they must be of the size, finite, and not all zeros."""
    for wait in (*WAITS, None):
        try:
            got = np.asarray(embed_batch(texts), np.float64)
            break
        except Outage:
            if wait is None:
                raise EngineError("PROVIDER_UNAVAILABLE", "no embeddings after three tries") from None
            sleep(wait)
    if got.shape != (len(texts), dimensions) or not np.isfinite(got).all() or not got.any(axis=1).all():
        raise EngineError("PROVIDER_INVALID", "a vector of another size, not finite, or all zeros")
    return got


def _hashed(dimensions: int):
    """The feature-hash embedder over batches; it alone may give a text without words all zeros."""
    memo: dict = {}

    def run(texts: list[str]) -> np.ndarray:
        if len(memo) > 500_000:
            memo.clear()
        return np.array([embed(t, dimensions, memo) for t in texts]).reshape(len(texts), dimensions)

    return run


def reusable(*tables: DataFrame) -> DataFrame:
    """(content_sha256, embedding) of earlier runs' tables with `at`: of a digest the latest."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("content_sha256").agg(F.max_by("embedding", "at").alias("embedding"))


def checkpointed(chunks: DataFrame, checkpoints: DataFrame, keys: tuple[str, ...] = ("ref_id", "revision", "chunk_index", "content_sha256")) -> DataFrame:
    """The chunks with `done`: whether a checkpoint of the very ref, revision, place and content is there."""
    marks = checkpoints.select(*keys).distinct().withColumn("_done", F.lit(True))
    return chunks.join(marks, list(keys), "left").withColumn("done", F.coalesce("_done", F.lit(False))).drop("_done")


def embedded(chunks: DataFrame, content: str = "content", dimensions: int = 384, embed_batch=None, max_batch: int = 256, known: DataFrame | None = None) -> DataFrame:
    """The chunks with `embedding`, float32; a content is embedded once for all chunks that share it.

    `embed_batch` takes at most `max_batch` texts and gives their vectors; without one, features are hashed. Contents
    in `known` (content_sha256, embedding) are not embedded again.
    """
    key = F.sha2(F.col(content), 256)
    distinct = chunks.select(key.alias("content_sha256"), F.col(content).alias("c")).dropDuplicates(["content_sha256"])
    wanted = distinct if known is None else distinct.join(known.select("content_sha256"), "content_sha256", "left_anti")

    def run(batches):
        provider = _hashed(dimensions) if embed_batch is None else lambda texts: provided(embed_batch, texts, dimensions)
        for batch in batches:
            for a in range(0, batch.num_rows, max_batch):
                part = batch.slice(a, max_batch)
                vectors = provider([t or "" for t in part.column(1).to_pylist()]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["content_sha256", "embedding"])

    vectors = wanted.mapInArrow(run, "content_sha256 string, embedding array<float>")
    if known is not None:
        vectors = vectors.unionByName(known.select("content_sha256", F.col("embedding").cast("array<float>").alias("embedding")).join(distinct, "content_sha256", "left_semi"))
    return chunks.withColumn("content_sha256", key).join(vectors, "content_sha256")


def configured(records: DataFrame, policy: dict[str, list[str]], data: str = "canonical_data") -> DataFrame:
    """(ref_id, collection_id, position, field, text): what a collection's policy indexes of its records, in its order; other values than strings are left out."""
    document, nothing = F.try_parse_json(F.col(data)), F.array().cast("array<struct<position:int,field:string,text:string>>")
    parts = nothing
    for collection, fields in policy.items():
        found = []
        for k, name in enumerate(fields):
            value = F.try_variant_get(F.col("_doc"), field_path(name), "variant")
            text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.col("_doc"), field_path(name), "string"))
            found.append(F.struct(F.lit(k).alias("position"), F.lit(name).alias("field"), text.alias("text")))
        parts = F.when(F.col("collection_id") == collection, F.array(*found)).otherwise(parts)
    rows = records.withColumn("_doc", document).select("ref_id", "collection_id", F.explode(parts).alias("x"))
    return rows.select("ref_id", "collection_id", "x.*").filter("text IS NOT NULL")


def indexed(records: DataFrame, sources: DataFrame, claims: DataFrame, policy: dict[str, list[str]]) -> DataFrame:
    """What is indexed of all kinds of refs: configured fields of records, contents of sources, statements of claims."""
    of = lambda rows, kind, field, text: rows.filter(F.col(text).isNotNull()).select("ref_id", "collection_id", F.lit(0).alias("position"), F.lit(field).alias("field"), F.col(text).alias("text"), F.lit(kind).alias("kind"))
    return configured(records, policy).withColumn("kind", F.lit("record")).unionByName(of(sources, "source", "content", "content")).unionByName(of(claims, "claim", "statement", "statement"))
