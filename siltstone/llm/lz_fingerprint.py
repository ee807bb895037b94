"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into dictionary phrases (LZW: runs of one and two bytes are known at the start,
and a phrase is the shortest run not yet in the dictionary, which it then enters).  The set of phrases is what a
compressor would learn from the text; its fingerprint is the 128 least hashes of the phrases, and the
likeness of two fingerprints estimates the Jaccard similarity of the phrase sets, as the share of the least
128 of both together that are in both.  Sets of at most 128 phrases are compared exactly.

A dictionary that reaches `DICTIONARY` phrases is emptied, as compressors do, and parsing goes on; memory is
bounded and every byte is parsed.

The fingerprint of an empty or null text is empty; two empty ones are alike (1.0), an empty and another are
not (0.0).  Rows that repeat a doc_id follow one another by their texts.  A null doc_id has no place in the
order: the next text is empty.  An empty table gives an empty
result.  Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernel as K
from siltstone.llm.shared import batched

SIZE = 128
DICTIONARY = 1 << 20


def _parse(data: bytes, seen: set, at: int) -> int:
    """Add the phrases of data[at:] to the dictionary, up to its end or the dictionary's; where the next starts."""
    add, stop = seen.add, len(data)
    data += b"\xff"  # never in UTF-8, so no phrase runs over the end
    for _ in range(DICTIONARY - len(seen)):
        end = at + 3
        while (phrase := data[at:end]) in seen:
            end += 1
        if end > stop:
            break
        add(phrase)
        at = end
    return at


def _least(seen: set, kept: np.ndarray) -> np.ndarray:
    """The least hashes of the phrases and of those kept before, ascending."""
    raw = np.fromiter(map(zlib.crc32, seen), np.uint32, len(seen)).astype(K.U)
    h = (K.mix(raw * K.U(0x9E3779B97F4A7C15) + K.U(1)) >> K.U(32)).astype(np.uint32)
    if len(h) > 4 * SIZE:
        h = np.partition(h, 4 * SIZE)[: 4 * SIZE]
    return np.unique(np.concatenate([kept, h]))[:SIZE]


_NONE = np.zeros(0, np.uint32)


def _finish(data: bytes, seen: set, at: int, kept: np.ndarray) -> np.ndarray:
    while True:
        at = _parse(data, seen, at)
        if len(seen) < DICTIONARY:
            break
        kept, seen = _least(seen, kept), set()
    if at < len(data):
        seen.add(data[at:])
    return _least(seen, kept)


def sketch(data: bytes) -> np.ndarray:
    return _finish(data, set(), 0, _NONE)


def sketch_both(data: bytes, other: bytes, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of two texts that share their first `common` bytes, parsed once for both."""
    seen: set = set()
    at = _parse(data[:common], seen, 0)
    if len(seen) >= DICTIONARY:
        return sketch(data), sketch(other)
    again = _finish(other, seen.copy(), at, _NONE)
    return _finish(data, seen, at, _NONE), again


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, count = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((count[:SIZE] == 2).mean()) if len(both) else 1.0


def spelt(sketch_: np.ndarray) -> str:
    return sketch_.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last third replaced by as many code points of the next, and the bytes kept."""
    cut = len(text) - len(text) // 3
    head = text[:cut]
    return head + following[: len(text) // 3], len(head.encode())


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches):
    """Rows come by bucket, in order, each bucket closed by the first row after it (is_head)."""
    before, out = None, []

    def ended(own_row, following):
        doc_id, text, data = own_row
        changed, common = edited(text, following)
        changed = changed.encode()
        own, other = sketch_both(data, changed, common)
        return (doc_id, len(text), hashlib.sha256(changed).hexdigest(), spelt(own), spelt(other), likeness(own, other)), own

    pending = None  # a finished row that still lacks the next one's sketch

    def settle(sketch_):
        nonlocal pending
        if pending is not None:
            *fields, own = pending
            out.append((*fields, likeness(own, sketch_)))
            pending = None

    def flush():
        arrays = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(arrays, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])
        out.clear()
        return batch

    closed = None  # the bucket whose head has come
    for batch in batches:
        for doc_id, text, bucket, is_head in zip(*[c for c in batch.columns], strict=True):
            doc_id, text, bucket, is_head = doc_id.as_py(), text.as_py() or "", bucket.as_py(), is_head.as_py()
            here = (doc_id, text, text.encode())
            if bucket < 0:
                fields, own = ended(here, "")
                out.append((*fields, likeness(own, _NONE)))
            elif bucket != closed:
                if before is not None:
                    fields, own = ended(before, text)
                    settle(own)
                    pending = (*fields, own)
                before = here
                if is_head:
                    settle(sketch(here[2]))
                    before, closed = None, bucket
            if len(out) >= 512:
                yield flush()
    if out:
        yield flush()


def _bucketed(rows: DataFrame, bounds: list[float]) -> DataFrame:
    """The rows with their `bucket`, the number of bounds at or below doc_id; the bounds are a task's data, not part of its plan."""
    from pyspark.ml.feature import Bucketizer

    if not bounds:
        return rows.withColumn("bucket", F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_place", outputCol="_bucket")
    return cut.transform(rows.withColumn("_place", F.col("doc_id").cast("double"))).withColumn("bucket", F.col("_bucket").cast("int")).drop("_place", "_bucket")


def fingerprints(documents: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likenesses to the latter and to the next document.

    The order is cut into id ranges; of each range but its own documents only the first one that follows is
    sent along, so that texts are shuffled once.
    """
    spark, docs = documents.sparkSession, documents.select("doc_id", "text")
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    bounds = sorted(set(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)))
    # One row per id range: as many as the job has partitions, times four.
    tops = sorted(tuple(r) for r in _bucketed(ids, bounds).groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect())
    heads = [(tops[k][1], tops[(k + 1) % len(tops)][0]) for k in range(len(tops))]
    known, none = docs.filter("doc_id IS NOT NULL"), docs.filter("doc_id IS NULL")
    own = _bucketed(known, bounds).unionByName(none.withColumn("bucket", F.lit(-1))).withColumn("is_head", F.lit(0))
    if heads:
        first = F.broadcast(spark.createDataFrame(heads, "doc_id long, bucket int"))
        own = own.unionByName(known.join(first, "doc_id").select("doc_id", "text", "bucket", F.lit(1).alias("is_head")))
    dealt = own.repartition(parts, "bucket").sortWithinPartitions("bucket", "is_head", F.desc("doc_id"), "text")
    return batched(dealt).mapInArrow(_walk, SCHEMA)
