"""Exact nearest vectors of any number of queries: blocks of queries against parts of the vectors.

Both sides are written to the folder in `spark.checkpoint.dir` in files of bounded size. A task takes pairs of a
query file and a vector file, reads them itself, and keeps the best k of each query of one file at a time; the
bests of all parts are then merged. No query goes through the driver or a broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.scratch import scratch

QUERY_ROWS, VECTOR_ROWS, BATCH_ROWS = 512, 65_536, 4_096
_NONE = -2.0  # the score of a pair that has none: a null or all-zero vector


def _written(rows: DataFrame, at_most: int) -> str:
    path = scratch(rows.sparkSession, "vectors")
    rows.write.option("maxRecordsPerFile", at_most).parquet(path)
    return path


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


def _files(folder: str) -> list[str]:
    from pyarrow import fs

    store, path = _store(folder)
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".parquet"))


def _batches(folder: str, file: str, rows: int):
    """(keys ascending, vectors, norms) of a file's rows."""
    import pyarrow.parquet as pq

    with _store(folder)[0].open_input_file(file) as f:
        for batch in pq.ParquetFile(f).iter_batches(rows):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            held = batch.column(1)
            size = max(held.value_lengths().to_numpy(zero_copy_only=False).max(initial=0), 0) if not held.null_count else max((len(x) for x in held.to_pylist() if x is not None), default=0)
            width = int(size)
            flat = held.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) if not held.null_count else None
            if flat is None or len(flat) != len(keys) * width:
                flat = np.array([[*(x or []), *[0.0] * (width - len(x or []))] for x in held.to_pylist()], np.float64)
            v = flat.reshape(len(keys), width)
            order = np.argsort(keys, kind="stable")
            v = v[order]
            yield keys[order], v, np.sqrt((v * v).sum(1))


def _first(query: np.ndarray, keys: np.ndarray, scores: np.ndarray, k: int):
    """The best k of every query: by score, then by key."""
    order = np.lexsort((np.unique(keys, return_inverse=True)[1], -scores, query))
    query = query[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    order = order[place < k]
    return query[place < k], keys[order], scores[order]


def _block(asked, held, k: int):
    """(query, key, score) of the best k of a batch of vectors, for each query of a block."""
    (qk, q, qn), (vk, v, vn) = asked, held
    with np.errstate(all="ignore"):
        scores = np.round((q @ v.T) / (qn[:, None] * vn[None, :]), 9)
    scores[~np.isfinite(scores)] = _NONE
    for i, (a, b) in enumerate(zip(np.searchsorted(vk, qk, "left"), np.searchsorted(vk, qk, "right"), strict=True)):
        scores[i, a:b] = -np.inf
    n = min(k, scores.shape[1])
    least = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
    over, even = scores > least, scores == least
    take = (over | even & (np.cumsum(even, axis=1) <= n - over.sum(1)[:, None])) & np.isfinite(scores)
    row, column = np.nonzero(take)
    return row, vk[column], scores[row, column]


def files_below(folder: str) -> list[str]:
    """The data files of a folder and of those in it."""
    from pyarrow import fs

    store, path = _store(folder)
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.base_name.endswith(".parquet"))


def _of_pairs(queries: str, vectors: str, pairs, k: int, kind: pa.DataType):
    """The best k of each query over the vector files of a run of (query file, vector file) that share its file."""

    def told(asked, found):
        for (keys, *_), best in zip(asked, found, strict=True):
            if best is not None:
                query, near, scores = best
                yield pa.RecordBatch.from_arrays([pa.array(keys[query], kind), pa.array(near, kind), pa.array(scores, pa.float64(), mask=scores == _NONE)], names=["query_id", "key", "score"])

    now, asked, found = None, [], []
    for file, part in pairs:
        if file != now:
            yield from told(asked, found)
            now, asked = file, list(_batches(queries, file, QUERY_ROWS))
            found = [None] * len(asked)
        for held in _batches(vectors, part, BATCH_ROWS):
            for i, a in enumerate(asked):
                new = _block(a, held, k)
                found[i] = _first(*(new if found[i] is None else (np.concatenate(x) for x in zip(found[i], new, strict=True))), k)
    yield from told(asked, found)


def file_pairs(queries: str, vectors: str, k: int, kind: pa.DataType):
    """A task's work on rows that each name a query file and a vector file, in the order of the former."""
    return lambda batches: _of_pairs(queries, vectors, ((q, v) for b in batches for q, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), k, kind)


def _cells(queries: tuple[str, list[str]], vectors: tuple[str, list[str]], k: int, kind: pa.DataType):
    """The same on numbers of cells, of every query file with every vector file."""

    def run(batches):
        numbers = (divmod(int(x), len(vectors[1])) for b in batches for x in b.column(0).to_numpy())
        return _of_pairs(queries[0], vectors[0], ((queries[1][file], vectors[1][part]) for file, part in numbers), k, kind)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """(query_id, key, score, position): the k nearest others of every query, by cosine to nine places, then by key."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark: SparkSession = vectors.sparkSession
    kind = vectors.schema[key].dataType
    sides = []
    for rows, at_most in ((queries, QUERY_ROWS), (vectors, VECTOR_ROWS)):
        folder = _written(rows.select(F.col(key).cast(kind).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k IS NOT NULL"), at_most)
        sides.append((folder, _files(folder)))
    n = len(sides[0][1]) * len(sides[1][1])
    cells = spark.range(0, n, 1, max(1, min(n, 16 * spark.sparkContext.defaultParallelism)))
    name = kind.simpleString()
    scored = cells.mapInArrow(_cells(*sides, k, to_arrow_type(kind)), f"query_id {name}, key {name}, score double").withColumnRenamed("key", key)
    best = scored.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return best.filter(F.col("position") <= k)
