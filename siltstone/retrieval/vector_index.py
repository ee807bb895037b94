"""An inverted-list index of vectors: every row in the list of its nearest centroid, searched by a few lists and ranked exactly.

Centroids are fitted on a bounded sample (`sample` rows, the least hashes of their keys); every row, sampled or
not, is listed.  Lists are folders of files of bounded size, so that a list that holds a third of all rows is many
files, and a task reads pairs of a query file and a vector file.  A query is sent to its `probes` nearest lists; the
vectors there are scored by their exact cosine.  What lies in other lists is not seen: results are approximate, and
callers say so.  Vectors that are null or all zeros are in no list; a query of that kind finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.retrieval import neighbours
from siltstone.types import EngineError

SAMPLE = 1 << 16
ROUNDS = 10


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit vectors that the sample's rows gather around: spherical k-means, started from rows spread over the sample."""
    rows = _unit(sample)
    at = rows[np.linspace(0, len(rows) - 1, min(lists, len(rows))).astype(int)]
    for _ in range(rounds):
        near = (rows @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, rows)
        some = np.bincount(near, minlength=len(at)) > 0
        at = np.where(some[:, None], _unit(sums), at)
    return at


def _whole(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are of the width and not all zeros, and these."""
    fits = np.array([x is not None and len(x) == width for x in column.to_pylist()], bool)
    v = np.array(column.filter(pa.array(fits)).flatten().fill_null(0).to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    v = np.where(np.isfinite(v), v, 0.0)
    some = (v != 0).any(1)
    fits[np.flatnonzero(fits)[~some]] = False
    return fits, v[some]


def _placed(rows: DataFrame, key: str, vector: str, at: np.ndarray, probes: int) -> DataFrame:
    """(list, k, v): each row with the lists that are nearest to it."""

    def run(batches):
        for batch in batches:
            fits, v = _whole(batch.column(1), at.shape[1])
            near = np.argsort(-(v @ at.T), axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.flatnonzero(fits), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["list", "k", "v"])

    chosen = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k IS NOT NULL")
    return chosen.mapInArrow(run, T.StructType([T.StructField("list", T.IntegerType()), *chosen.schema.fields]))


@dataclass(frozen=True)
class Index:
    """A folder of lists, and the centroids that name them."""

    folder: str
    at: np.ndarray

    def write(self, vectors: DataFrame, key: str, vector: str) -> None:
        """Add rows to their lists; a list's rows are dealt over as many files as they need."""
        placed = _placed(vectors, key, vector, self.at, 1).hint("rebalance", "list")
        placed.write.mode("append").option("maxRecordsPerFile", neighbours.VECTOR_ROWS).partitionBy("list").parquet(self.folder)

    def nearest(self, queries: DataFrame, k: int, key: str, vector: str, probes: int) -> DataFrame:
        """(query_id, key, score, position): the k nearest others among the lists probed, by cosine to nine places, then by key."""
        from pyspark.sql.pandas.types import to_arrow_type

        spark = queries.sparkSession
        kind = queries.schema[key].dataType
        asked = neighbours.scratch(spark, "queries")
        _placed(queries, key, vector, self.at, probes).hint("rebalance", "list").write.option("maxRecordsPerFile", neighbours.QUERY_ROWS).partitionBy("list").parquet(asked)
        mine, theirs = (_by_list(f) for f in (asked, self.folder))
        pairs = [(q, v) for at in sorted(mine) for q in mine[at] for v in theirs.get(at, [])]
        cells = spark.createDataFrame(pairs, "q string, v string").repartition(max(1, min(len(pairs), 16 * spark.sparkContext.defaultParallelism)), "q")
        name = kind.simpleString()
        found = cells.sortWithinPartitions("q", "v").mapInArrow(neighbours.file_pairs(asked, self.folder, k, to_arrow_type(kind)), f"query_id {name}, key {name}, score double")
        best = found.filter("score IS NOT NULL").withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")))
        return best.filter(F.col("position") <= k).withColumnRenamed("key", key)


def _by_list(folder: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for path in neighbours.files_below(folder):
        out.setdefault(path.split("/")[-2], []).append(path)
    return out


def build(vectors: DataFrame, folder: str, lists: int, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> Index:
    """An index of all rows; its centroids come from at most `sample` of them."""
    few = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    chosen = [r.v for r in few.orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(sample).collect()]
    if not chosen:
        raise EngineError("NOT_FOUND", "no vector to index")
    width = len(chosen[0])
    rows = np.array([[x if x is not None and np.isfinite(x) else 0.0 for x in v] for v in chosen if len(v) == width])
    index = Index(folder, centroids(rows[(rows != 0).any(1)], lists))
    index.write(vectors, key, vector)
    return index


def save(spark: SparkSession, index: Index, folder: str) -> None:
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(index.at)], "list int, centroid array<double>").coalesce(1).write.parquet(folder)


def load(spark: SparkSession, lists: str, folder: str) -> Index:
    """An index from the folders of its lists and of its centroids."""
    return Index(lists, np.array([r.centroid for r in spark.read.parquet(folder).orderBy("list").collect()]))
