"""Verifying a projection by digests of ranges: a tree of sums of row hashes, compared from the top, read only where it differs.

A key's hash names its leaf; a node's range is all keys whose hashes begin alike.  A table is written in folders by leaf,
with its tree beside it: of every node the number of its rows and the sums of two hashes of each, so that a node's are
the sums of its children's and do not depend on any order.  Two trees are compared level by level: below nodes that are
equal nothing is read, of the tree or of the rows.  What differs is read leaf by leaf, told as the full comparison tells
it, and put right by writing those leaves anew under a state that is committed last.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.facts import claim, read_small
from siltstone.retrieval.generations import mismatches
from siltstone.types import EngineError

SAMPLE = 20


@dataclass(frozen=True)
class Ranged:
    """A table (key, columns) in a folder, in fanout ** levels leaves; states of it are numbered files that list each leaf's folder."""

    folder: str
    key: str
    columns: tuple[str, ...]
    fanout: int = 16
    levels: int = 2

    @property
    def leaves(self) -> int:
        return self.fanout**self.levels

    def _leaf(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.leaves)).cast("int")

    def _hashes(self) -> list[Column]:
        """Two hashes of a row, as decimals that can be summed: text of the columns tells null from empty."""
        text = F.to_json(F.struct(F.col(self.key), *self.columns), {"ignoreNullFields": "false"})
        return [F.xxhash64(text, F.lit(seed)).cast("decimal(38,0)") for seed in (1, 2)]

    def _file(self, number: int) -> str:
        return f"{self.folder}/states/{number:012d}"

    def _last(self, spark: SparkSession) -> tuple[int, dict[str, str]]:
        number = 0
        while read_small(spark, self._file(number + 1)) is not None:
            number += 1
        return (number, json.loads(read_small(spark, self._file(number)))) if number else (0, {})

    def write(self, rows: DataFrame, leaves: list[int] | None = None) -> None:
        """Write the table, or of some leaves the whole rows, and commit it as the next state."""
        spark = rows.sparkSession
        number, state = self._last(spark)
        attempt = uuid.uuid4().hex
        placed = rows.select(self.key, *self.columns).withColumn("leaf", self._leaf())
        if leaves is not None:
            placed = placed.filter(F.col("leaf").isin(leaves))
        placed.hint("rebalance", "leaf").write.partitionBy("leaf").parquet(f"{self.folder}/rows/{attempt}")
        held = spark.read.schema(placed.schema).parquet(f"{self.folder}/rows/{attempt}")
        a, b = self._hashes()
        told = held.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"))
        # A row for each node: leaves, and above them the sums of their sums.
        tree = told.select(F.lit(self.levels).alias("level"), F.col("leaf").alias("node"), "n", "a", "b")
        before = self._tree(spark, state, self.levels).filter(~F.col("node").isin(leaves or [])) if state and leaves is not None else None
        if before is not None:
            tree = tree.unionByName(before)
        whole = tree
        for level in range(self.levels - 1, -1, -1):
            part = F.floor(F.col("node") / self.fanout ** (self.levels - level)).cast("int")
            whole = whole.unionByName(tree.groupBy(part.alias("node")).agg(*[F.sum(c).alias(c) for c in "nab"]).select(F.lit(level).alias("level"), "node", "n", "a", "b"))
        kinds = {"n": "long", "a": "decimal(38,0)", "b": "decimal(38,0)"}
        whole.select("level", "node", *[F.col(c).cast(t).alias(c) for c, t in kinds.items()]).repartition("level").write.partitionBy("level").parquet(f"{self.folder}/trees/{attempt}")
        full = [r.leaf for r in told.select("leaf").collect()]  # at most as many as there are leaves
        kept = {k: v for k, v in state.items() if k != "tree" and leaves is not None and int(k) not in leaves}
        if not claim(spark, self._file(number + 1), json.dumps({**kept, **{str(x): attempt for x in full}, "tree": attempt}, sort_keys=True)):
            raise EngineError("CONFLICT", "the projection was written meanwhile")

    def _tree(self, spark: SparkSession, state: dict[str, str], level: int) -> DataFrame:
        schema = "node int, n long, a decimal(38,0), b decimal(38,0)"
        path = f"{self.folder}/trees/{state['tree']}/level={level}" if "tree" in state else None
        if path is None or not _there(spark, path):
            return spark.createDataFrame([], "level int, " + schema)
        return spark.read.schema(schema).parquet(path).select(F.lit(level).alias("level"), "node", "n", "a", "b")

    def read(self, spark: SparkSession, leaves: list[int] | None = None) -> DataFrame:
        """The rows as of the last state, or those of some leaves only."""
        _, state = self._last(spark)
        paths = [f"{self.folder}/rows/{v}/leaf={k}" for k, v in sorted(state.items()) if k != "tree" and (leaves is None or int(k) in leaves)]
        if paths:
            return spark.read.parquet(*paths).select(self.key, *self.columns)
        any_ = next((f"{self.folder}/rows/{v}/leaf={k}" for k, v in state.items() if k != "tree"), None)
        if any_ is None:
            raise EngineError("NOT_FOUND", "the table has no rows")
        return spark.read.parquet(any_).select(self.key, *self.columns).limit(0)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def differing(spark: SparkSession, one: Ranged, other: Ranged) -> list[int]:
    """The leaves in which two tables differ, found from the top of their trees; at most as many numbers as there are leaves."""
    states = [x._last(spark)[1] for x in (one, other)]
    nodes: list[int] | None = None
    for level in range(one.levels + 1):
        a, b = (x._tree(spark, s, level) for x, s in zip((one, other), states, strict=True))
        if nodes is not None:
            part = F.floor(F.col("node") / one.fanout).cast("int")
            a, b = (t.filter(part.isin(nodes)) for t in (a, b))
        told = [F.struct("n", "a", "b").alias(n) for n in ("x", "y")]
        both = a.select("node", told[0]).join(b.select("node", told[1]), "node", "full").filter(~F.col("x").eqNullSafe(F.col("y")))
        nodes = sorted(r.node for r in both.select("node").collect())
        if not nodes:
            return []
    return nodes


def compared(spark: SparkSession, projection: Ranged, authority: Ranged) -> DataFrame:
    """(key, difference) of all keys of which the two differ; only leaves that differ are read."""
    leaves = differing(spark, projection, authority)
    return mismatches(projection.read(spark, leaves), authority.read(spark, leaves), projection.key, list(projection.columns))


def repaired(spark: SparkSession, projection: Ranged, authority: Ranged) -> int:
    """Write the projection's differing leaves anew from the authority; how many there were."""
    leaves = differing(spark, projection, authority)
    if leaves:
        projection.write(authority.read(spark, leaves), leaves)
    return len(leaves)


def sampled(spark: SparkSession, projection: Ranged, authority: Ranged, seed: int = 0, size: int = SAMPLE) -> DataFrame:
    """(key, same) of `size` keys of the authority, those of the least hashes with the seed: a spot check beside the digests."""
    rows = authority.read(spark)
    few = rows.orderBy(F.xxhash64(F.col(authority.key).cast("string"), F.lit(seed)), authority.key).limit(size)
    mine = projection.read(spark).select(F.col(projection.key).alias("_key"), F.struct(*projection.columns).alias("_held"))
    told = few.select(authority.key, F.struct(*authority.columns).alias("_true")).join(mine, F.col(authority.key) == F.col("_key"), "left")
    return told.select(authority.key, F.col("_true").eqNullSafe(F.col("_held")).alias("same"))
