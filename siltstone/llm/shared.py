"""Shared-folder tables, id blooms and connected components for the operators of this subpackage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.scratch import scratch, shared_folder  # noqa: F401


def new_path(spark: SparkSession, name: str) -> str:
    return scratch(spark, name)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The table as written to the shared folder: lineage is cut, and a lost executor takes nothing along."""
    spark, path = df.sparkSession, path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one computation in the shared folder; those that no later step reads are deleted by name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, new_path(spark, name)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")


#: Bytes of texts that the JVM hands to a Python worker at once, where the session does not say.
BATCH_BYTES = "4m"


def batched(df: DataFrame) -> DataFrame:
    """The same table, for mapInArrow: unless the session sets them itself, its batches get a bound in bytes that texts of any length keep."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, BATCH_BYTES)
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where the table has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


#: Bits of a filter per key, and the most blocks of 512 bits that are broadcast (19 MB; 13 million keys).
BLOOM_BITS = 10
MAX_BLOCKS = 1 << 18
_WORDS = 8


def _bit(h: str, word: int):
    """The bit that a key sets in one 64-bit word of its block."""
    return F.expr(f"shiftleft(1L, cast(shiftright(`{h}`, {word * 7}) & 63 as int))")


@dataclass
class Bloom:
    """A blocked Bloom filter, one row per block that has keys, of eight 64-bit words; None where keys are too many for one."""

    table: DataFrame | None
    blocks: int

    def block(self, key):
        return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(self.blocks))


def bloom(keys: DataFrame, key: str) -> Bloom:
    """Blocked Bloom filter of a column, sized by the number of its rows.

    A key hashes to one block and sets one bit in each word of it. A filter that would be too large to broadcast
    is none: it passes every row, and the exact join behind it does all the work.
    """
    n = keys.count()
    blocks = 1 << max(4, (n * BLOOM_BITS // 512).bit_length())
    if blocks > MAX_BLOCKS:
        return Bloom(None, blocks)
    made = Bloom(None, blocks)
    hashed = keys.select(made.block(F.col(key)).alias("bloom_block"), F.xxhash64(F.col(key), F.lit(71)).alias("bloom_hash"))
    made.table = hashed.groupBy("bloom_block").agg(*[F.bit_or(_bit("bloom_hash", i)).alias(f"bloom_w{i}") for i in range(_WORDS)])
    return made


def maybe_listed(rows: DataFrame, key: str, filter_: Bloom, flag: str) -> DataFrame:
    """All rows, and in a column `flag` that they do not have yet, whether the filter may hold their key; it never holds a null."""
    known = F.col(key).isNotNull()
    if filter_.table is None:
        return rows.withColumn(flag, known)
    names = ["bloom_block", "bloom_hash", *[f"bloom_w{i}" for i in range(_WORDS)]]
    block, h, *words = fresh(rows, *names)
    table = filter_.table.select(F.col("bloom_block").alias(block), *[F.col(f"bloom_w{i}").alias(w) for i, w in enumerate(words)])
    probed = rows.withColumn(block, filter_.block(F.col(key))).withColumn(h, F.xxhash64(F.col(key), F.lit(71)))
    hit = known
    for i, w in enumerate(words):
        hit = hit & ((F.col(w).bitwiseAND(_bit(h, i))) != 0)
    return probed.join(F.broadcast(table), block, "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop(block, h, *words)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in the one-column table `gone`; only those the filter may hold are shuffled."""
    gone = written(gone.select(key).distinct(), "gone")
    (maybe,) = fresh(rows, "maybe")
    probed = maybe_listed(rows, key, bloom(gone, key), maybe)
    kept = probed.filter(~F.col(maybe)).unionByName(probed.filter(F.col(maybe)).join(gone, key, "left_anti"))
    return kept.select(*[F.col(f"`{c}`") for c in rows.columns])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node reachable, itself included.

    Alternating large-star and small-star steps, each a group minimum joined back to the links, so that no
    node's neighbours are ever gathered. A step's links are written to the shared folder.
    """
    scratch, step = Scratch(edges.sparkSession, "components"), 0
    links = scratch.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links0")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        links = scratch.written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"links{step + 1}")
        scratch.drop(f"links{step}")
        step += 1
        # Done when all are stars: no node has two centres, and no centre has one itself.
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("under"), F.lit(0).alias("over")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("under"), F.lit(1).alias("over")))
        if ends.groupBy("node").agg(F.sum("under").alias("under"), F.max("over").alias("over")).filter("under > 1 OR under > 0 AND over > 0").isEmpty():
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return roots.unionByName(links.select(F.col("a").alias("node"), F.col("b").alias("component")))
