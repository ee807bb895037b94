"""Facts appended together: events, outbox rows and receipts of a batch become visible at once, and once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.types import EngineError


def _file(spark: SparkSession, path: str):
    """A path of any file system that Spark reaches, and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file, which only the first can; whether this was the first.

    An empty file is what a writer left that stopped between the two steps; it counts as none.
    """
    at, files = _file(spark, path)
    if files.exists(at) and files.getFileStatus(at).getLen() > 0:
        return False
    try:
        out = files.create(at, files.exists(at))
    except Exception as e:  # another writer came first
        if files.exists(at):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return read_small(spark, path) == text


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    at, files = _file(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode() or None
    finally:
        stream.close()


@dataclass(frozen=True)
class Store:
    """A folder of tables, by batch and attempt; a batch counts once its commit names the attempt, which comes last.

    An attempt writes to folders of its own.  A batch that is committed is left as it is, so that a repeat, or one that
    stops half way, does no harm.  `append` is what a stream's foreachBatch calls with its batch id.
    """

    folder: str

    def _commit(self, batch: int) -> str:
        return f"{self.folder}/commits/{batch}"

    def committed(self, spark: SparkSession, batch: int) -> bool:
        return read_small(spark, self._commit(batch)) is not None

    def append(self, tables: dict[str, DataFrame], batch: int) -> bool:
        """Whether this attempt was the one that counts; not, where the batch is committed already."""
        spark = next(iter(tables.values())).sparkSession
        if self.committed(spark, batch):
            return False
        attempt = uuid.uuid4().hex
        for name, rows in sorted(tables.items()):
            rows.write.parquet(f"{self.folder}/{name}/batch={batch}/attempt={attempt}")
        return claim(spark, self._commit(batch), attempt)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The rows of a table in the batches committed."""
        at, files = _file(spark, f"{self.folder}/commits")
        if not files.exists(at):
            raise EngineError("NOT_FOUND", "no batch is committed")
        name_of = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        done = spark.read.text(f"{self.folder}/commits").select(name_of.cast("long").alias("batch"), F.col("value").alias("attempt"))
        rows = spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")
        key = [rows.batch.cast("long") == done.batch, rows.attempt.cast("string") == done.attempt]
        return rows.join(done, key, "left_semi").drop("batch", "attempt")
