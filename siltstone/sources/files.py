"""Sources and sinks: JSON records, texts, binary files, references, NDJSON exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.history import manifest
from siltstone.types import EXPORT_PAGES, EngineError

MAX_TEXT = 1 << 20


def records(spark: SparkSession, path: str) -> DataFrame:
    """Lines {"id", "revision", "data"} as record_id, revision and the document's text."""
    line = F.try_parse_json("value")
    got = spark.read.text(path).withColumn("v", line)
    return got.select(F.try_variant_get("v", "$.id", "string").alias("record_id"), F.try_variant_get("v", "$.revision", "long").alias("revision"), F.to_json(F.try_variant_get("v", "$.data", "variant")).alias("canonical_data"))


def signature(rows: DataFrame) -> tuple:
    """What tells one state of a table's files from another: their paths, lengths and times of change."""
    spark, out = rows.sparkSession, []
    for file in sorted(rows.inputFiles()):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        told = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append((file, told.getLen(), told.getModificationTime()))
    return tuple(out)


def digested(rows: DataFrame, content: str) -> DataFrame:
    """Rows with the length in bytes and the SHA-256 of their content; a reference has no bytes, so neither."""
    return rows.withColumn("n_bytes", F.octet_length(content).cast("long")).withColumn("sha256", F.sha2(F.col(content), 256))


def text_sources(spark: SparkSession, path: str, mime: str = "text/plain") -> DataFrame:
    """Whole text files as sources; one of over a mebibyte is refused with a code."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("locator"), "content")
    out = digested(rows, "content").withColumn("mime", F.lit(mime))
    return out.withColumn("code", F.when(F.col("n_bytes") > MAX_TEXT, "INVALID_ARGUMENT")).withColumn("content", F.when(F.col("n_bytes") <= MAX_TEXT, F.col("content")))


def binary_sources(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Binary files with digests; with the expected ones (locator, sha256), whether they hold."""
    rows = digested(spark.read.format("binaryFile").load(path).select(F.col("path").alias("locator"), "content"), "content")
    if expected is None:
        return rows
    told = expected.select("locator", F.col("sha256").alias("expected"))
    return rows.join(told, "locator", "left").withColumn("verified", F.coalesce(F.col("expected") == F.col("sha256"), F.lit(False))).drop("expected")


def write_export(pages: DataFrame, folder: str) -> dict:
    """Write pages and their manifest; the manifest comes last, so a folder that has one is whole."""
    spark = pages.sparkSession
    pages.write.mode("overwrite").parquet(f"{folder}/pages")
    whole = spark.read.parquet(f"{folder}/pages")
    if whole.count() > EXPORT_PAGES:
        raise EngineError("RESULT_TOO_LARGE", f"more than {EXPORT_PAGES} pages")
    sealed = manifest(whole).first().asDict()
    spark.createDataFrame([(json.dumps(sealed, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return sealed


def verify_export(spark: SparkSession, folder: str) -> DataFrame:
    """The export's lines, if every page and the manifest hold."""
    told = json.loads(spark.read.text(f"{folder}/manifest").first().value)
    pages = spark.read.parquet(f"{folder}/pages")
    if not pages.filter((F.sha2("body", 256) != F.col("sha256")) | (F.octet_length("body") != F.col("bytes"))).isEmpty() or manifest(pages).first().asDict() != told:
        raise EngineError("CONFLICT", "the export is not what its manifest says")
    return pages.select(F.explode(F.split(F.regexp_replace("body", "\n$", ""), "\n")).alias("line"))
