"""Snapshot jobs: a bounded aggregate or export of what was live at a feed position, as one Spark job.

A job is admitted by its budgets, read at its watermark, and written as partial results by cut of the records; what
a lost executor or a stopped job left is Spark's to repeat, and only a whole job's parts are merged.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import history
from siltstone.operators.facts import claim, read_small
from siltstone.types import EngineError


@dataclass(frozen=True)
class Job:
    """What a job may read and until when; `state` is open, cancelled or done."""

    folder: str
    watermark: int
    max_records: int | None = None
    max_bytes: int | None = None
    expires: datetime.datetime | None = None
    state: str = "open"

    def cancelled(self) -> Job:
        if self.state == "done":
            raise EngineError("CONFLICT", "the job is done")
        return replace(self, state="cancelled")

    def admit(self, rows: DataFrame, size: str | None = None) -> None:
        """An error if the job is no longer open or its rows pass its budgets."""
        if self.state != "open":
            raise EngineError("CONFLICT", f"the job is {self.state}")
        if self.expires is not None and datetime.datetime.now(self.expires.tzinfo) >= self.expires:
            raise EngineError("CONFLICT", "the job has expired")
        if self.max_records is None and self.max_bytes is None:
            return
        told = rows.agg(F.count(F.lit(1)).alias("n"), (F.sum(size) if size else F.lit(0)).alias("b")).first()
        if self.max_records is not None and told.n > self.max_records:
            raise EngineError("BACKPRESSURE", f"{told.n} records", limit="records")
        if self.max_bytes is not None and (told.b or 0) > self.max_bytes:
            raise EngineError("BACKPRESSURE", f"{told.b} bytes", limit="bytes")


def run(job: Job, rows: DataFrame, key: str, partial: Callable[[DataFrame, list[str]], DataFrame], cuts: int = 8, size: str | None = None, position: str | None = None) -> Job:
    """Write the partial results of rows up to the watermark, by cut of the records; the job as it is then."""
    at = rows if position is None else rows.filter(F.col(position) <= job.watermark)
    job.admit(at, size)
    dealt = at.withColumn("cut", F.pmod(F.xxhash64(key), F.lit(cuts)).cast("int"))
    partial(dealt, ["cut"]).write.mode("overwrite").partitionBy("cut").parquet(job.folder)
    return replace(job, state="done")


def cancel(spark: SparkSession, job: Job) -> bool:
    """Stop a job from outside, also while it runs: it writes no further cut. False if it was stopped or done before."""
    return claim(spark, f"{job.folder}/stopped", "cancelled")


def _open(spark: SparkSession, job: Job) -> None:
    stopped = read_small(spark, f"{job.folder}/stopped")
    if stopped:
        raise EngineError("CONFLICT", f"the job is {stopped}")
    job.admit(spark.range(0))


def run_as_of(job: Job, log: DataFrame, payload: list[str], partial: Callable[[DataFrame, list[str]], DataFrame], cuts: int = 8) -> Job:
    """A job over the records live at its watermark, cut by cut: it stops between cuts when it was cancelled or has expired.

    The snapshot is written once, by cut; a run that is started again goes on with the cuts that are not there yet.
    What is written after the watermark changes nothing.
    """
    spark = log.sparkSession
    _open(spark, job)
    snapshot = f"{job.folder}/snapshot"
    if read_small(spark, f"{job.folder}/taken") is None:
        live = history.as_of(log, job.watermark, payload)
        job.admit(live)
        live.withColumn("cut", F.pmod(F.xxhash64("record_id"), F.lit(cuts)).cast("int")).write.mode("overwrite").partitionBy("cut").parquet(snapshot)
        claim(spark, f"{job.folder}/taken", str(cuts))
    dealt = spark.read.parquet(snapshot)
    for cut in range(int(read_small(spark, f"{job.folder}/taken"))):
        if read_small(spark, f"{job.folder}/cuts/{cut}") is None:
            _open(spark, job)
            partial(dealt.filter(F.col("cut") == cut), ["cut"]).write.mode("overwrite").parquet(f"{job.folder}/parts/of={cut}")
            claim(spark, f"{job.folder}/cuts/{cut}", "done")
    if not claim(spark, f"{job.folder}/stopped", "done"):
        _open(spark, job)
    return replace(job, folder=f"{job.folder}/parts", state="done")


def merged(spark: SparkSession, job: Job, final: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The final result over all parts of a job that is done."""
    if job.state != "done":
        raise EngineError("CONFLICT", f"the job is {job.state}")
    return final(spark.read.parquet(job.folder).drop("cut", "of"))
