"""Stored uniques and receipts: a table in buckets of which a batch rewrites those that it touches, under one commit.

A state is what the latest commit file lists: of each bucket, the folder that holds it.  A batch reads the buckets of its
own keys, writes them anew to a folder of its own, and commits by creating the next state's file, which only one writer
can.  A stop before that leaves folders that no state names.  A batch that is committed answers again with the outcomes
that it saved.

* A request whose identity has a receipt that has not expired replays it, if the digest is the same, or is a mismatch;
  this comes before any other check.
* A tuple is reserved for ever by the first request that took it, also after its record was deleted: later ones are a
  UNIQUE_CONFLICT, or KEY_RESERVED where the holder is a tombstone.  A null tuple reserves nothing.
* A request that fails leaves no receipt, so the next of its identity is a first one again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.facts import claim, read_small
from siltstone.types import EngineError

KEYS = "tuple string, record_id string, tombstone boolean"
RECEIPTS = "identity string, digest string, receipt string, expires_at long"
_TABLES = {"keys": ("tuple", KEYS), "receipts": ("identity", RECEIPTS)}


@dataclass(frozen=True)
class Ledger:
    folder: str
    buckets: int = 32

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def _state(self, spark: SparkSession) -> tuple[int, dict]:
        """The latest state's number, and what it lists."""
        at = 0
        step = 1
        # States are numbered without gaps: doubled steps find one beyond, halved ones the last.
        while read_small(spark, self._file(at + step)) is not None:
            at, step = at + step, step * 2
        while step > 1:
            step //= 2
            if read_small(spark, self._file(at + step)) is not None:
                at += step
        if at == 0:
            return 0, {"keys": {}, "receipts": {}}
        state = json.loads(read_small(spark, self._file(at)))
        # A writer that stopped after its commit may have left its batch without the file that finds it.
        claim(spark, f"{self.folder}/batches/{state['batch']}", state["attempt"])
        return at, state

    def _file(self, number: int) -> str:
        return f"{self.folder}/states/{number:012d}"

    def _read(self, spark: SparkSession, table: str, listed: dict, only: list[int] | None = None) -> DataFrame:
        wanted = [f"{self.folder}/{table}/{attempt}/bucket={b}" for b, attempt in sorted(listed.items(), key=lambda x: int(x[0])) if only is None or int(b) in only]
        schema = _TABLES[table][1]
        return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """The keys or the receipts as of the latest state."""
        return self._read(spark, name, self._state(spark)[1][name])

    def _touched(self, rows: DataFrame, key: str) -> list[int]:
        # As many numbers as there are buckets.
        return sorted(r.b for r in rows.filter(F.col(key).isNotNull()).select(self._bucket(key).alias("b")).distinct().collect())

    def apply(self, requests: DataFrame, batch: int, now: int, deleted: DataFrame | None = None, ttl: int = 86_400) -> DataFrame:
        """(ordinal, outcome, receipt) of a batch's requests (ordinal, identity, digest, tuple, record_id), by ordinal.

        `deleted` has the record_id and tuple of holders that the batch deletes before its requests; `now` and `ttl` are
        seconds.  The requests' ordinals differ.
        """
        spark = requests.sparkSession
        number, state = self._state(spark)
        saved = read_small(spark, f"{self.folder}/batches/{batch}")
        if saved is not None:
            return spark.read.parquet(f"{self.folder}/outcomes/{saved}")
        attempt = uuid.uuid4().hex
        mine = f"{self.folder}/attempts/{attempt}"
        requests.select("ordinal", "identity", "digest", "tuple", "record_id").write.parquet(f"{mine}/requests")
        asked = spark.read.parquet(f"{mine}/requests")
        gone = deleted.select("tuple", "record_id").filter("tuple IS NOT NULL").distinct() if deleted is not None else spark.createDataFrame([], "tuple string, record_id string")
        touched = {"keys": self._touched(asked.select("tuple").unionByName(gone.select("tuple")), "tuple"), "receipts": self._touched(asked, "identity")}
        held = {name: self._read(spark, name, state[name], touched[name]) for name in _TABLES}
        dead = gone.withColumn("_gone", F.lit(True))
        keys = held["keys"].join(dead, ["tuple", "record_id"], "left").select("tuple", "record_id", (F.col("tombstone") | F.coalesce("_gone", F.lit(False))).alias("tombstone"))
        receipts = held["receipts"].filter(F.col("expires_at") > now)
        told = self._decided(asked, keys, receipts, mine)
        taken = told.filter("outcome = 'applied'").join(asked, "ordinal")
        made = taken.select("identity", "digest", "receipt", F.lit(now + ttl).cast("long").alias("expires_at")).filter("identity IS NOT NULL")
        new = {
            "keys": keys.unionByName(taken.filter("tuple IS NOT NULL").select("tuple", "record_id", F.lit(False).alias("tombstone"))),
            "receipts": receipts.unionByName(made),
        }
        after: dict = {"batch": batch, "attempt": attempt}
        for name, (key, _) in _TABLES.items():
            new[name].withColumn("bucket", self._bucket(key)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}/{attempt}")
            # A bucket that is read and left without rows is none.
            full = {r.bucket for r in spark.read.parquet(f"{self.folder}/{name}/{attempt}").select("bucket").distinct().collect()} if touched[name] else set()
            after[name] = {b: a for b, a in state[name].items() if int(b) not in touched[name]} | {str(b): attempt for b in full}
        told.select("ordinal", "outcome", "receipt").write.parquet(f"{self.folder}/outcomes/{attempt}")
        if not claim(spark, self._file(number + 1), json.dumps(after, sort_keys=True)):
            raise EngineError("CONFLICT", "another batch was committed meanwhile; this one changed nothing")
        claim(spark, f"{self.folder}/batches/{batch}", attempt)
        return spark.read.parquet(f"{self.folder}/outcomes/{attempt}")

    def _decided(self, asked: DataFrame, keys: DataFrame, receipts: DataFrame, folder: str) -> DataFrame:
        """Outcomes of all requests: round by round those that come first of their identity and of their tuple among the undecided.

        A round decides, too, whatever the ones decided settle: all others of an identity that has its receipt now.
        A request waits for its forerunners only, so rounds are as many as the longest chain of those that fail.
        """
        spark = asked.sparkSession
        left, told, step = asked, None, 0
        known = receipts.select("identity", F.col("digest").alias("old"), "receipt")
        held = keys.select("tuple", "tombstone")
        while not left.isEmpty():
            step += 1
            of = left.filter("identity IS NOT NULL").groupBy("identity").agg(F.min("ordinal").alias("first_of_identity"))
            by = left.filter("tuple IS NOT NULL").groupBy("tuple").agg(F.min("ordinal").alias("first_of_tuple"))
            seen = left.join(of, "identity", "left").join(by, "tuple", "left").join(known, "identity", "left").join(held, "tuple", "left")
            first = F.coalesce(F.col("first_of_identity") == F.col("ordinal"), F.lit(True))
            free = F.coalesce(F.col("first_of_tuple") == F.col("ordinal"), F.lit(True))
            outcome = (
                F.when(F.col("old").isNotNull(), F.when(F.col("old").eqNullSafe(F.col("digest")), "replayed").otherwise("IDEMPOTENCY_MISMATCH"))
                .when(first & F.col("tombstone").isNotNull(), F.when(F.col("tombstone"), "KEY_RESERVED").otherwise("UNIQUE_CONFLICT"))
                .when(first & free, "applied")
            )
            mine = F.when(outcome == "replayed", F.col("receipt")).when(outcome == "applied", F.to_json(F.struct("record_id", "ordinal")))
            seen.select("ordinal", "identity", "digest", "tuple", "record_id", outcome.alias("outcome"), mine.alias("receipt")).write.parquet(f"{folder}/round{step}")
            rows = spark.read.parquet(f"{folder}/round{step}")
            decided = rows.filter("outcome IS NOT NULL")
            told = decided if told is None else told.unionByName(decided)
            left = rows.filter("outcome IS NULL").select(*asked.columns)
            good = decided.filter("outcome = 'applied'")
            known = known.unionByName(good.filter("identity IS NOT NULL").select("identity", F.col("digest").alias("old"), "receipt"))
            held = held.unionByName(good.filter("tuple IS NOT NULL").select("tuple", F.lit(False).alias("tombstone")))
        if told is None:
            return spark.createDataFrame([], "ordinal long, outcome string, receipt string")
        return told.select("ordinal", "outcome", "receipt")
