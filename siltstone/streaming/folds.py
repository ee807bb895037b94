"""Stateful folds over streams: a record's requests in order, whatever order their files come in, and once.

State lives in Spark's state store, one value per record and a map of the requests that wait for those before them, so
that a stream goes on after a restart where its checkpoint says.  Requests carry `sequence`, their place among the
record's own from 1.  One that was applied or waits already is a repeat and does nothing; one that is early waits until the
gap before it is filled.  Outcomes are those of the batch fold over the same requests, each told once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siltstone.functions.canonical import canonical_json
from siltstone.operators.facts import Store
from siltstone.operators.mutate import Record
from siltstone.types import CollectionDefinition

REQUEST = "record_id string, sequence long, operation string, data string, set string, unset array<string>, expected_revision long"
OUTCOME = "record_id string, sequence long, operation string, outcome string, revision long, tombstone boolean, canonical_data string"
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """A record's state: its revision, document, whether it is deleted, and the next request to apply."""

    def __init__(self, definition: CollectionDefinition | None = None):
        self.definition = definition

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "revision long, document string, dead boolean, next long")
        self.waiting = handle.getMapState("waiting", "sequence long", "request string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = Record(self.definition)
        following = 1
        if self.record.exists():
            held.revision, document, held.dead, following = self.record.get()
            held.document = None if document is None else json.loads(document)
        # Most wait for nothing; the map is asked only while it may hold what comes next.
        some = next(iter(self.waiting.keys()), None) is not None
        for r in rows:
            request = [r.operation, r.data, r.set, list(r.unset) if r.unset is not None else None, r.expected_revision]
            if r.sequence > following:
                self.waiting.updateValue((r.sequence,), (json.dumps(request),))
                some = True
            elif r.sequence == following:
                yield self._told(key[0], following, held, *request)
                following += 1
                while some and self.waiting.containsKey((following,)):
                    waited = json.loads(self.waiting.getValue((following,))[0])
                    self.waiting.removeKey((following,))
                    yield self._told(key[0], following, held, *waited)
                    following += 1
            # A repeat of one that was applied changes nothing: requests do not change once they are made.
        self.record.update((held.revision, None if held.document is None else json.dumps(held.document), held.dead, following))

    @staticmethod
    def _told(record_id: str, sequence: int, held: Record, op: str, data, set_, unset, expected) -> Row:
        try:
            outcome = held.apply(op, data, set_, unset, expected)
        except ValueError:
            outcome = "INVALID_ARGUMENT"
        good = outcome == "ok"
        text = canonical_json(held.document) if good and held.document is not None else None
        return Row(record_id=record_id, sequence=sequence, operation=op, outcome=outcome, revision=held.revision if good else None, tombstone=held.dead, canonical_data=text)

    def close(self) -> None:
        pass


class Heads(StatefulProcessor):
    """Forward-only delivery: an event is told as `deliver` if it passes the key's head, else as `superseded`.

    Heads compare by generation, then revision.  A requeue of the head's own revision is told as `deliver` again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "generation long, revision long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        head = tuple(self.head.get()) if self.head.exists() else (-1, -1)
        for r in sorted(rows, key=lambda r: (r.generation, r.revision, bool(r.requeue))):
            mine = (r.generation, r.revision)
            state = "deliver" if mine > head or r.requeue and mine == head else "superseded"
            head = max(head, mine)
            yield Row(key=key[0], generation=r.generation, revision=r.revision, requeue=bool(r.requeue), state=state)
        self.head.update(head)

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def folded(requests: DataFrame, definition: CollectionDefinition | None = None) -> DataFrame:
    """The outcomes of a stream of requests (REQUEST), as they can be told."""
    return _stateful(requests, "record_id", Fold(definition), OUTCOME)


def delivered(events: DataFrame) -> DataFrame:
    """Events (key, generation, revision, requeue) with what their delivery comes to."""
    return _stateful(events, "key", Heads(), "key string, generation long, revision long, requeue boolean, state string")


def run(rows: DataFrame, store: Store, table: str, checkpoint: str):
    """Start a stream into a store's table: a micro-batch that is run again is committed once; all that is there, then stop."""
    conf = rows.sparkSession.conf
    before = conf.get(_STORE, None)
    conf.set(_STORE, _ROCKS)
    try:
        return rows.writeStream.foreachBatch(lambda batch, number: store.append({table: batch}, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            conf.unset(_STORE)
        else:
            conf.set(_STORE, before)


def requests_from(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Requests as a stream of a folder's files."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def sequenced(requests: DataFrame) -> DataFrame:
    """Requests with `ordinal` as REQUEST, numbered by record."""
    from pyspark.sql import Window

    optional = {"data": "string", "set": "string", "unset": "array<string>", "expected_revision": "long"}
    more = [(F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()]
    mine = F.row_number().over(Window.partitionBy("record_id").orderBy("ordinal")).cast("long")
    return requests.select(F.col("record_id").cast("string"), mine.alias("sequence"), "operation", *more)
