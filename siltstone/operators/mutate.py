"""Mutations: validation, the fold of requests over a record, uniques, receipts, batches.

The fold goes over a partition sorted by record and arrival, one request at a time, so a record with any
number of requests needs no more memory than its current document.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.canonical import canonical_json
from siltstone.operators import schemas
from siltstone.types import MAX_DEPTH, MAX_NODES, SAFE_INTEGER, CollectionDefinition, EngineError, canonical_instant


def _nodes(value, depth: int = 1) -> int:
    if depth > MAX_DEPTH:
        raise EngineError("SCHEMA_INVALID", "too deep")
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return 1 + sum(_nodes(v, depth + 1) for v in inner)


def check(document, definition: CollectionDefinition) -> str | None:
    """The code of the first fault of a whole record, or None."""
    if not isinstance(document, dict):
        return "SCHEMA_INVALID"
    if definition.schema is not None:
        try:
            return None if schemas.of_text(definition.schema)(document) is None else "SCHEMA_INVALID"
        except (EngineError, OverflowError):
            return "SCHEMA_INVALID"
    try:
        if _nodes(document) > MAX_NODES:
            return "SCHEMA_INVALID"
        canonical_json(document)
        names = {f.name for f in definition.fields}
        if not set(document) <= names:
            return "SCHEMA_INVALID"
        for f in definition.fields:
            if f.name not in document:
                if f.required:
                    return "SCHEMA_INVALID"
                continue
            v = document[f.name]
            if v is None:
                if not f.nullable:
                    return "SCHEMA_INVALID"
                continue
            number = isinstance(v, int | float) and not isinstance(v, bool)
            fits = {"string": isinstance(v, str), "date-time": isinstance(v, str), "boolean": isinstance(v, bool), "number": number}[f.kind]
            if not fits or f.integer and (v != int(v) or abs(v) > SAFE_INTEGER) or f.enum and v not in f.enum:
                return "SCHEMA_INVALID"
            if f.kind == "date-time" and canonical_instant(v) != v:
                return "SCHEMA_INVALID"
    except (EngineError, OverflowError):
        return "SCHEMA_INVALID"
    return None


def moved(before: dict | None, after: dict, definition: CollectionDefinition) -> str | None:
    """The fault of a lifecycle move, or None."""
    if not definition.lifecycle:
        return None
    was, now = (before or {}).get(definition.lifecycle), after.get(definition.lifecycle)
    if before is None:
        return None if not definition.initial or now in definition.initial else "SCHEMA_INVALID"
    return None if was == now or now in definition.transitions.get(was, ()) else "SCHEMA_INVALID"


class Record:
    """A record's state while its requests are folded."""

    def __init__(self, definition: CollectionDefinition | None):
        self.definition, self.revision, self.document, self.dead = definition, 0, None, False

    def apply(self, op: str, data: str | None, set_: str | None, unset: list[str] | None, expected: int | None) -> str:
        if op == "create":
            if self.revision:
                return "KEY_RESERVED" if self.dead else "CONFLICT"
            new = json.loads(data or "{}")
        elif not self.revision or self.dead:
            return "NOT_FOUND"
        elif expected is not None and expected != self.revision:
            return "REVISION_CONFLICT"
        elif op == "delete":
            self.dead, self.revision, self.document = True, self.revision + 1, None
            return "ok"
        elif op == "replace":
            new = json.loads(data or "{}")
        elif op == "patch":
            if self.definition and any(not self.definition.optional(k) for k in unset or []):
                return "INVALID_ARGUMENT"
            new = {k: v for k, v in self.document.items() if k not in (unset or [])} | json.loads(set_ or "{}")
        else:
            return "INVALID_ARGUMENT"
        if self.definition:
            fault = check(new, self.definition) or moved(self.document, new, self.definition)
            if fault:
                return fault
        self.document, self.revision = new, self.revision + 1
        return "ok"


FOLDED = "record_id string, ordinal long, operation string, outcome string, revision long, tombstone boolean, canonical_data string"


def _fold(definition: CollectionDefinition | None):
    def run(batches):
        record_id, record = None, None
        for batch in batches:
            out = []
            for key, ordinal, op, data, set_, unset, expected in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if record is None or key != record_id:
                    record_id, record = key, Record(definition)
                try:
                    outcome = record.apply(op, data, set_, unset, expected)
                except ValueError:
                    outcome = "INVALID_ARGUMENT"
                text = canonical_json(record.document) if outcome == "ok" and record.document is not None else None
                out.append((key, ordinal, op, outcome, record.revision if outcome == "ok" else None, record.dead, text))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FOLDED.split(", ")])

    return run


def fold(requests: DataFrame, definition: CollectionDefinition | None = None) -> DataFrame:
    """Every request's outcome and, where it was applied, the after-image; requests of a record go by `ordinal`.

    Columns: record_id, ordinal, operation, data, set, unset, expected_revision (the last four may be null).
    """
    columns = [F.col("record_id").cast("string"), F.col("ordinal").cast("long"), "operation"]
    optional = {"data": "string", "set": "string", "unset": "array<string>", "expected_revision": "long"}
    columns += [(F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in optional.items()]
    dealt = requests.select(*columns).repartition("record_id").sortWithinPartitions("record_id", "ordinal")
    return dealt.mapInArrow(_fold(definition), FOLDED)


def unique_outcomes(requests: DataFrame, unique: str, reserved: DataFrame | None = None, order: str = "ordinal") -> DataFrame:
    """Each request with `outcome`: the first of a tuple holds it, later ones conflict; null tuples reserve nothing.

    `reserved` has earlier holders: the tuple and whether its record is a tombstone.  `order` names each request once.
    """
    some = requests.filter(F.col(unique).isNotNull())
    first = some.groupBy(unique).agg(F.min(order).alias("_first"))
    rows, dead = some.join(first, unique), F.lit(None).cast("boolean")
    if reserved is not None:
        rows, dead = rows.join(reserved.select(unique, F.col("tombstone").alias("_dead")), unique, "left"), F.col("_dead")
    outcome = F.when(dead, "KEY_RESERVED").when(~F.coalesce(dead, F.lit(True)), "UNIQUE_CONFLICT").when(F.col(order) == F.col("_first"), "ok").otherwise("UNIQUE_CONFLICT")
    free = requests.filter(F.col(unique).isNull()).withColumn("outcome", F.lit("ok"))
    return rows.select(*requests.columns, outcome.alias("outcome")).unionByName(free)


def receipts(requests: DataFrame, identity: list[str], digest: str, order: str) -> DataFrame:
    """Each request with `outcome`: the first of an identity applies, the same again replays, another mismatches."""
    first = requests.groupBy(*[F.col(c).alias(f"_{c}") for c in identity]).agg(F.min_by(F.struct(order, digest), order).alias("_first"))
    both = F.lit(True)
    for c in identity:
        both = both & F.col(c).eqNullSafe(F.col(f"_{c}"))
    outcome = F.when(F.col(order) == F.col(f"_first.{order}"), "applied").when(F.col(digest) == F.col(f"_first.{digest}"), "replayed").otherwise("IDEMPOTENCY_MISMATCH")
    return requests.join(first, both).select(*requests.columns, outcome.alias("outcome"))


def batch_status(items: DataFrame, batch: str, outcome: Column) -> DataFrame:
    """Per batch its items, how many succeeded or failed, the manifest's digest, and whether a retry is due."""
    good = F.count_if(outcome)
    # A batch has twenty items at most.
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "item"))), lambda s: s.item), "\n"), 256)
    return items.groupBy(batch).agg(F.count(F.lit(1)).alias("items"), good.alias("succeeded"), (F.count(F.lit(1)) - good).alias("failed"), digest.alias("digest")).withColumn("retry", F.col("failed") > 0)


def move_allowed(was: Column, now: Column, definition: CollectionDefinition) -> Column:
    """Whether a lifecycle field may go from one state to the next; from null, into an initial one."""
    allowed = F.when(was.isNull(), now.isin(list(definition.initial)))
    for state, nexts in definition.transitions.items():
        if state is not None:
            allowed = allowed.when(was == state, now.isin([state, *nexts]))
    return F.coalesce(allowed.otherwise(now == was), F.lit(False))


def batch_items(items: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """The items of batches (batch, ordinal, outcome) with their `state`: as they came out, else pending, or cancelled with their batch."""
    rows = items
    stopped = F.lit(None).cast("boolean")
    if cancelled is not None:
        rows, stopped = items.join(cancelled.select("batch").distinct().withColumn("_stopped", F.lit(True)), "batch", "left"), F.col("_stopped")
    state = F.when(F.col("outcome").isNotNull(), F.col("outcome")).when(stopped, "cancelled").otherwise("pending")
    told = rows.withColumn("state", state).withColumn("stopped", F.coalesce(stopped, F.lit(False)))
    return told.select(*items.columns, "state", "stopped")


def batch_todo(status: DataFrame, retry_failed: bool = False) -> DataFrame:
    """The items that a resumption has to do: those pending, and on request those that failed; none of a cancelled batch."""
    wanted = ["pending", "failed"] if retry_failed else ["pending"]
    return status.filter(F.col("state").isin(wanted) & ~F.col("stopped"))
