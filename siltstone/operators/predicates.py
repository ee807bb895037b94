"""Typed AND predicates: admission, then a Column that Catalyst pushes to the scan."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.canonical import instant_sort_key
from siltstone.types import MAX_IN_VALUES, MAX_PREDICATES, MAX_REQUEST_BYTES, OPERATORS, CollectionDefinition, EngineError, canonical_instant, instant_key


def _value(kind: str, value):
    ok = {
        "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "date-time": lambda v: isinstance(v, str),
        "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v),
    }.get(kind)
    if ok is None or not ok(value):
        raise EngineError("INVALID_ARGUMENT", f"a value is not of kind {kind}")
    return canonical_instant(value) if kind == "date-time" else float(value) if kind == "number" else value


def admit(predicates: list[dict]) -> list[dict]:
    """The predicates as they will be compiled; an error for anything the grammar does not have."""
    if not isinstance(predicates, list) or len(predicates) > MAX_PREDICATES:
        raise EngineError("INVALID_ARGUMENT", f"at most {MAX_PREDICATES} predicates")
    if len(json.dumps(predicates, default=str).encode()) > MAX_REQUEST_BYTES:
        raise EngineError("INVALID_ARGUMENT", "the request is too large")
    out = []
    for p in predicates:
        op = p.get("operator") if isinstance(p, dict) else None
        wanted = {"field", "kind", "operator"} | ({"value"} if op != "isNull" else set())
        if op not in OPERATORS or set(p) != wanted or not isinstance(p["field"], str):
            raise EngineError("INVALID_ARGUMENT", "a predicate has field, kind, operator and value")
        if op == "isNull":
            if p["kind"] != "null":
                raise EngineError("INVALID_ARGUMENT", "isNull is of kind null")
            out.append(dict(p))
        elif op == "in":
            values = p["value"]
            if not isinstance(values, list) or not 1 <= len(values) <= MAX_IN_VALUES:
                raise EngineError("INVALID_ARGUMENT", f"in takes 1 to {MAX_IN_VALUES} values")
            out.append(dict(p) | {"value": [_value(p["kind"], v) for v in values]})
        else:
            out.append(dict(p) | {"value": _value(p["kind"], p["value"])})
    return out


def _micros(instant: str) -> Column | None:
    """The instant as a timestamp, if it is a whole number of microseconds and no leap second."""
    if instant[17:19] == "60" or len(instant) > len("0000-00-00T00:00:00.000000Z"):
        return None
    return F.to_timestamp(F.lit(instant))


def _column(p: dict, columns: list[str]) -> Column:
    kind, value = F.col(f"{p['field']}__kind"), F.col(f"{p['field']}__val")
    if p["operator"] == "isNull":
        return kind == "null"
    stamps = [_micros(v) for v in (p["value"] if p["operator"] == "in" else [p["value"]])] if p["kind"] == "date-time" and f"{p['field']}__ts" in columns else [None]
    if all(s is not None for s in stamps):
        value, wanted = F.col(f"{p['field']}__ts"), stamps
    elif p["kind"] == "date-time":
        value, wanted = instant_sort_key(value), [instant_key(v) for v in (p["value"] if p["operator"] == "in" else [p["value"]])]
    else:
        wanted = p["value"] if p["operator"] == "in" else [p["value"]]
    test = {"eq": lambda: value == wanted[0], "lt": lambda: value < wanted[0], "lte": lambda: value <= wanted[0], "gt": lambda: value > wanted[0], "gte": lambda: value >= wanted[0], "in": lambda: value.isin(wanted)}
    return (kind == p["kind"]) & test[p["operator"]]()


def condition(predicates: list[dict], definition: CollectionDefinition | None = None, columns: list[str] | tuple = ()) -> Column:
    """The conjunction of admitted predicates; with a definition, fields must be ready and of the kind named.

    `columns` are the table's: where it has a field's <field>__ts, instants are compared as timestamps, which the
    scan can take over.
    """
    admitted = admit(predicates)
    for p in admitted if definition else []:
        definition.ready(p["field"], None if p["operator"] == "isNull" else p["kind"])
    return reduce(lambda a, b: a & b, [_column(p, list(columns)) for p in admitted], F.lit(True))


def where(df: DataFrame, predicates: list[dict], definition: CollectionDefinition | None = None) -> DataFrame:
    return df.filter(condition(predicates, definition, df.columns))


def count_records(df: DataFrame, predicates: list[dict]) -> DataFrame:
    return where(df, predicates).agg(F.count(F.lit(1)).alias("n"))


def exists_record(df: DataFrame, predicates: list[dict]) -> DataFrame:
    """One row: whether any record matches; the scan stops at the first."""
    return where(df, predicates).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))
