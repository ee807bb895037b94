"""Bounded exact aggregation: up to three group keys, typed metrics, all or nothing.

A spec is admitted on the driver, compiled to one DataFrame (partial and final hash aggregation over the wide
columns), and only the groups, at most a thousand and one, are collected for the envelope.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import exact, timebuckets
from siltstone.functions.canonical import instant_sort_key, instant_text, instant_timestamp
from siltstone.operators.predicates import admit, where
from siltstone.operators.projection import require_complete
from siltstone.types import DEFAULT_GROUPS, MAX_GROUP_BY, MAX_GROUP_BYTES, MAX_GROUPS, MAX_METRICS, METRICS, UNITS, CollectionDefinition, EngineError


@dataclass(frozen=True)
class Key:
    field: str
    unit: str | None = None
    zone: str = "UTC"


@dataclass(frozen=True)
class Metric:
    op: str
    field: str | None = None

    @property
    def name(self) -> str:
        return f"{self.field}_{self.op}" if self.field else "n"


@dataclass(frozen=True)
class Spec:
    where: tuple = ()
    group_by: tuple[Key, ...] = ()
    metrics: tuple[Metric, ...] = (Metric("count"),)
    max_groups: int = DEFAULT_GROUPS

    def admit(self, definition: CollectionDefinition) -> None:
        if len(self.group_by) > MAX_GROUP_BY or not 1 <= len(self.metrics) <= MAX_METRICS or not 1 <= self.max_groups <= MAX_GROUPS:
            raise EngineError("INVALID_ARGUMENT", "too many keys, metrics or groups")
        admit(list(self.where))
        for k in self.group_by:
            kind = definition.ready(k.field, None).kind
            if (kind == "date-time") != (k.unit is not None) or k.unit not in (None, *UNITS):
                raise EngineError("INVALID_ARGUMENT", f"{k.field} is grouped by a unit if it is a date-time")
            timebuckets.resolve(k.zone)
        for m in self.metrics:
            if m.op not in METRICS or (m.op == "count") != (m.field is None):
                raise EngineError("INVALID_ARGUMENT", "count takes no field, other metrics one")
            kind = definition.ready(m.field, None).kind if m.field else None
            if m.op in ("sum", "avg") and kind != "number" or m.op in ("min", "max") and kind == "boolean":
                raise EngineError("INVALID_ARGUMENT", f"{m.op} of {kind}")


def group_rank(kind: Column) -> Column:
    """Values before null before missing."""
    return F.when(kind == "null", 1).when(kind == "missing", 2).otherwise(0)


def _timestamp(df: DataFrame, name: str) -> Column:
    """The field's instant: the projection's own timestamp column <field>__ts where it has one."""
    return F.col(f"{name}__ts") if f"{name}__ts" in df.columns else instant_timestamp(F.col(f"{name}__val"))


def aggregated(df: DataFrame, spec: Spec, definition: CollectionDefinition, odd: str = "error") -> DataFrame:
    """One row per group, in order: key kinds and values, metrics, and values, nulls and missing of each field.

    A key column is <field>__kind and <field>__val (for buckets the UTC start, with <field>__local beside it); a
    group's count is n.  More than max_groups groups come as one too many, for the caller to refuse.

    Sums of values that no common scale holds are `odd`: an error, or exact by a second path over the rows
    ("exact"), or null for a caller that looks for them ("null").
    """
    spec.admit(definition)
    rows = where(df, list(spec.where), definition)
    keys, outs, order = [], [], []
    for k in spec.group_by:
        kind, value = F.col(f"{k.field}__kind"), F.col(f"{k.field}__val")
        if k.unit:
            # Days and longer are grouped by the zone's clock; only the groups are turned back into instants.
            ts = _timestamp(df, k.field)
            value = timebuckets.bucket(ts, k.unit, k.zone) if k.unit == "hour" else timebuckets.local_start(ts, k.unit, k.zone)
        keys += [kind.alias(f"_{k.field}_kind"), F.when(kind.isin("null", "missing"), None).otherwise(value).alias(f"_{k.field}_val")]
        held = F.col(f"_{k.field}_val")
        if k.unit and k.unit != "hour":
            held = timebuckets.utc_start(held, k.zone)
        outs += [F.col(f"_{k.field}_kind").alias(f"{k.field}__kind"), (timebuckets.label(held) if k.unit else held).alias(f"{k.field}__val")]
        if k.unit:
            outs.append(timebuckets.local_label(held, k.zone).alias(f"{k.field}__local"))
        order += [group_rank(F.col(f"_{k.field}_kind")), F.col(f"_{k.field}_val")]
    aggs = [F.count(F.lit(1)).alias("n")]
    fields = list(dict.fromkeys(m.field for m in spec.metrics if m.field))
    for f in fields:
        kind, value, declared = F.col(f"{f}__kind"), F.col(f"{f}__val"), definition.field(f).kind
        ops = {m.op for m in spec.metrics if m.field == f}
        if ops & {"sum", "avg"}:
            aggs += exact.partial_sums(F.when(kind == "number", value), f)
        exact_ts = f"{f}__ts" in df.columns
        for op in ops & {"min", "max"}:
            least = F.min if op == "min" else F.max
            if declared != "date-time":
                pick = least(F.when(kind == declared, value))
            elif exact_ts:
                pick = least(F.when(kind == declared, F.col(f"{f}__ts")))
            else:
                pick = (F.min_by if op == "min" else F.max_by)(value, instant_sort_key(value))
            aggs.append(pick.alias(f"{f}_{op}"))
        aggs += [F.count_if(kind == declared).alias(f"{f}_values"), F.count_if(kind == "null").alias(f"{f}_nulls"), F.count_if(kind == "missing").alias(f"{f}_missing")]
        total = exact.settled(f)
        if odd == "exact":
            total = F.coalesce(total, F.col(f"{f}__exact"))
        elif odd == "error":
            total = F.coalesce(total, F.raise_error(F.lit(f"INEXACT: {f} has values that no scale holds together; ask for odd='exact'")))
        for op in sorted(ops & {"sum", "avg"}):
            outs.append((total if op == "sum" else exact.average(total, F.col(f"{f}__n"))).alias(f"{f}_{op}"))
        spelt = instant_text if declared == "date-time" and exact_ts else lambda c: c
        outs += [spelt(F.col(f"{f}_{op}")).alias(f"{f}_{op}") for op in sorted(ops & {"min", "max"})] + [F.col(f"{f}_{c}") for c in ("values", "nulls", "missing")]
    grouped = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)
    if keys:
        grouped = grouped.orderBy(*order).limit(spec.max_groups + 1)
    for f in fields if odd == "exact" else ():
        if any(m.field == f and m.op in ("sum", "avg") for m in spec.metrics):
            grouped = _with_exact(grouped, rows, keys, f)
    if keys and odd == "exact":
        grouped = grouped.orderBy(*order)
    return grouped.select(*outs, "n")


def _with_exact(grouped: DataFrame, rows: DataFrame, keys: list[Column], field: str) -> DataFrame:
    """The groups with <field>__exact, the sums by the Arrow path; they meet by the keys as they are, null for null."""
    value = F.when(F.col(f"{field}__kind") == "number", F.col(f"{field}__val")).alias("x")
    names = grouped.columns[: len(keys)]
    told = exact.slow_sums(rows.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("one"), value), [*[f"k{i}" for i in range(len(keys))], "one"], "x")
    both = F.lit(0) == F.col("one")
    for i, n in enumerate(names):
        both = both & F.col(n).eqNullSafe(F.col(f"k{i}"))
    return grouped.join(told, both, "left").withColumnRenamed("total", f"{field}__exact").drop("one", *[f"k{i}" for i in range(len(keys))])


def merged(partials: DataFrame, keys: list[str], counts: list[str] = (), sums: list[str] = (), least: list[str] = (), most: list[str] = (), averages: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Partial groups made one: counts and decimal sums added, extremes of extremes, and averages {name: (sum, count)} of the sums.

    Any grouping of the rows into partials gives the same result.
    """
    from siltstone.functions.exact import average, plain

    outs = [F.sum(c).alias(c) for c in (*counts, *sums)] + [F.min(c).alias(c) for c in least] + [F.max(c).alias(c) for c in most]
    out = partials.groupBy(*keys).agg(*outs)
    for name, (total, n) in (averages or {}).items():
        out = out.withColumn(name, average(plain(F.col(total).cast("string")), F.col(n)))
    return out.select(*keys, *counts, *[plain(F.col(c).cast("string")).alias(c) for c in sums], *least, *most, *(averages or {}))


def evaluate(df: DataFrame, spec: Spec, definition: CollectionDefinition, snapshot: int | None = None, freshness: str = "exact") -> dict:
    """The complete result, or an error: never a part of it, nor one over a projection that is not complete."""
    used = {k.field for k in spec.group_by} | {m.field for m in spec.metrics if m.field} | {p["field"] for p in spec.where}
    require_complete(df, [definition.field(f) for f in sorted(used)])
    rows = [r.asDict() for r in aggregated(df, spec, definition, "null").collect()]
    if len(rows) > spec.max_groups:
        raise EngineError("BACKPRESSURE", f"more than {spec.max_groups} groups", limit="groups")
    summed = [(m.name, f"{m.field}_values") for m in spec.metrics if m.op in ("sum", "avg")]
    if any(r[name] is None and r[values] for r in rows for name, values in summed):
        rows = [r.asDict() for r in aggregated(df, spec, definition, "exact").collect()]
    groups = []
    for r in rows:
        key = [{"kind": r[f"{k.field}__kind"], "value": r[f"{k.field}__val"]} | ({"local": r[f"{k.field}__local"]} if k.unit and r[f"{k.field}__val"] else {}) for k in spec.group_by]
        metrics = [{"value": r["n"]} if m.op == "count" else {"value": r[m.name]} | {c: r[f"{m.field}_{c}"] for c in ("values", "nulls", "missing")} for m in spec.metrics]
        groups.append({"key": key, "count": r["n"], "metrics": metrics})
    if len(json.dumps(groups, default=str, ensure_ascii=False).encode()) > MAX_GROUP_BYTES:
        raise EngineError("BACKPRESSURE", "the groups are too large", limit="bytes")
    described = [{"operator": m.op, "field": m.field, "semantics": "derived" if m.op == "avg" else "exact"} for m in spec.metrics]
    return {"source": definition.slug, "snapshot": snapshot, "freshness": freshness, "groupBy": [k.field for k in spec.group_by], "metrics": described, "groups": groups, "complete": True}

