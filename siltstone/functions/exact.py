"""Exact decimal sums and averages of doubles.

The decimal summed is the shortest text of each double.  A value of at most 15 significant digits that
survives the cast to a decimal of some scale is that text, so sums are taken as decimals at a few scales in
one pass with whole-stage code, each with a flag that says whether every value of the group fitted.  Groups in
which none fits are summed by the Arrow path, as Python integers.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.types import AVG_DIGITS

SCALES = (2, 6, 12)


def plain(text: Column) -> Column:
    """Decimal text without trailing zeros."""
    cut = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(cut == "-0", "0").otherwise(cut)


def partial_sums(value: Column, name: str) -> list[Column]:
    """Aggregates from which `settled` makes the exact sum: sums at the scales, and whether all values fitted."""
    out = []
    for s in SCALES:
        as_decimal = F.when(F.abs(value) < 10 ** (15 - s), value.cast(T.DecimalType(38, s)))
        fits = value.isNull() | F.coalesce(as_decimal.cast("double") == value, F.lit(False))
        out += [F.try_sum(as_decimal).alias(f"{name}__sum{s}"), F.every(fits).alias(f"{name}__fits{s}")]
    return [*out, F.count(value).alias(f"{name}__n")]


def settled(name: str) -> Column:
    """The exact sum's text, "0" of no values, null where no scale fits."""
    n = F.col(f"{name}__n")
    text = F.lit(None).cast("string")
    for s in reversed(SCALES):
        text = F.when(F.col(f"{name}__fits{s}") & F.col(f"{name}__sum{s}").isNotNull(), plain(F.col(f"{name}__sum{s}").cast("string"))).otherwise(text)
    return F.when(n == 0, "0").otherwise(text)


def parts(name: str) -> list[str]:
    return [*[f"{name}__{what}{s}" for s in SCALES for what in ("sum", "fits")], f"{name}__n"]


def decimal_text(x: Decimal) -> str:
    if x == 0:
        return "0"
    text = format(x, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def quotient(total: str, count: int) -> str:
    """total / count to 20 significant digits, halves away from zero."""
    exact = Context(prec=AVG_DIGITS, rounding=ROUND_HALF_UP, Emax=10**9, Emin=-(10**9))
    return decimal_text(exact.divide(Decimal(total), Decimal(count)))


@F.pandas_udf(T.StringType())
def average(totals, counts):
    """Exact averages from exact sums; null of no values."""
    return totals.combine(counts, lambda t, n: quotient(t, int(n)) if n and t is not None else None)


_EXACT = Context(prec=2000, Emax=10**9, Emin=-(10**9))


def slow_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, total) by the Arrow path: each batch's partial sums, then their sums."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("total", T.StringType())])

    def add(rows) -> str:
        total = Decimal(0)
        for x in rows:
            if x is not None:
                total = _EXACT.add(total, Decimal(x) if isinstance(x, str) else Decimal(repr(x)))
        return decimal_text(total)

    def batches(it):
        for batch in it:
            groups: dict = {}
            for *key, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                groups.setdefault(tuple(key), []).append(x)
            rows = [dict(zip(schema.names, (*k, add(xs)), strict=True)) for k, xs in groups.items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([batch.schema.field(i) for i in range(len(keys))] + [pa.field("total", pa.string())]))

    def final(table: pa.Table) -> pa.Table:
        row = {k: table.column(k)[0].as_py() for k in keys} | {"total": add(table.column("total").to_pylist())}
        return pa.Table.from_pylist([row], table.schema)

    partial = df.select(*keys, value).mapInArrow(batches, schema)
    return partial.groupBy(*keys).applyInArrow(final, schema)
