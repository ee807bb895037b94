"""Wide typed projections of JSON records, and their checks.

Every declared field f becomes two columns: f__kind ('null', 'missing', or the value's kind) and f__val.  Null
and missing differ everywhere, so neither is an SQL null alone; all that follows reads these columns and no
index rows are joined.  A date-time field may have a third, f__ts, its instant as a timestamp; a projection has it
only where every instant of the field is a whole number of microseconds and no leap second, so that it may stand
for the text wherever instants are compared.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.types import CollectionDefinition, EngineError, Field

_JSON_TYPE = {"string": "string", "number": "double", "boolean": "boolean", "date-time": "string"}


def field_path(name: str) -> str:
    return "$[" + json.dumps(name).replace("'", "\\'") + "]" if not name.isidentifier() else f"$.{name}"


def field_columns(document: Column, f: Field) -> list[Column]:
    """Kind and value of a declared field of a VARIANT document; another type than declared has kind 'other'."""
    got = F.try_variant_get(document, field_path(f.name), "variant")
    shape = F.schema_of_variant(got)
    fits = {
        "string": shape == "STRING", "date-time": shape == "STRING", "boolean": shape == "BOOLEAN",
        "number": shape.startswith("BIGINT") | shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"),
    }[f.kind]
    kind = F.when(got.isNull(), "missing").when(F.is_variant_null(got), "null").when(fits, f.kind).otherwise("other")
    value = F.try_variant_get(document, field_path(f.name), _JSON_TYPE[f.kind])
    return [kind.alias(f"{f.name}__kind"), F.when(fits, value).alias(f"{f.name}__val")]


def project(records: DataFrame, definition: CollectionDefinition, data: str = "canonical_data") -> DataFrame:
    """The typed projection of records whose documents are JSON text in `data`; the other columns stay."""
    with_doc = records.withColumn("_doc", F.try_parse_json(F.col(data)))
    return with_doc.select(*records.columns, *[c for f in definition.fields for c in field_columns(F.col("_doc"), f)])


def typed(value: Column, kind: str, null: Column | None = None, missing: Column | None = None) -> tuple[Column, Column]:
    """Kind and value columns from a plain column and the conditions under which it is null or missing."""
    none = F.lit(False) if null is None else null
    gone = F.lit(False) if missing is None else missing
    k = F.when(gone, "missing").when(none | value.isNull(), "null").otherwise(kind)
    return k, F.when(~gone & ~none, value)


def incomplete(df: DataFrame, fields: list[Field]) -> Column:
    """Whether a record's projection has a kind that is neither the declared one nor null or missing."""
    bad = F.lit(False)
    for f in fields:
        bad = bad | ~F.coalesce(F.col(f"{f.name}__kind").isin(f.kind, "null", "missing"), F.lit(False))
    return bad


def require_complete(df: DataFrame, fields: list[Field]) -> None:
    """An error if any record's projection of the fields is not whole."""
    if fields and not df.filter(incomplete(df, fields)).isEmpty():
        raise EngineError("SCHEMA_CONFLICT", "a projection is not complete")


def drift(expected: DataFrame, actual: DataFrame, fields: list[str], key: str = "record_id") -> DataFrame:
    """Differences of two projections, one row per record and field: missing, unexpected, kind or value."""

    def wide(df: DataFrame, side: str) -> DataFrame:
        held = [F.struct(F.lit(f).alias("field"), F.col(f"{f}__kind").alias("kind"), F.col(f"{f}__val").cast("string").alias("val")) for f in fields]
        return df.select(key, F.array(*held).alias(side))

    # Rows meet once by their key; only those that differ are taken apart.
    rows = wide(expected, "expected").join(wide(actual, "actual"), key, "full").filter(~F.col("expected").eqNullSafe(F.col("actual")))
    nothing = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("val")) for f in fields])
    rows = rows.select(key, F.coalesce("expected", nothing).alias("expected"), F.coalesce("actual", nothing).alias("actual"))
    pair = F.explode(F.arrays_zip("expected", "actual"))
    both = rows.select(key, pair.alias("x")).select(
        key, F.coalesce("x.expected.field", "x.actual.field").alias("field"), F.col("x.expected.kind").alias("expected_kind"), F.col("x.expected.val").alias("expected_val"), F.col("x.actual.kind").alias("actual_kind"), F.col("x.actual.val").alias("actual_val")
    )
    what = (
        F.when(F.col("actual_kind").isNull(), "missing")
        .when(F.col("expected_kind").isNull(), "unexpected")
        .when(~F.col("expected_kind").eqNullSafe(F.col("actual_kind")), "kind")
        .when(~F.col("expected_val").eqNullSafe(F.col("actual_val")), "value")
    )
    return both.withColumn("difference", what).filter("difference IS NOT NULL")


def reconciliation(differences: DataFrame, underivable: DataFrame | None = None, sample: int = 100, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """All differences counted by kind, and a sample of at most so many, by key and field.

    underivable: keys of records from whose documents no projection could be made; they count as such.
    """
    rows = differences.select(F.col(key).cast("string").alias(key), "field", "difference")
    if underivable is not None:
        rows = rows.join(underivable.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_anti")
        rows = rows.unionByName(underivable.select(F.col(key).cast("string").alias(key), F.lit(None).cast("string").alias("field"), F.lit("underivable").alias("difference")))
    return rows.groupBy("difference").agg(F.count(F.lit(1)).alias("n")), rows.orderBy(key, "field").limit(sample)
