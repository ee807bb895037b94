"""Reads of single records and of a collection's live ones.

Tables of records have space_id, collection_id, record_id and tombstone; laid out in folders by space and collection,
the reads below prune all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.canonical import key_column, normal_key, trimmed
from siltstone.types import EngineError

#: What a caller sees of a record by view; fixed values.
VIEWS = {"full": None, "summary": ("record_id", "revision", "n_bytes", "created_at"), "id": ("record_id",)}


def live(records: DataFrame, space, collection) -> DataFrame:
    """The records of a collection that are not deleted."""
    return records.filter((F.col("space_id") == space) & (F.col("collection_id") == collection) & ~F.col("tombstone"))


def get(records: DataFrame, record_id: str, include_tombstone: bool = False) -> DataFrame:
    """The record of an id, or none; a deleted one only on request."""
    found = records.filter(F.col("record_id") == record_id)
    return found if include_tombstone else found.filter(~F.col("tombstone"))


def with_key(records: DataFrame, column: str, key: str) -> DataFrame:
    """Records whose key, in its normal form, is the one given; only keys beyond ASCII are normalised."""
    wanted, plain = normal_key(key), F.coalesce(F.col(column).rlike(r"^[\x00-\x7f]*$"), F.lit(False))
    simple = records.filter(plain & (trimmed(F.col(column)) == wanted)) if wanted.isascii() else records.limit(0)
    return simple.unionByName(records.filter(F.col(column).isNotNull() & ~plain).filter(key_column(F.col(column)) == wanted))


def by_key(records: DataFrame, kind: str, key: str) -> DataFrame:
    """The live record of a generated key (its id's twin, compared as it is) or an external one.

    An external key may have been an alias of two records in the past; where both live, neither is meant.
    """
    if kind not in ("generated", "external"):
        raise EngineError("INVALID_ARGUMENT", f"{kind} is no kind of key")
    found = records.filter(F.col("generated_key") == key) if kind == "generated" else with_key(records, "external_key", key)
    found = found.filter(~F.col("tombstone"))
    if kind == "external" and found.select("record_id").distinct().limit(2).count() > 1:
        raise EngineError("SCHEMA_CONFLICT", "two live records have this key")
    return found


def viewed(records: DataFrame, view: str) -> DataFrame:
    """The columns of a view, in the table's order."""
    if view not in VIEWS:
        raise EngineError("INVALID_ARGUMENT", f"{view} is no view")
    return records if VIEWS[view] is None else records.select(*[c for c in records.columns if c in VIEWS[view]])
