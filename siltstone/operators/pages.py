"""Keyset pages: a total order, strictly-after continuation, row and byte limits, authenticated cursors.

A page is a top-k: `orderBy().limit()` of at most a hundred rows and one, so no full sort happens; the byte
limit is a running sum over those.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.canonical import canonical_json, instant_sort_key
from siltstone.types import PAGE_BYTES, PAGE_ROWS, CollectionDefinition, EngineError


@dataclass(frozen=True)
class Sort:
    field: str
    kind: str
    direction: str = "asc"


def sort_rank(kind: Column) -> Column:
    """Missing before null before values; descending turns the whole of it."""
    return F.when(kind == "missing", 0).when(kind == "null", 1).otherwise(2)


def _keys(sort: Sort | None) -> list[tuple[Column, bool]]:
    if sort is None:
        return [(F.col("created_at"), True), (F.col("record_id"), True)]
    value = F.col(f"{sort.field}__val")
    up = sort.direction == "asc"
    return [(sort_rank(F.col(f"{sort.field}__kind")), up), (instant_sort_key(value) if sort.kind == "date-time" else value, up), (F.col("record_id"), True)]


def order(sort: Sort | None) -> list[Column]:
    return [c.asc() if up else c.desc() for c, up in _keys(sort)]


def after(sort: Sort | None, last: tuple) -> Column:
    """Rows strictly after the tuple; a null in it stands for no value (ranks tell null from missing)."""
    out = F.lit(False)
    same = F.lit(True)
    for (c, up), v in zip(_keys(sort), last, strict=True):
        if v is None:
            same = same & c.isNull()
            continue
        literal = F.to_timestamp_ntz(F.lit(v)) if sort is None and c is _keys(sort)[0][0] else F.lit(v)
        out = out | (same & (c > literal if up else c < literal))
        same = same & (c == literal)
    return out


def page(df: DataFrame, sort: Sort | None = None, last: tuple | None = None, limit: int = PAGE_ROWS, max_bytes: int = PAGE_BYTES, size: str = "n_bytes", definition: CollectionDefinition | None = None) -> DataFrame:
    """The next rows in order, with `position` from 1 and `more` where others follow the page.

    The first row always comes; others as long as the page's bytes stay within the limit.
    """
    if not 1 <= limit <= PAGE_ROWS:
        raise EngineError("INVALID_ARGUMENT", f"1 to {PAGE_ROWS} rows")
    if definition and sort:
        definition.ready(sort.field, sort.kind, "sortable")
    rows = df if last is None else df.filter(after(sort, last))
    keys = _keys(sort)
    top = rows.withColumn("_k", F.struct(*[c.alias(f"k{i}") for i, (c, _) in enumerate(keys)])).orderBy(*order(sort)).limit(limit + 1)
    by = Window.partitionBy(F.lit(0)).orderBy(*[F.col(f"_k.k{i}").asc() if up else F.col(f"_k.k{i}").desc() for i, (_, up) in enumerate(keys)])
    numbered = top.withColumn("position", F.row_number().over(by)).withColumn("_bytes", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = numbered.withColumn("_in", (F.col("position") <= limit) & ((F.col("_bytes") <= max_bytes) | (F.col("position") == 1)))
    return held.withColumn("more", F.max(~F.col("_in")).over(Window.partitionBy(F.lit(0)))).filter("_in").drop("_k", "_bytes", "_in")


class Cursors:
    """Opaque tokens that bind the last tuple to the query it continues, for fifteen minutes."""

    def __init__(self, secret: bytes, lifetime: int = 900, clock=time.time):
        self.secret, self.lifetime, self.clock = secret, lifetime, clock

    def _sign(self, body: bytes) -> bytes:
        return hmac.new(self.secret, body, hashlib.sha256).digest()

    def issue(self, scope: dict, last: list) -> str:
        body = canonical_json({"scope": hashlib.sha256(canonical_json(scope).encode()).hexdigest(), "last": last, "until": int(self.clock()) + self.lifetime}).encode()
        return base64.urlsafe_b64encode(self._sign(body) + body).decode()

    def read(self, scope: dict, token: str) -> tuple:
        try:
            raw = base64.urlsafe_b64decode(token.encode())
            sign, body = raw[:32], raw[32:]
            told = json.loads(body) if hmac.compare_digest(sign, self._sign(body)) else None
        except (ValueError, TypeError):
            told = None
        if not told or told["scope"] != hashlib.sha256(canonical_json(scope).encode()).hexdigest() or told["until"] < self.clock():
            raise EngineError("CURSOR_INVALID", "the cursor is not of this query, or too old")
        return tuple(told["last"])
