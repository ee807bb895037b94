"""Collections, kinds of values, limits and typed errors."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Limits of the contract; fixed values.
MAX_PREDICATES = 16
MAX_IN_VALUES = 16
MAX_GROUP_BY = 3
MAX_METRICS = 16
MAX_GROUPS = 1000
DEFAULT_GROUPS = 100
MAX_GROUP_BYTES = 262_144
MAX_REQUEST_BYTES = 32_768
PAGE_ROWS = 100
PAGE_BYTES = 2_097_152
EXPORT_ROWS = 1000
EXPORT_BYTES = 1_048_576
EXPORT_PAGES = 10_000
FEED_ROWS = 100
MAX_INDEXED_FIELDS = 16
MAX_DEPTH = 32
MAX_NODES = 256
SAFE_INTEGER = 2**53 - 1
AVG_DIGITS = 20
CHUNK = 1000
OVERLAP = 100
RRF_K = 60

KINDS = ("string", "number", "boolean", "date-time")
OPERATORS = ("eq", "lt", "lte", "gt", "gte", "in", "isNull")
UNITS = ("hour", "day", "week", "month", "quarter", "year")
METRICS = ("count", "sum", "avg", "min", "max")


class EngineError(Exception):
    """An error with a code of the contract."""

    def __init__(self, code: str, message: str = "", limit: str | None = None):
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.limit = code, limit


@dataclass(frozen=True)
class Field:
    """A declared top-level scalar field."""

    name: str
    kind: str
    nullable: bool = False
    required: bool = False
    filterable: bool = True
    sortable: bool = True
    ready: bool = True
    enum: tuple | None = None
    integer: bool = False

    def spark_type(self) -> T.DataType:
        return {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date-time": T.StringType()}[self.kind]


@dataclass(frozen=True)
class CollectionDefinition:
    """A collection: declared fields, unique paths, and the transitions its lifecycle field may take.

    `schema`, where there is one, is the canonical text of the records' whole tree, and the fields are its scalars that are
    declared; `operators.schemas.definition` makes such a collection.
    """

    slug: str
    fields: tuple[Field, ...]
    version: int = 1
    uniques: tuple[tuple[str, ...], ...] = ()
    lifecycle: str | None = None
    initial: tuple[str, ...] = ()
    transitions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    schema: str | None = None

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names) or any(f.kind not in KINDS for f in self.fields):
            raise EngineError("SCHEMA_INVALID", "fields are named once and of a known kind")
        if sum(f.filterable or f.sortable for f in self.fields) > MAX_INDEXED_FIELDS:
            raise EngineError("SCHEMA_UNSUPPORTED", "too many indexed fields")
        if any(not path or any(p not in names for p in path) for path in self.uniques):
            raise EngineError("SCHEMA_INVALID", "a unique names declared fields")
        if self.lifecycle and self.lifecycle not in names:
            raise EngineError("SCHEMA_INVALID", "the lifecycle is a declared field")

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise EngineError("SCHEMA_CONFLICT", f"{name} is not declared")

    def ready(self, name: str, kind: str | None, use: str = "filterable") -> Field:
        """The field, if it may be used that way now and is of that kind."""
        f = self.field(name)
        if not getattr(f, use) or not f.ready or kind not in (None, f.kind):
            raise EngineError("SCHEMA_CONFLICT", f"{name} is not ready as {kind}")
        return f

    def evolve(self, fields: tuple[Field, ...]) -> CollectionDefinition:
        """The next version: old fields as they were, new ones optional and not ready until projected."""
        old = {f.name: f for f in self.fields}
        for f in fields:
            was = old.pop(f.name, None)
            if was is None:
                if f.required or f.ready:
                    raise EngineError("SCHEMA_BREAKING", f"{f.name} is new, so optional and not ready")
            elif (was.kind, was.required, was.enum, was.nullable, was.integer) != (f.kind, f.required, f.enum, f.nullable, f.integer):
                raise EngineError("SCHEMA_BREAKING", f"{f.name} changed")
        if old:
            raise EngineError("SCHEMA_BREAKING", f"{', '.join(sorted(old))} dropped")
        return CollectionDefinition(self.slug, fields, self.version + 1, self.uniques, self.lifecycle, self.initial, self.transitions)

    def optional(self, name: str) -> bool:
        """Whether a record may do without the field, which is declared."""
        if self.schema is not None:
            tree = json.loads(self.schema)
            return name in tree.get("properties", {}) and name not in tree.get("required", [])
        return any(f.name == name and not f.required for f in self.fields)

    def record_schema(self) -> T.StructType:
        """The wide layout: a kind and a value for each field."""
        out = T.StructType([T.StructField("record_id", T.StringType(), False)])
        for f in self.fields:
            out.add(f"{f.name}__kind", T.StringType()).add(f"{f.name}__val", f.spark_type())
        return out


#: Announced positive leap seconds; fixed values.
LEAP_DAYS = frozenset(
    "1972-06-30 1972-12-31 1973-12-31 1974-12-31 1975-12-31 1976-12-31 1977-12-31 1978-12-31 1979-12-31 1981-06-30 1982-06-30 1983-06-30 1985-06-30 1987-12-31"
    " 1989-12-31 1990-12-31 1992-06-30 1993-06-30 1994-06-30 1995-12-31 1997-06-30 1998-12-31 2005-12-31 2008-12-31 2012-06-30 2015-06-30 2016-12-31".split()
)
_INSTANT = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?Z")


def canonical_instant(text: str) -> str:
    """The instant with a fraction that has no trailing zeros; an error if it is none."""
    import calendar

    m = _INSTANT.fullmatch(text)
    if not m or not m[0].isascii():
        raise EngineError("INVALID_ARGUMENT", "not an RFC 3339 UTC instant")
    y, mo, d, h, mi, s = (int(x) for x in m.groups()[:6])
    if y < 1 or not 1 <= mo <= 12 or not 1 <= d <= calendar.monthrange(y, mo)[1] or h > 23 or mi > 59 or s > 60:
        raise EngineError("INVALID_ARGUMENT", "no such instant")
    if s == 60 and ((h, mi) != (23, 59) or text[:10] not in LEAP_DAYS):
        raise EngineError("INVALID_ARGUMENT", "no leap second was announced then")
    fraction = (m[7] or "").rstrip("0")
    return text[:19] + (f".{fraction}" if fraction else "") + "Z"


def instant_key(text: str) -> str:
    """The text that orders instants by bytes; :60 comes after :59.9."""
    return canonical_instant(text)[:-1]
