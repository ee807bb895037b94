"""Canonical texts: numbers as JavaScript prints them, JSON, external keys, unique tuples, JSON pointers."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.types import EngineError, instant_key

#: Code points trimmed from external keys (White_Space, without U+FEFF); fixed values.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def js_number(x: float | int) -> str:
    """The shortest decimal text of a double in JavaScript's spelling."""
    x = float(x)
    if not math.isfinite(x):
        raise EngineError("INVALID_ARGUMENT", "numbers are finite")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        body = text + "0" * (point - len(text)) if len(text) <= point else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + text
    else:
        e = point - 1
        body = text[0] + (f".{text[1:]}" if len(text) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return "-" * sign + body


def canonical_json(value) -> str:
    """JSON with object keys in UTF-8 order and numbers as JavaScript writes them."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, int | float):
        return js_number(value)
    if isinstance(value, str):
        if any(0xD800 <= ord(c) <= 0xDFFF for c in value):
            raise EngineError("INVALID_ARGUMENT", "unpaired surrogate")
        return json.dumps(value, ensure_ascii=False)
    raise EngineError("INVALID_ARGUMENT", f"{type(value).__name__} is not JSON")


@F.pandas_udf(T.StringType())
def canonical_column(texts):
    """The canonical form of a column of JSON texts; null where one is no JSON or holds what has no such form."""

    def one(text):
        if text is None:
            return None
        try:
            return canonical_json(json.loads(text))
        except (ValueError, EngineError, RecursionError):
            return None

    return texts.map(one)


def normal_key(text: str) -> str:
    return unicodedata.normalize("NFC", text).strip(WHITE_SPACE)


@F.pandas_udf(T.StringType())
def nfc(texts):
    """NFC of a column of strings; null stays null."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def trimmed(column: Column) -> Column:
    """A string without white space of the fixed set at either end."""
    return F.btrim(column, F.lit(WHITE_SPACE))


def key_column(column: Column) -> Column:
    """External keys as they are compared: NFC, then trimmed."""
    return trimmed(nfc(column))


def unique_part(kind: str, value: Column) -> Column:
    """One component of a unique tuple: kind, length in bytes, and the value's text."""
    text = nfc(value) if kind == "string" else value.cast("string")
    return F.concat(F.lit(f"{kind}:"), F.octet_length(text).cast("string"), F.lit(":"), text)


def unique_tuple(parts: list[tuple[str, Column]]) -> Column:
    """The tuple's encoding, or null (no reservation) if a component is null or missing."""
    return F.concat(*[unique_part(k, v) for k, v in parts])


def encode_unique(parts: list[tuple[str, object]]) -> str | None:
    out = []
    for kind, value in parts:
        if value is None:
            return None
        text = unicodedata.normalize("NFC", value) if kind == "string" else js_number(value) if kind == "number" else instant_key(value) if kind == "date-time" else str(value).lower()
        out.append(f"{kind}:{len(text.encode())}:{text}")
    return "".join(out)


_ESCAPED = re.compile(r"~(?![01])")
MISSING = object()


def pointer(document, path: str):
    """What an RFC 6901 pointer names, or MISSING; a malformed pointer names nothing."""
    if path == "":
        return document
    if not path.startswith("/") or _ESCAPED.search(path):
        return MISSING
    for step in path[1:].split("/"):
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(document, dict) and step in document:
            document = document[step]
        elif isinstance(document, list) and re.fullmatch(r"0|[1-9]\d*", step, re.ASCII) and int(step) < len(document):
            document = document[int(step)]
        else:
            return MISSING
    return document


def storable(column: Column) -> Column:
    """Text with NUL replaced by U+FFFD."""
    return F.translate(column, "\0", "\ufffd")


def instant_sort_key(column: Column) -> Column:
    """The text that orders canonical or other UTC instants: no Z, no trailing zeros of a fraction."""
    bare = F.regexp_replace(column, "Z$", "")
    return F.when(bare.contains("."), F.regexp_replace(bare, r"\.?0*$", "")).otherwise(bare)


def instant_timestamp(column: Column) -> Column:
    """A canonical instant as a timestamp: fractions cut to microseconds, a leap second kept in the minute it ends."""
    body = F.regexp_extract(column, r"^(.{19})", 1)
    leap = F.substring(column, 18, 2) == "60"
    micros = F.rpad(F.regexp_extract(column, r"\.(\d{1,6})", 1), 6, "0")
    text = F.when(leap, F.concat(F.substring(body, 1, 17), F.lit("59.999999Z"))).otherwise(F.concat(body, F.lit("."), micros, F.lit("Z")))
    return F.try_to_timestamp(text)


def instant_text(ts: Column) -> Column:
    """A timestamp as a canonical instant."""
    return F.concat(F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0*$", ""), F.lit("Z"))
