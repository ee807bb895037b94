"""Secret scan with structural confirmation.

Three base kinds are plain patterns: `assign` (a keyword, a separator, a value), `access` (cloud access key
ids) and `hex` (long hexadecimal runs).  Two more are reported only once their structure holds:

* `private_key`: a base64 or hex candidate is decoded and must be a private key: DER whose nested lengths all
  fit exactly and whose fields are those of PKCS #1, SEC 1, PKCS #8 or encrypted PKCS #8, or an OpenSSH key
  whose nested length-prefixed fields do; a PEM block that was encoded once more is decoded twice.  A candidate
  may go over indented lines and escaped line breaks; it is cut where the key itself says that it ends.
* `signed_token`: three base64url parts of which the first decodes to a JSON object that names an `alg`, the
  second to a JSON object, and the third to bytes (or nothing, with alg none).

A key body may have 32,768 letters (several times the largest in use) and a token's header 4,096; with these bounds
a scan takes time in proportion to the text, whatever it holds.  A token may begin anywhere in a word.

Spans are code points, end exclusive; those that start together go by kind, as listed.  Null texts count as empty and
have no spans; an empty table gives an empty result.  Rows that repeat are scanned
each, and columns other than doc_id and text are neither read nor in the way.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import batched

KINDS = ("assign", "access", "hex", "private_key", "signed_token")
BASE = KINDS[:3]


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_ASSIGN = re.compile(rf"""(?:{_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEY_B64 = re.compile(r"(?:(?<![A-Za-z0-9+/_])|(?<=\\[nrt]))(?:M[A-I]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)(?=[A-Za-z0-9+/_-]{20})")
_KEY_HEX = re.compile(r"(?<![0-9a-fA-F])(?:30|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]7631|2[dD]2[dD]2[dD]2[dD]2[dD]424547494[eE])(?=[0-9a-fA-F]{20})")
_B64_LINE = re.compile(r"(?:[A-Za-z0-9+/_]|-(?!----))+(={0,2})")
_HEX_LINE = re.compile(r"[0-9a-fA-F]+()")
# What may stand between two lines of a key: a line break, also one that is escaped, and indentation.
_BREAK = re.compile(r"[ \t]*(?:\\?\r?\n|(?:\\{1,4}r)?\\{1,4}n)(?:[ \t]|\\{1,4}t)*(?!-----)")
# Parts with dots between, and the first letters of a part that is a JSON object: `{"` or `{ `.
_PARTS = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{20,}+")
_OBJECT = re.compile(r"(?=ey[A-DIJ])")
#: Most letters of a token's header, and of a key's body; longer ones are not looked at, so that no text takes more than linear time.
HEADER, KEY = 4096, 1 << 15
_PEM = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END(?:[A-Z ]*-----)?")


def der(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The (tag, content) fields that fill `data` exactly, or None if a length does not fit."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        content = data[at : at + size]
        if tag & 0x20 and (depth > 8 or der(content, depth + 1) is None):
            return None
        found.append((tag, content))
        at += size
    return found


def is_private_der(data: bytes) -> bool:
    outer = der(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    fields = der(outer[0][1]) or []
    tags = [t for t, _ in fields]
    if len(tags) >= 9 and set(tags[:9]) == {2}:
        return fields[0][1] in (b"\0", b"\1")  # PKCS #1
    if tags[:2] == [2, 4] and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return fields[0][1] == b"\1" and len(fields[1][1]) >= 16  # SEC 1
    if tags[:3] == [2, 0x30, 4] and fields[0][1] in (b"\0", b"\1"):
        return (der(fields[1][1]) or [(0, b"")])[0][0] == 6  # PKCS #8
    if tags == [0x30, 4]:
        return (der(fields[0][1]) or [(0, b"")])[0][0] == 6 and len(fields[1][1]) >= 16  # encrypted PKCS #8
    return False


def openssh_end(data: bytes) -> int | None:
    """Where the OpenSSH key that `data` begins with ends."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at = len(magic)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        part, at = data[at + 4 : at + 4 + size], at + 4 + size
        return part

    if any(field() is None for _ in range(3)):
        return None
    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= n <= 16 or any(not field() for _ in range(n)):
        return None
    private = field()
    return at if private and len(private) % 8 == 0 else None


def is_openssh(data: bytes) -> bool:
    end = openssh_end(data)
    return end is not None and not data[end:].strip(b"\0")


def _decoded(text: str) -> bytes | None:
    body = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _is_private(data: bytes | None, again: bool = True) -> bool:
    if not data:
        return False
    if is_private_der(data) or is_openssh(data):
        return True
    return again and any(_is_private(_decoded(m[1].decode()), False) for m in _PEM.finditer(data))


def _bytes(body: str, hexed: bool) -> bytes | None:
    """The bytes of joined lines, as far as they make whole ones."""
    if hexed:
        return bytes.fromhex(body[: len(body) // 2 * 2])
    return _decoded(body[:-1] if len(body) % 4 == 1 else body)


def _stated(head: bytes) -> int | None:
    """The size of the DER sequence that `head` begins, by its length; None if that is no length."""
    if head[1] < 0x80:
        return 2 + head[1]
    n = head[1] & 0x7F
    size = int.from_bytes(head[2 : 2 + n], "big")
    return 2 + n + size if 1 <= n <= 4 and size >= 0x80 else None


def _may_be_der(head: bytes, size: int) -> bool:
    """Whether the first bytes of a DER sequence of so many are those of a private key: a version, or an algorithm that fits."""
    inner = head[2 if head[1] < 0x80 else 2 + (head[1] & 0x7F) :]
    if len(inner) < 3:
        return True
    if inner[0] == 2:
        return inner[1] == 1 and inner[2] <= 1
    return inner[0] == 0x30 and (_stated(inner) or size) < size


def _may_be_key(head: bytes) -> bool:
    """Whether the first bytes, as far as they go, are those of an OpenSSH private key or of a PEM block around one."""
    if not head.startswith(b"openssh-key-v1\0"):
        return re.match(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", head) is not None
    # Cipher, key derivation and its options, the number of keys, and so many public keys: each says how long it is.
    at, left = 15, 3
    while left and at + 4 <= len(head):
        size = int.from_bytes(head[at : at + 4], "big")
        if size > KEY or at == 15 and not size:
            return False
        at, left = at + 4 + size, left - 1
        if not left and at + 4 <= len(head) and not 1 <= int.from_bytes(head[at : at + 4], "big") <= 16:
            return False
    return at <= KEY


def _key_end(text: str, start: int, hexed: bool) -> int | None:
    """Where the private key ends whose first line begins at `start`, or None if there is none.

    The lines that follow may be the key's or the text's own. How many bytes are the key's is what its
    outer length, its fields or its PEM footer say; it must end where a line does.
    """
    line = _HEX_LINE if hexed else _B64_LINE
    chars = lambda n: 2 * n if hexed else -(-4 * n // 3)
    size = None
    is_der = text[start] == ("3" if hexed else "M")
    if is_der:
        head = _bytes((_HEX_LINE if hexed else _B64_LINE).match(text, start, start + (36 if hexed else 24))[0], hexed) or b"00"
        stated = _stated(head)
        if stated is None or (size := chars(stated)) > min(KEY, len(text) - start) or not _may_be_der(head, stated):
            return None
    parts, ends, n, look = [], [], 0, 160
    m = line.match(text, start, start + KEY)
    while m and n < KEY:
        part = m[0][: len(m[0]) - len(m[1])]
        n += len(part)
        parts.append(part)
        ends.append((n, m.end()))
        if not is_der and n >= look:
            look = 2 * n
            if not _may_be_key(_bytes("".join(parts), hexed) or b""):
                return None
        if m[1] or size is not None and n >= size or not (gap := _BREAK.match(text, m.end())):
            break
        m = line.match(text, gap.end(), gap.end() + KEY)
    body = "".join(parts)
    if is_der:
        sizes = [size]
    elif (data := _bytes(body, hexed)) is None:
        return None
    elif (end := openssh_end(data)) is not None:
        sizes = [chars(end)]
    else:
        sizes = [chars(m.end()) for m in _PEM.finditer(data)]
    for size in sizes:
        for n, end in ends:
            if n >= size:
                if (n % 2 == 0 if hexed else n % 4 != 1) and _is_private(_bytes(body[:n], hexed)):
                    return end
                break
    return None


def _keys(text: str, starts: re.Pattern, hexed: bool):
    done = 0
    for m in starts.finditer(text):
        if m.start() >= done and (end := _key_end(text, m.start(), hexed)) is not None:
            done = end
            yield m.start(), end, "private_key"


def _tokens(text: str):
    for run in _PARTS.finditer(text):
        at, parts = run.start(), run[0].split(".")
        k, starts = 0, []
        for part in parts:
            starts.append(at)
            at += len(part) + 1
        while k + 2 < len(parts):
            begin = _token_start(*parts[k : k + 3])
            if begin is None:
                k += 1
            else:
                yield starts[k] + begin, starts[k + 2] + len(parts[k + 2]), "signed_token"
                k += 3


def _token_start(head: str, body: str, sign: str) -> int | None:
    """Where in `head` the header of a signed token begins that is followed by these parts."""
    if not body.startswith("ey"):
        return None
    for m in _OBJECT.finditer(head, max(0, len(head) - HEADER)):
        if len(head) - m.start() >= 10 and _header(head[m.start() :]) and is_signed_token(f"{head[m.start() :]}.{body}.{sign}"):
            return m.start()
    return None


def _header(part: str) -> dict | None:
    """The JSON object with an `alg` that a part decodes to."""
    found = _object(part)
    return found if found and isinstance(found.get("alg"), str) else None


def _object(part: str) -> dict | None:
    try:
        found = json.loads(_decoded(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(text: str) -> bool:
    head, body, sign = text.split(".")
    header = _header(head)
    if not header or _object(body) is None:
        return False
    return not sign if header["alg"].lower() == "none" else len(_decoded(sign) or b"") >= 16


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All (start, end, kind) by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    found += _keys(text, _KEY_B64, False)
    found += _keys(text, _KEY_HEX, True)
    if "ey" in text:
        found += _tokens(text)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def spelt(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches):
    for batch in batches:
        n = {k: [] for k in BASE}
        digests, spans = [], []
        for text in batch.column(1):
            found = find_spans(text.as_py() or "")
            kinds = [k for *_, k in found]
            for k in BASE:
                n[k].append(kinds.count(k))
            digests.append(hashlib.sha256(spelt(x for x in found if x[2] in BASE).encode()).hexdigest())
            spans.append(spelt(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(n[k], pa.int64()) for k in BASE], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])


def secrets(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return batched(documents.select("doc_id", "text")).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[secret]"


def masked(text: str) -> str:
    """The text with each maximal run of overlapping spans replaced."""
    out, done = [], 0
    for start, end, _ in find_spans(text):
        if start >= done:
            out += [text[done:start], MASK]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


def _mask(batches):
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [None if (t := x.as_py()) is None else masked(t) for x in batch.column(at)]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def mask_secrets(documents: DataFrame) -> DataFrame:
    """Every document, its secrets masked and n_chars, where it has one, counted anew; no document is dropped."""
    out = batched(documents).mapInArrow(_mask, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
