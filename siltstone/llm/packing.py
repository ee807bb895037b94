"""Token ids packed into fixed-length rows: best-fit-decreasing with a segment tree over free capacities.

Texts are encoded once (distinct chunks of a run of texts only), cut into segments of at most `length` ids, and
dealt by a hash of their document and part to shards whose size is bounded by the bytes of text.  In a shard
the segments, longest first, each go to the open row with the least room that still holds them: a segment
tree over the capacities 0..length, whose leaves hold the rows with just that room, finds it in logarithmic
time.  A packed row has its ids, little-endian in the narrowest of two or four bytes and padded to `length`;
`cu_seqlens`, the cumulative lengths of its segments from 0; and `position_resets`, where positions start again
at 0 (each segment's start, and the padding's).

No id is dropped: `unpacked` gives every document's ids back.  Null and empty texts have no segments.  Rows
that repeat a doc_id are told apart by a hash of the text; equal rows unpack as one.  A document whose doc_id is null
is packed like others, its id null in `doc_ids`.  Segments of equal length go by id, hash and part.  Texts longer than
`length` ids are split; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import chunks as C
from siltstone.llm import kernel as K
from siltstone.llm.shared import batched

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are split before the merges of the rank files; fixed value of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
SHARD_BYTES = 16 << 20


@dataclass
class Ranks:
    """A rank vocabulary; its id one past the last is the padding."""

    raw: bytes

    @classmethod
    def load(cls, path: str = RANKS) -> Ranks:
        with open(path, "rb") as f:
            return cls(f.read())

    def open(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.raw.splitlines())}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def pad(self) -> int:
        return len(self.raw.splitlines())


#: First bytes of characters that may be white space, ASCII's and those of U+0085, U+00A0, U+1680, U+2000 and on.
_MAYBE_SPACE = np.isin(np.arange(256), [*range(33), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3, *range(0x80, 0xC0)])


def _chunks(buf: np.ndarray, offs: np.ndarray):
    new = np.zeros(len(buf), bool)
    new[:-1] = (buf[:-1] == 32) & ~_MAYBE_SPACE[buf[1:]]
    first = offs[:-1][np.diff(offs) > 0]
    # A text's last byte is not followed by the next text's first.
    new[first[first > 0] - 1] = False
    new[first] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(buf)) if len(starts) else starts, np.searchsorted(starts, offs)


def encode_block(encoding, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run of texts, flat, and their offsets."""
    starts, ends, first = _chunks(buf, offs)
    sample, number = C.unique(buf, starts, ends)
    raw = buf.tobytes()
    ids = [encoding.encode_ordinary(raw[a:b].decode()) for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)]
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for part in ids for x in part), np.uint32, int(count.sum()))
    values, at = C.spread(count, number)
    return flat[values], at[first]


def _segments(ranks: Ranks, length: int, width: str):
    def run(batches):
        encoding = ranks.open()
        for rows, buf, offs in K.blocks(batches, limit=C.BLOCK_BYTES):
            ids, at = encode_block(encoding, buf, offs)
            docs = rows.column(rows.schema.get_field_index("doc_id"))
            tags = K.hashes(buf, offs[:-1], offs[1:])
            text, part, data = [], [], []
            for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                for i, s in enumerate(range(a, b, length)):
                    text.append(k)
                    part.append(i)
                    data.append(ids[s : min(s + length, b)].astype(width).tobytes())
            take = np.array(text, np.int64)
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(take)), K.longs(tags[take]), pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["doc_id", "tag", "part", "ids"])

    return run


class Capacities:
    """Open rows by free room, and a segment tree that tells which rooms have any."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        at = self.size + room
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row of least room that holds `need`, and its room."""
        at = self.size + need
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            while at and not (at < self.size and (self.any[2 * at] or self.any[2 * at + 1])):
                self.any[at] = 0
                at >>= 1
        return row, room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of segment numbers, for sizes that descend."""
    free, rows = Capacities(length), []
    for k, size in enumerate(sizes):
        found = free.take(size)
        if found is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row, room = found
        rows[row].append(k)
        if room > size:
            free.put(row, room - size)
    return rows


SCHEMA = "shard int, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, parts array<int>, tags array<long>"


def _pack(length: int, width: str, pad: int):
    def run(table: pa.Table) -> pa.Table:
        unit = np.dtype(width).itemsize
        shard = table.column("shard")[0].as_py()
        order = [(-len(d), i if i is not None else -1, i is None, t, p) for d, i, t, p in zip(*(table.column(c).to_pylist() for c in ("ids", "doc_id", "tag", "part")), strict=True)]
        table = table.take(pa.array(sorted(range(len(order)), key=order.__getitem__)))
        data, docs, tags, parts = (table.column(c).to_pylist() for c in ("ids", "doc_id", "tag", "part"))
        out = []
        for r, row in enumerate(best_fit([len(d) // unit for d in data], length)):
            size = [len(data[k]) // unit for k in row]
            cu = [0, *np.cumsum(size).tolist()]
            fill = np.full(length - cu[-1], pad, width).tobytes()
            out.append((shard, r, cu[-1], b"".join([*[data[k] for k in row], fill]), cu, cu[:-1] + [cu[-1]] * (cu[-1] < length), [docs[k] for k in row], [parts[k] for k in row], [tags[k] for k in row]))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def packed(documents: DataFrame, ranks: str = RANKS, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The packed rows of all documents, numbered within their shards."""
    docs, vocabulary = batched(documents.select("doc_id", "text")), Ranks.load(ranks)
    pad = vocabulary.pad
    width = "<u2" if pad < 1 << 16 else "<u4"
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    segments = docs.mapInArrow(_segments(vocabulary, length, width), "doc_id long, tag long, part int, ids binary")
    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tag", "part"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_pack(length, width, pad), SCHEMA)


def waste(rows: DataFrame, length: int = LENGTH) -> float:
    """The share of the matrices that is padding."""
    told = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens")).first()
    return 1 - told.tokens / (told["rows"] * length) if told["rows"] else 0.0


def unpacked(rows: DataFrame, wide: bool = False) -> DataFrame:
    """(doc_id, tag, ids) of every document, from its packed rows."""
    unit = 4 if wide else 2
    one = F.explode(F.arrays_zip("doc_ids", "parts", "tags", F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("start"), F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("end")))
    parts = rows.select("ids", one.alias("x")).select(
        F.col("x.doc_ids").alias("doc_id"), F.col("x.tags").alias("tag"), F.col("x.parts").alias("part"), F.expr(f"hex(substring(ids, x.start * {unit} + 1, (x.end - x.start) * {unit}))").alias("ids")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("part", "ids"))), lambda s: s.ids), "")
    return parts.groupBy("doc_id", "tag").agg(F.unhex(joined).alias("ids"))


def write_matrices(rows: DataFrame, folder: str, length: int = LENGTH, wide: bool = False) -> DataFrame:
    """Write each shard as three binary files (ids as a matrix, cumulative lengths, resets) and return their list.

    The folder is a URI of a store that pyarrow opens; a task writes its shard's files whole, so that a task
    run again writes the same.
    """

    def run(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        shard = table.column("shard")[0].as_py()
        table = table.sort_by("row")
        flat = lambda c: np.concatenate([np.array(x, np.int32) for x in table.column(c).to_pylist()]).astype("<i4").tobytes()
        files = {"ids": b"".join(table.column("ids").to_pylist()), "cu_seqlens": flat("cu_seqlens"), "position_resets": flat("position_resets")}
        store.create_dir(path, recursive=True)
        for kind, data in files.items():
            with store.open_output_stream(f"{path}/{shard:06d}.{kind}.bin") as f:
                f.write(data)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n_rows": [table.num_rows], "length": [length], "dtype": ["<u4" if wide else "<u2"]})

    return rows.groupBy("shard").applyInArrow(run, "shard int, n_rows long, length long, dtype string")
