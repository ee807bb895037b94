"""WARC archives: writing, normalising and reading back.

A page becomes a `response` record with its payload, or a `revisit` record that refers to the response with
the same payload.  Pages are written as they stand in a partition into archives that are one gzip stream each
(rolled at `ROLL_BYTES` of records); no record of such a file can be read without all before it.  The
normaliser goes over an archive's stream once, holding one record at a time, writes every record as a gzip
member of its own, and beside the file a sidecar index of the members' offsets, lengths and record ids.
Reading back deals the index entries, and each record is read alone by its offset.

Files are opened by URI with pyarrow in the tasks, and only ever written whole under a temporary name and then
moved.  Archives carry their task attempt in the name, and only those that the list of files written names are
read on, so what a lost or repeated task left behind does not count.  The folder must be one that all executors
share.

A payload of any length is one record, held whole in a task.  An empty table writes no archive and gives an empty
result; columns other than page_id, url and html are not read.  Null or empty html is an empty payload; such pages, too, are one response and revisits.  Rows
that repeat the largest page_id of a payload are each a response.  A null page_id is written as such and is
referred to by none.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import bloom, maybe_listed, written

ROLL_BYTES = 64 << 20
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = b"\r\n\r\n"


def base32(hexadecimal):
    """Upper-case base32 of a column of 40 hexadecimal digits."""
    value = lambda i: F.conv(F.substring(hexadecimal, 5 * i // 4 + 1, 2), 16, 10).cast("int")
    digit = lambda i: F.substring(F.lit(_ALPHABET), F.shiftright(value(i), 3 - 5 * i % 4).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[digit(i) for i in range(32)])


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html")
    digest = F.sha1(html)
    chief = pages.select("page_id", digest.alias("sha")).groupBy("sha").agg(F.max("page_id").alias("chief"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Payloads that occur once need no partner and are not shuffled.
    sent = pages.withColumn("sha", digest).withColumn("payload_bytes", F.octet_length(html).cast("long"))
    chief = written(chief, "chiefs")
    sent = maybe_listed(sent, "sha", bloom(chief, "sha"), "maybe")
    alone = sent.filter("NOT maybe").withColumn("chief", F.lit(None).cast("long"))
    named = alone.unionByName(sent.filter("maybe").join(chief, "sha", "left"))
    first = F.coalesce(F.col("page_id") == F.col("chief"), F.col("chief").isNull())
    kind = F.when(first, "response").otherwise("revisit")
    return named.select(
        "page_id", "url", F.when(first, F.coalesce("html", F.lit(""))).alias("html"), "payload_bytes", base32(F.col("sha")).alias("payload_digest"), kind.alias("record_type"), F.when(~first, F.col("chief")).alias("refers_to")
    )


def record(page_id, url, html, size, digest, kind, refers_to, tag: str) -> bytes:
    """One WARC/1.1 record; its block is an HTTP response head and, in a response, the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (html or "").encode() if kind == "response" else head
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, tag)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + _END + block + _END


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


class _Whole:
    """A file that appears under its name once it is complete."""

    def __init__(self, store, path: str):
        self.store, self.path, self.draft = store, path, f"{path}.{uuid.uuid4().hex}.part"
        self.out = store.open_output_stream(self.draft)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.draft, self.path)


def _write_monolithic(folder: str, roll: int):
    def run(batches):
        from pyspark import TaskContext

        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        part, serial, out, gz, size, n = f"{task.partitionId():05d}-{task.taskAttemptId()}", 0, None, None, 0, 0

        def close():
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_pylist([{"file": out.path.rsplit("/", 1)[1], "records": n}], pa.schema([("file", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    out, gz, size, n = _Whole(store, f"{path}/pages-{part}-{serial:05d}.warc.gz"), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data = record(*[x.as_py() for x in row], tag=f"{part}/{serial}/{n}")
                out.write(gz.compress(data))
                size, n = size + len(data), n + 1
                if size >= roll:
                    yield close()
                    out, serial = None, serial + 1
        if out is not None:
            yield close()

    return run


def inflated_records(stream, chunk: int = 1 << 20):
    """Each record's bytes of a gzip stream of one or more members, in one pass over it."""
    inflate, held = zlib.decompressobj(31), bytearray()
    while raw := stream.read(chunk):
        while raw:
            held += inflate.decompress(raw)
            raw = b""
            if inflate.eof:
                raw, inflate = inflate.unused_data, zlib.decompressobj(31)
        at = 0
        while (head := held.find(_END, at)) >= 0:
            m = re.search(rb"(?mi)^content-length:\s*(\d+)", bytes(held[at:head]))
            if m is None:
                raise ValueError("a record without a length")
            end = head + 4 + int(m[1]) + 4
            if len(held) < end:
                break
            yield bytes(held[at:end])
            at = end
        del held[:at]
    if held.strip():
        raise ValueError("the stream ends within a record")


def record_id(data: bytes) -> str:
    m = re.search(rb"(?mi)^warc-record-id:\s*(\S+)", data[: data.find(_END)])
    return m[1].decode() if m else ""


INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())])


def _normalise(source: str, target: str, level: int):
    def run(batches):
        (store, path), (to, out_path) = _store(source), _store(target)
        to.create_dir(out_path, recursive=True)
        for batch in batches:
            for name in batch.column(0):
                name, offset, entries = name.as_py(), 0, []
                out = _Whole(to, f"{out_path}/{name}")
                with store.open_input_file(f"{path}/{name}") as stream:
                    for data in inflated_records(stream):
                        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = gz.compress(data) + gz.flush()
                        out.write(member)
                        entries.append({"file": name, "offset": offset, "length": len(member), "record_id": record_id(data)})
                        offset += len(member)
                out.close()
                side = _Whole(to, f"{out_path}/{name}.idx.jsonl")
                for entry in entries:
                    side.write(json.dumps(entry).encode() + b"\n")
                side.close()
                yield pa.RecordBatch.from_pylist([{"file": name, "records": len(entries)}], pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return run


def normalise(spark: SparkSession, source: str, target: str, files: DataFrame | None = None, level: int = 6) -> DataFrame:
    """Rewrite the archives *.warc.gz of a folder (or those in `files`), record by record, into another, with sidecar indexes.

    One row per archive: file, records.
    """
    if files is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(source).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    tasks = files.select("file").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return tasks.mapInArrow(_normalise(source, target, level), "file string, records long")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, offset long, length long, record_id string").option("pathGlobFilter", "*.idx.jsonl").json(folder)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def parsed(member: bytes) -> tuple:
    """page_id, payload bytes, payload digest, type and reference of one record; a payload that is there must have its digest."""
    data = zlib.decompress(member, 31)
    head, _, block = data[:-4].partition(_END)
    field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    http, _, payload = block.partition(_END)
    size = int(re.search(rb"(?mi)^content-length:\s*(\d+)", http)[1])
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    if field["warc-type"] == "response":
        import base64

        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (size, digest) != (len(payload), found):
            raise ValueError(f"record {field['warc-record-id']}: the payload is not the one it names")
    number = lambda x: int(x) if x else None
    return number(field["x-page-id"]), size, digest, field["warc-type"], number(field.get("x-refers-to-page-id"))


def _read(folder: str):
    def run(batches):
        store, path = _store(folder)
        name, stream = None, io.BytesIO()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            found = []
            for file, offset, length in zip(*batch.columns[:3], strict=True):
                if name != file.as_py():
                    stream.close()
                    name = file.as_py()
                    stream = store.open_input_file(f"{path}/{name}")
                stream.seek(offset.as_py())
                found.append(parsed(stream.read(length.as_py())))
            columns = zip(*found, strict=True) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RECORD.split(", ")])

    return run


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of a folder of normalised archives, each read by its index entry."""
    entries = read_index(spark, folder).select("file", "offset", "length")
    return entries.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_read(folder), RECORD)


def archived(pages: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Write the pages to archives under `folder`, normalise them, and read every record back."""
    spark = pages.sparkSession
    raw, whole = f"{folder}/monolithic", f"{folder}/members"
    roles(pages).mapInArrow(_write_monolithic(raw, roll), "file string, records long").write.mode("overwrite").parquet(f"{folder}/written")
    files = spark.read.parquet(f"{folder}/written")
    if not files.isEmpty():
        normalise(spark, raw, whole, files).write.mode("overwrite").parquet(f"{folder}/normalised")
        return read_back(spark, whole)
    return spark.createDataFrame([], RECORD)
