"""A whole space as an ordered set of parts, sealed by a manifest: eleven sections of lines, cut by bytes at prefix sums.

Where a line's bytes lie in its section is the sum of what comes before it, from sorted ranges; a part is a stretch of
fixed length less the three bytes by which its end may move back to the start of a character, so that every part is
known without the parts before it and all are cut at once.  A line may go over many parts.  The manifest lists sections
and parts with their rows (lines that end there), bytes and digests, and is written last.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.facts import claim, read_small
from siltstone.types import EngineError

#: Sections in their order; fixed values of the format.
SECTIONS = ("permissions", "schemas", "retrieval", "sources", "extractions", "claims", "provenance", "links", "events", "records", "revisions")
PART_BYTES, MAX_PARTS = 1 << 20, 4095
FORMAT, VERSION = "siltstone.space-export", 1
EXCLUDED = ["credential secrets", "session tokens", "storage object keys", "original bytes", "derived projections"]


def _placed(lines: DataFrame, folder: str) -> DataFrame:
    """(section, line, bytes, at): each line with its length and where it begins in its section, in the order of the keys."""
    spark = lines.sparkSession
    sized = lines.select("section", "key", "line", F.octet_length("line").cast("long").alias("bytes"))
    sized.repartitionByRange("section", "key").sortWithinPartitions("section", "key").withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    held = spark.read.schema(sized.withColumn("_range", F.lit(0)).schema).parquet(folder)
    # One row per range and section in it.
    sums = held.groupBy("section", "_range").agg(F.sum("bytes").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("section").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    mine = F.coalesce(F.sum("bytes").over(Window.partitionBy("section", "_range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(before.select("section", "_range", "_before")), ["section", "_range"]).select("section", "line", "bytes", (F.col("_before") + mine).alias("at"))


def _pieces(stride: int):
    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for section, line, at in zip(*[batch.column(c).to_pylist() for c in ("section", "line", "at")], strict=True):
                data, start = line.encode(), 0
                last = (at + len(data) - 1) // stride
                for part in range(at // stride, last + 1):
                    end = len(data)
                    if part < last:
                        end = (part + 1) * stride - at
                        while data[end] & 0xC0 == 0x80:
                            end -= 1
                    for column, x in zip(out, (section, part, at + start, data[start:end].decode()), strict=True):
                        column.append(x)
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["section", "part", "at", "piece"])

    return run


def parts(lines: DataFrame, folder: str, part_bytes: int = PART_BYTES, most: int | None = None) -> DataFrame:
    """(section, part, rows, bytes, sha256, body) of lines (section, key, line); keys order a section's lines, which end with a line break.

    Parts are numbered from 0 within their section.  A part holds at most `part_bytes`, whatever a line's length.  There
    are as many as the lines fill; `most`, where given, refuses lines that no so many parts hold.
    """
    unknown = lines.filter(~F.col("section").isin(*SECTIONS) | F.col("line").isNull() | ~F.col("line").endswith("\n") | (F.instr("line", "\n") < F.char_length("line")))
    if not unknown.isEmpty():
        raise EngineError("UNPROCESSABLE", "a line is of a known section, and ends with its one line break")
    stride = part_bytes - 3
    placed = _placed(lines, folder)
    if most is not None and (placed.agg(F.sum("bytes")).first()[0] or 0) > most * part_bytes:
        raise EngineError("RESULT_TOO_LARGE", f"more than {most} parts", limit="parts")
    cut = placed.select("section", "line", "at").mapInArrow(_pieces(stride), "section string, part long, at long, piece string")
    # A part has at most part_bytes.  Pieces without bytes, of lines whose start moved back, are none.
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s.piece), "")
    made = cut.filter("piece <> ''").groupBy("section", "part").agg(body.alias("body"))
    rows = (F.char_length("body") - F.char_length(F.replace("body", F.lit("\n"), F.lit("")))).cast("long")
    return made.select("section", "part", rows.alias("rows"), F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"), "body")


def export(lines: DataFrame, folder: str, scratch: str, job: str, space: dict, boundary: dict, part_bytes: int = PART_BYTES) -> dict:
    """Write the parts and, last, the manifest; the digest of the manifest, and how many parts there are with it."""
    spark = lines.sparkSession
    # A manifest lists at most MAX_PARTS.
    parts(lines, scratch, part_bytes, MAX_PARTS).write.partitionBy("section").parquet(f"{folder}/parts")
    told = sorted(_told(spark, folder).collect(), key=lambda r: (SECTIONS.index(r.section), r.part))  # at most MAX_PARTS
    if len(told) > MAX_PARTS:
        raise EngineError("RESULT_TOO_LARGE", f"{len(told)} parts", limit="parts")
    listed = [{"number": i, "section": r.section, "rows": r.rows, "bytes": r.bytes, "sha256": r.sha256} for i, r in enumerate(told, 1)]
    totals = [{"name": s, **{k: sum(p[k] for p in listed if p["section"] == s) for k in ("rows", "bytes")}, "accelerator": False} for s in SECTIONS]
    manifest = {"format": FORMAT, "formatVersion": VERSION, "jobId": job, "space": space, "boundary": {**boundary, "records": "as-of-watermark", "evidence": "as-of-snapshot"}, "sections": totals, "parts": listed, "excluded": EXCLUDED}
    text = json.dumps(manifest, sort_keys=True, separators=(",", ":"))
    if not claim(spark, f"{folder}/manifest", text):
        raise EngineError("CONFLICT", "the folder holds an export")
    return {"sha256": hashlib.sha256(text.encode()).hexdigest(), "parts": len(listed) + 1}


_STORED = "part long, rows long, bytes long, sha256 string, body string, section string"


def _told(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(f"{folder}/parts").select("section", "part", "rows", "bytes", "sha256")


def verified(spark: SparkSession, folder: str, sha256: str) -> dict:
    """The manifest, if its digest is the one told and it holds for itself and for every part; else an error that says why.

    Parts are read in tasks; what comes back is a row for each.
    """

    def refuse(why: str):
        raise EngineError("CONFLICT", why)

    text = read_small(spark, f"{folder}/manifest")
    if text is None or hashlib.sha256(text.encode()).hexdigest() != sha256:
        refuse("the manifest is not the one told")
    m = json.loads(text)
    if (m.get("format"), m.get("formatVersion")) != (FORMAT, VERSION) or [s["name"] for s in m["sections"]] != list(SECTIONS) or set(m) != {"format", "formatVersion", "jobId", "space", "boundary", "sections", "parts", "excluded"}:
        refuse("not a manifest of this format")
    if [p["number"] for p in m["parts"]] != list(range(1, len(m["parts"]) + 1)) or len(m["parts"]) > MAX_PARTS:
        refuse("parts are numbered from 1 without a gap")
    order = [SECTIONS.index(p["section"]) if p["section"] in SECTIONS else -1 for p in m["parts"]]
    if order != sorted(order) or -1 in order or any(not 1 <= p["bytes"] <= PART_BYTES for p in m["parts"]):
        refuse("parts are of listed sections, in order, and of at most a mebibyte")
    for s in m["sections"]:
        if any(sum(p[k] for p in m["parts"] if p["section"] == s["name"]) != s[k] for k in ("rows", "bytes")):
            refuse(f"the parts of {s['name']} do not make up its totals")
    rows = spark.read.schema(_STORED).parquet(f"{folder}/parts")
    count = (F.char_length("body") - F.char_length(F.replace("body", F.lit("\n"), F.lit("")))).cast("long")
    seen = rows.select("section", "part", count.alias("rows"), F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"), F.col("body").endswith("\n").alias("ends"))
    found = sorted(seen.collect(), key=lambda r: (SECTIONS.index(r.section), r.part))
    if [(r.section, r.rows, r.bytes, r.sha256) for r in found] != [(p["section"], p["rows"], p["bytes"], p["sha256"]) for p in m["parts"]]:
        refuse("a part is not what the manifest lists")
    if any(not r.ends for r, after in zip(found, [*found[1:], None], strict=True) if after is None or after.section != r.section):
        refuse("a section ends within a line")
    return m


def section(spark: SparkSession, folder: str, name: str) -> str:
    """A section's text, put together on the driver: for readers of small ones."""
    rows = spark.read.schema(_STORED).parquet(f"{folder}/parts").filter(F.col("section") == name).select("part", "body").collect()
    return "".join(r.body for r in sorted(rows))
