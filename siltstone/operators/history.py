"""The change log: as-of snapshots, the feed, freshness, export pages and their manifest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.types import EXPORT_BYTES, EXPORT_PAGES, EXPORT_ROWS, FEED_ROWS, EngineError


def as_of(log: DataFrame, watermark: int, payload: list[str], dead: bool = False) -> DataFrame:
    """Live records at a feed position: of each record the highest revision (not position) up to it, deletes dropped.

    With `dead` the deleted ones are kept, and `op` tells them.
    """
    last = F.max_by(F.struct("op", "revision", *payload), "revision").alias("last")
    found = log.filter(F.col("position") <= watermark).groupBy("record_id").agg(last).select("record_id", "last.*")
    return found if dead else found.filter("op <> 'delete'").drop("op")


def as_of_page(log: DataFrame, watermark: int, payload: list[str], after: str = "", limit: int = EXPORT_ROWS, max_bytes: int = EXPORT_BYTES, size: Column | None = None, dead: bool = False) -> DataFrame:
    """The next records at a position by their ids' bytes: at most `limit`, and none once those before it have `max_bytes`.

    `size` is a record's bytes (that of its payload as JSON, if not given).  Deleted records take their place in the
    limit, have no bytes, and are dropped after the cut, unless `dead` keeps them; `cursor` is the last id cut, dropped
    or not, and `more` whether records follow it.
    """
    rows = as_of(log.filter(F.col("record_id") > after), watermark, payload, dead=True)
    size = F.octet_length(F.to_json(F.struct(*payload))) if size is None else size
    top = rows.withColumn("n_bytes", F.when(F.col("op") == "delete", 0).otherwise(size)).orderBy("record_id").limit(limit + 1)
    # At most limit + 1 rows, 1,001 by the contract.
    by = Window.partitionBy(F.lit(0)).orderBy("record_id")
    held = top.withColumn("position", F.row_number().over(by)).withColumn("_before", F.coalesce(F.sum("n_bytes").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    held = held.withColumn("_in", (F.col("position") <= limit) & (F.col("_before") < max_bytes))
    whole = Window.partitionBy(F.lit(0))
    told = held.withColumn("more", F.max(~F.col("_in")).over(whole)).withColumn("cursor", F.max(F.when(F.col("_in"), F.col("record_id"))).over(whole))
    cut = told.filter("_in").drop("_in", "_before")
    return cut if dead else cut.filter("op <> 'delete'").drop("op")


def feed(log: DataFrame, cursor: int, limit: int = FEED_ROWS) -> DataFrame:
    """The events after a cursor, in feed order."""
    return log.filter(F.col("position") > cursor).orderBy("position").limit(limit)


def numbered(rows: DataFrame, folder: str, *order: str) -> DataFrame:
    """The rows with `place`, from 0, in an order over all of them: sorted ranges, and before each how many rows the others have.

    The ranges are written to `folder` with their numbers, so that a task run again counts the same rows.
    """
    spark = rows.sparkSession
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    held = spark.read.schema(rows.withColumn("_range", F.lit(0)).schema).parquet(folder)
    # One row per range.
    sizes = held.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    mine = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return held.join(F.broadcast(before.select("_range", "_before")), "_range").withColumn("place", F.col("_before") + mine).drop("_range", "_before")


def placed(rows: DataFrame, folder: str, keys: list[str], *order: str, name: str) -> DataFrame:
    """The rows with `name`, their place from 1 among those of equal keys, without a window over a key's rows."""
    all_ = numbered(rows, folder, *keys, *order)
    first = all_.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.min("place").alias("_first"))
    both = F.lit(True)
    for k in keys:
        both = both & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return all_.join(first, both).select(*rows.columns, (F.col("place") - F.col("_first") + 1).alias(name))


def published(committed: DataFrame, last: int, folder: str) -> DataFrame:
    """Positions for committed events that have none, in commit order after `last`, by collection.

    All events are ordered by collection and commit in ranges; a collection of any size goes over as many as it needs.
    """
    placed = numbered(committed, folder, "collection_id", "committed_at", "event_id")
    # One row per collection; Spark broadcasts them where it finds them small.
    first = placed.groupBy("collection_id").agg(F.min("place").alias("_first"))
    return placed.join(first, "collection_id").withColumn("position", F.col("place") - F.col("_first") + 1 + F.lit(last)).select(*committed.columns, "position")


def freshness(log: DataFrame, watermark: Column | int, version: int, unpublished: DataFrame | None = None) -> DataFrame:
    """One row: whether a snapshot at the watermark is exact, and how many later events there are.

    Committed events that have no position yet (`unpublished`, where given) are later than any, and make a snapshot stale.
    """
    later = F.count_if(F.col("position") > watermark)
    same = F.coalesce(F.max("schema_version"), F.lit(version)) == version
    told = log.agg(F.coalesce(F.max("position"), F.lit(0)).alias("head"), later.alias("later"), same.alias("_same"))
    if unpublished is not None:
        told = told.crossJoin(unpublished.agg(F.count(F.lit(1)).alias("unpublished")))  # one row each
    waiting = F.col("unpublished") if unpublished is not None else F.lit(0)
    return told.withColumn("freshness", F.when((F.col("later") == 0) & (waiting == 0) & F.col("_same"), "exact").otherwise("stale")).drop("_same").select("head", "later", *(["unpublished"] if unpublished is not None else []), "freshness")


def export_lines(snapshot: DataFrame, data: Column) -> DataFrame:
    """record_id and the NDJSON line {"id","revision","data"} of each record."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("record_id").cast("string").alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    return snapshot.select("record_id", F.concat(F.lit('{"id":'), quoted, F.lit(',"revision":'), F.col("revision").cast("string"), F.lit(',"data":'), data, F.lit("}\n")).alias("line"))


#: Pages' worth of rows in a range of `paged`.
RANGE_PAGES = 64


def next_starts(sizes: np.ndarray, max_rows: int, max_bytes: int) -> np.ndarray:
    """From each row, where the page that starts there ends: at most so many rows and bytes, in one pass of binary searches."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    full = np.searchsorted(before, before[:-1] + max_bytes, "right") - 1
    if len(sizes) and sizes.max() > max_bytes:
        raise ValueError(f"a row does not fit a page of {max_bytes} bytes")
    return np.minimum(full, np.arange(len(sizes)) + max_rows)


def exits(nexts: np.ndarray, length: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place at which pages may enter a range of `length` rows: the first start beyond it, and the last start in it.

    All entries go on page by page at once, as far as each is still in the range.
    """
    at = np.arange(min(entries, length))
    last = at.copy()
    while len(inside := np.flatnonzero(at < length)):
        last[inside] = at[inside]
        at[inside] = nexts[at[inside]]
    return at, last


def paged(rows: DataFrame, folder: str, order: str, size: str, max_rows: int, max_bytes: int) -> DataFrame:
    """The rows with `page`, the place at which their page begins: pages are cut greedily in the order of all rows.

    A page goes on where the last one ended, so that where it begins depends on all rows before it.  Rows are numbered in
    sorted ranges and dealt to runs of as many rows as some pages have; every run works out, from each row at which a page
    may enter it, where that page and its successors lead; these tables, of as many numbers as a page has rows, are put one
    after another on the driver; and each run then cuts its own rows from where the last page ended.
    """
    placed = numbered(rows, folder, order)
    run = RANGE_PAGES * max_rows
    mine = F.floor(F.col("place") / run).cast("long")
    # The rows after a run that a page of it may reach go to it, too.
    near = F.when((F.col("place") % run < max_rows) & (mine > 0), F.array(mine, mine - 1)).otherwise(F.array(mine))
    sizes = placed.select(F.explode(near).alias("run"), "place", F.col(size).alias("bytes"))

    def tables(key, table):
        table = table.sort_by("place")
        first = key[0].as_py() * run
        length = min(run, table.num_rows)
        at, last = exits(next_starts(table["bytes"].to_numpy(), max_rows, max_bytes), length, max_rows)
        return pa.table({"run": [key[0].as_py()], "exits": [(at + first).tolist()], "lasts": [(last + first).tolist()]})

    told = sizes.groupBy("run").applyInArrow(tables, "run long, exits array<long>, lasts array<long>")
    entry, last, entries = 0, 0, []
    for r in told.orderBy("run").toLocalIterator():
        entries.append((r.run, entry, last))
        if entry - r.run * run >= len(r.exits):
            continue  # the last page swallows all that is left
        entry, last = r.exits[entry - r.run * run], r.lasts[entry - r.run * run]
    told = F.broadcast(rows.sparkSession.createDataFrame(entries, "run long, entry long, last long"))

    def cut(key, table):
        table = table.sort_by("place")
        first, length = key[0].as_py() * run, min(run, table.num_rows)
        nexts = next_starts(table["bytes"].to_numpy(), max_rows, max_bytes)
        at, starts = table["entry"][0].as_py() - first, []
        while at < length:
            starts.append(at)
            at = int(nexts[at])
        which = np.searchsorted(starts, np.arange(length), "right") - 1
        page = np.where(which >= 0, np.array(starts, np.int64)[np.maximum(which, 0)] + first if starts else 0, table["last"][0].as_py())
        return pa.table({"place": np.arange(length) + first, "page": page})

    pages = sizes.join(told, "run").groupBy("run").applyInArrow(cut, "place long, page long")
    return placed.join(pages, "place").drop("place")


def export_pages(lines: DataFrame, folder: str, max_rows: int = EXPORT_ROWS, max_bytes: int = EXPORT_BYTES) -> DataFrame:
    """Pages of the lines in the order of all record ids: first_id, rows, bytes, sha256, body.

    A page has at most so many rows and bytes and goes on where the last one ended.  A null line is a deleted record's: it
    takes its place among a page's rows, and a page of nothing else is none.  A line that fits no page refuses the
    export, as do more than EXPORT_PAGES pages.
    """
    sized = lines.select("record_id", "line", F.coalesce(F.octet_length("line"), F.lit(0)).cast("long").alias("bytes"))
    told = sized.agg(F.max("bytes").alias("most"), F.sum("bytes").alias("whole"), F.count(F.lit(1)).alias("n")).first()
    if (told.most or 0) > max_bytes:
        raise EngineError("RESULT_TOO_LARGE", f"a record does not fit a page of {max_bytes} bytes", limit="bytes")
    if (told.whole or 0) > EXPORT_PAGES * max_bytes or told.n > EXPORT_PAGES * max_rows:
        raise EngineError("RESULT_TOO_LARGE", f"more than {EXPORT_PAGES} pages", limit="pages")
    rows = paged(sized, folder, "record_id", "bytes", max_rows, max_bytes).filter("line IS NOT NULL")
    # A page has at most max_bytes.
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_id", "line"))), lambda s: s.line), "")
    pages = rows.groupBy("page").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"), body.alias("body"))
    return pages.select("first_id", "rows", "bytes", F.sha2("body", 256).alias("sha256"), "body")


def manifest(pages: DataFrame) -> DataFrame:
    """One row: pages, rows, bytes, and the digest of the pages' digests in order; an export of over 10,000 pages is refused."""
    told = pages.select("first_id", "rows", "bytes", "sha256")
    if told.limit(EXPORT_PAGES + 1).count() > EXPORT_PAGES:
        raise EngineError("RESULT_TOO_LARGE", f"more than {EXPORT_PAGES} pages", limit="pages")
    digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_id", "sha256"))), lambda s: s.sha256), "")
    return told.agg(F.count(F.lit(1)).alias("pages"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sha2(digests, 256).alias("digest"))
