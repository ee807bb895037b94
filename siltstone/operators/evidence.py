"""Sources, claims and links: visibility by grants, current revisions, cascades."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.history import placed

TEXT_TYPES = ("text/plain", "text/markdown", "text/csv", "text/tab-separated-values")


def readable(grants: DataFrame, key: str, capability: str, owned: DataFrame | None = None) -> DataFrame:
    """Collections that a credential may use so: unexpired grants whose capabilities hold it.

    The owner of a space needs no grant: where `owned` has its collections (collection_id, lifecycle), all that are not deleted.
    """
    if owned is not None:
        return owned.filter("lifecycle <> 'deleted'").select("collection_id").distinct()
    live = F.col("expires_at").isNull() | (F.col("expires_at") > F.current_timestamp()) if "expires_at" in grants.columns else F.lit(True)
    return grants.filter((F.col("credential") == key) & F.array_contains("capabilities", capability) & live).select("collection_id").distinct()


def current_claims(revisions: DataFrame) -> DataFrame:
    """Each claim at its highest revision."""
    others = [c for c in revisions.columns if c not in ("claim_id", "revision")]
    return revisions.groupBy("claim_id").agg(F.max("revision").alias("revision"), F.max_by(F.struct(*others), "revision").alias("x")).select("claim_id", "revision", "x.*")


def reviewed(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Current claims with the `status` of the last review of that very revision; a new revision starts unreviewed.

    reviews: claim_id, revision, status, reviewed_at.
    """
    last = reviews.groupBy("claim_id", "revision").agg(F.max_by("status", "reviewed_at").alias("status"))
    return claims.join(last, ["claim_id", "revision"], "left").withColumn("status", F.coalesce("status", F.lit("unreviewed")))


def hidden_claims(evidence: DataFrame, readable_: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Claims of which some revision cites a collection that cannot be read, or, given the live ones, is not live."""
    seen = readable_.select("collection_id")
    if live is not None:
        seen = seen.join(live.select("collection_id").distinct(), "collection_id", "left_semi")
    return evidence.join(seen, evidence.cited == seen.collection_id, "left_anti").select("claim_id").distinct()


def visible_claims(claims: DataFrame, evidence: DataFrame, readable_: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Claims of which no revision cites a collection that cannot be read, or is not live."""
    return claims.join(hidden_claims(evidence, readable_, live), "claim_id", "left_anti")


def readable_endpoints(endpoints: DataFrame, readable_: DataFrame, hidden: DataFrame) -> DataFrame:
    """Of the endpoints (kind, id, collection_id) those a link may show: in a readable collection, and no hidden claim."""
    seen = endpoints.join(readable_.select("collection_id").distinct(), "collection_id", "left_semi")
    gone = hidden.select(F.lit("claim").alias("kind"), F.col("claim_id").alias("id"))
    return seen.join(gone, ["kind", "id"], "left_anti").select("kind", "id")


def claims_citing(claims: DataFrame, evidence: DataFrame, collection, status: str | None = None, limit: int = 25) -> DataFrame:
    """Claims that cite a collection, by id; of one status, where it is named."""
    cited = evidence.filter(F.col("cited") == collection).select("claim_id").distinct()
    rows = claims if status is None else claims.filter(F.col("status") == status)
    return rows.join(cited, "claim_id", "left_semi").orderBy("claim_id").limit(limit)


def erased(sources: DataFrame, contents: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and contents after the deletion of some (source_id): first they are tombstones, then their bytes go.

    Written in this order, a stop in between leaves bytes that no live source names, which `orphans` finds.
    """
    dead = gone.select("source_id").distinct().withColumn("_gone", F.lit(True))
    marked = sources.join(dead, "source_id", "left").withColumn("tombstone", F.coalesce("_gone", F.lit(False)) | F.col("tombstone")).drop("_gone").select(*sources.columns)
    return marked, contents.join(dead, "source_id", "left_anti")


def orphans(contents: DataFrame, sources: DataFrame) -> DataFrame:
    """Contents whose source is deleted or was never there."""
    return contents.join(sources.filter(~F.col("tombstone")).select("source_id").distinct(), "source_id", "left_anti")


def purged(tables: dict[str, DataFrame], space) -> dict[str, DataFrame]:
    """Every table of a store without the rows of a space; where tables are partitioned by space, only the others' are read."""
    return {name: rows.filter(~F.col("space_id").eqNullSafe(F.lit(space))) for name, rows in tables.items()}


def visible_links(links: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Links both of whose endpoints (kind, id) can be read."""
    a = endpoints.select(F.col("kind").alias("from_kind"), F.col("id").alias("from_id"))
    b = endpoints.select(F.col("kind").alias("to_kind"), F.col("id").alias("to_id"))
    return links.join(a, ["from_kind", "from_id"], "left_semi").join(b, ["to_kind", "to_id"], "left_semi")


def delete_endpoints(links: DataFrame, deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What deleting endpoints (id) does: outcome per deletion, and the links that a cascade tombstones.

    A live restrict link at either end refuses the deletion; otherwise its detach links go with it.  Deletions go by
    their ids; a link both of whose ends go is the first one's.
    """
    ends = links.select("link_id", "policy", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id"))
    touched = ends.join(deletions.select("id"), "id")
    blocked = touched.filter("policy = 'restrict'").select("id").distinct()
    first = touched.filter("policy = 'detach'").join(blocked, "id", "left_anti").groupBy("link_id").agg(F.min("id").alias("id"))
    told = deletions.select("id").distinct().join(blocked.withColumn("blocked", F.lit(True)), "id", "left").join(first.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left")
    outcome = told.select("id", F.when(F.col("blocked"), "LINK_RESTRICTED").otherwise("ok").alias("outcome"), F.coalesce("n", F.lit(0).cast("long")).alias("detached"))
    return outcome, first.select("link_id")


def links_of(links: DataFrame, endpoint: str, after: str = "", limit: int = 50) -> DataFrame:
    """Links at an endpoint, by id."""
    return links.filter(((F.col("from_id") == endpoint) | (F.col("to_id") == endpoint)) & (F.col("link_id") > after)).orderBy("link_id").limit(limit)


def _extract(batches):
    for batch in batches:
        out = []
        for source_id, mime, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            text, code = None, None
            if mime not in TEXT_TYPES:
                code = "UNSUPPORTED"
            else:
                try:
                    text = (content or b"").decode("utf-8")
                    text = text[1:] if text[:1] == "\ufeff" else text
                except UnicodeDecodeError:
                    code = "INVALID_TEXT"
            cut = 3 if code is None and (content or b"")[:3] == b"\xef\xbb\xbf" else 0
            out.append((source_id, text, code, None if text is None else [{"start": 0, "end": len(text), "source_start": cut, "source_end": len(content or b"")}]))
        segment = pa.struct([(n, pa.int64()) for n in ("start", "end", "source_start", "source_end")])
        kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.list_(segment)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["source_id", "content", "code", "segments"])


def extract_text(sources: DataFrame) -> DataFrame:
    """Strict UTF-8 texts of sources (source_id, mime, bytes), less one byte-order mark, with their one offset segment."""
    kind = sources.schema["source_id"].dataType.simpleString()
    return sources.select("source_id", "mime", "content").mapInArrow(_extract, f"source_id {kind}, content string, code string, segments array<struct<start:bigint,end:bigint,source_start:bigint,source_end:bigint>>")


def distinct_best(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def top_per_group(rows: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each key, numbered in `position`."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("position") <= k)


def fair_turns(rows: DataFrame, folder: str, space: str, pair: str, *order: str) -> DataFrame:
    """Queue turns: a pair's first rows before its second ones, and within a space its pairs in turn.

    Both places come from sorted ranges of all rows, written to `folder`, so that no task holds a space, a pair or a turn.
    """
    turns = placed(rows, f"{folder}/pairs", [space, pair], *order, name="pair_turn")
    return placed(turns, f"{folder}/spaces", [space], "pair_turn", pair, name="space_turn")
