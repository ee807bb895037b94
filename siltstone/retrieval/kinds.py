"""What a search may find, by kind: records at their revision, sources at their latest extraction, claims at theirs.

The three kinds' authorities are brought to one shape, a row per ref with `extraction` where the kind has one, so that a
chunk is live if it was built from what is true now: of a record or a claim the revision, of a source the revision and
the last extraction.  Citations carry what the kind has: a record's field, a source's place in its bytes, a claim's
evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.retrieval.search import REF

KINDS = ("record", "source", "claim")


def authority(records: DataFrame, entities: DataFrame, extractions: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """(REF, revision, tombstone, extraction) of all refs in live collections.

    records: collection_id, record_id, revision, tombstone; entities: collection_id, kind (source or claim), entity_id,
    revision, tombstone; extractions: collection_id, source_id, version; collections: collection_id, lifecycle.  A
    source that was never extracted has no extraction, so no chunk of it is live.
    """
    rows = records.select("collection_id", F.lit("record").alias("kind"), F.col("record_id").alias("ref_id"), "revision", "tombstone", F.lit(None).cast("long").alias("extraction"))
    last = extractions.groupBy("collection_id", F.col("source_id").alias("entity_id")).agg(F.max("version").cast("long").alias("extraction")).withColumn("kind", F.lit("source"))
    other = entities.join(last, ["collection_id", "kind", "entity_id"], "left").select("collection_id", "kind", F.col("entity_id").alias("ref_id"), "revision", "tombstone", "extraction")
    both = rows.unionByName(other.filter("kind <> 'source' OR extraction IS NOT NULL"))
    if collections is None:
        return both
    return both.join(collections.filter("lifecycle <> 'deleted'").select("collection_id").distinct(), "collection_id", "left_semi")


def live_chunks(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """The chunks (REF, revision, extraction) that were built from what refs (as `authority` gives them) are now: a union of three semi-joins."""
    now = refs.filter(~F.col("tombstone"))
    out = []
    for kind in KINDS:
        mine, theirs = chunks.filter(F.col("kind") == kind), now.filter(F.col("kind") == kind)
        keys = ["collection_id", "ref_id", "revision", *(["extraction"] if kind == "source" else [])]
        out.append(mine.join(theirs.select(*keys), keys, "left_semi").select(*chunks.columns))
    return out[0].unionByName(out[1]).unionByName(out[2])


def cited(found: DataFrame, spans: DataFrame, records: DataFrame, extractions: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One citation per hit: its chunk's stretch of the text that the authority has now, and what its kind tells of where that comes from.

    found: rank, REF, revision, chunk_index (the hits of a page); spans: REF, revision, extraction, chunk_index, field,
    start, end; records: collection_id, record_id, field, text; extractions: collection_id, source_id, version, content,
    segments (start, end, source_start, source_end); claims: collection_id, claim_id, revision, statement; evidence:
    collection_id, claim_id, revision, ordinal, source_collection_id, source_id.  A source's stretch has the bytes it
    was taken from, where one segment holds it; a claim's has its evidence in order.
    """
    few = F.broadcast(found.select("rank", *REF, F.col("revision").alias("_revision"), "chunk_index"))
    at = spans.join(few, [*REF, "chunk_index"]).filter(F.col("revision") == F.col("_revision")).drop("_revision")
    part = lambda text: F.when(F.char_length(text) >= F.col("end"), F.substring(text, F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")))
    none = F.lit(None).cast("long")
    nobody = F.lit(None).cast("array<struct<source_collection_id:string,source_id:string>>")
    shape = ["rank", *REF, "field", "start", "end", "text", "source_start", "source_end", "evidence"]
    of_records = at.filter("kind = 'record'").join(records.withColumnRenamed("record_id", "ref_id"), ["collection_id", "ref_id", "field"])
    of_records = of_records.withColumn("text", part(F.col("text"))).withColumn("source_start", none).withColumn("source_end", none).withColumn("evidence", nobody)
    last = extractions.withColumn("_last", F.max("version").over(Window.partitionBy("collection_id", "source_id"))).filter("version = _last")
    of_sources = at.filter("kind = 'source'").join(last.select("collection_id", F.col("source_id").alias("ref_id"), F.col("version").alias("extraction"), "content", "segments"), ["collection_id", "ref_id", "extraction"])
    inside = F.filter("segments", lambda s: (s["start"] <= F.col("start")) & (F.col("end") <= s["end"]))[0]
    # Texts are decoded from UTF-8, so bytes go on from the segment's start as the characters do.
    before = F.octet_length(F.substring("content", inside["start"].cast("int") + 1, (F.col("start") - inside["start"]).cast("int")))
    of_sources = of_sources.withColumn("text", part(F.col("content"))).withColumn("source_start", (inside["source_start"] + before).cast("long"))
    of_sources = of_sources.withColumn("source_end", (F.col("source_start") + F.octet_length("text")).cast("long")).withColumn("evidence", nobody)
    told = evidence.groupBy("collection_id", F.col("claim_id").alias("ref_id"), "revision").agg(F.array_sort(F.collect_list(F.struct("ordinal", "source_collection_id", "source_id"))).alias("_e"))
    of_claims = at.filter("kind = 'claim'").join(claims.withColumnRenamed("claim_id", "ref_id"), ["collection_id", "ref_id", "revision"]).join(told, ["collection_id", "ref_id", "revision"], "left")
    of_claims = of_claims.withColumn("text", part(F.col("statement"))).withColumn("source_start", none).withColumn("source_end", none)
    of_claims = of_claims.withColumn("evidence", F.transform("_e", lambda e: F.struct(e["source_collection_id"].alias("source_collection_id"), e["source_id"].alias("source_id"))))
    return of_records.select(*shape).unionByName(of_sources.select(*shape)).unionByName(of_claims.select(*shape))
