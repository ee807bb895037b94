"""Who may do what: scope checks in their order, and the collections that a credential sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope_outcomes(requests: DataFrame, spaces: DataFrame, collections: DataFrame, grants: DataFrame) -> DataFrame:
    """Each request (request_id, space_id, collection_id, credential, capability, policy, write) once, with its `outcome`.

    The first that applies: no such row, a moved policy or placement, a space that is not there for use, a deleted
    collection, no live grant, a write to what is read-only.  Several grants of a credential count together, those
    past their `expires_at` not at all; a `placement` counts where requests and spaces both have one.
    """
    placed = "placement" in requests.columns and "placement" in spaces.columns
    s = spaces.select("space_id", F.col("lifecycle").alias("space_state"), F.col("policy").alias("space_policy"), *([F.col("placement").alias("space_placement")] if placed else []))
    c = collections.select("space_id", "collection_id", F.col("lifecycle").alias("collection_state"))
    live = F.col("expires_at").isNull() | (F.col("expires_at") > F.current_timestamp()) if "expires_at" in grants.columns else F.lit(True)
    able = grants.filter(live).select("space_id", "collection_id", "credential", F.explode("capabilities").alias("capability")).distinct().withColumn("granted", F.lit(True))
    rows = requests.join(s, "space_id", "left").join(c, ["space_id", "collection_id"], "left").join(able, ["space_id", "collection_id", "credential", "capability"], "left")
    moved = F.col("policy") != F.col("space_policy")
    if placed:
        moved = moved | ~F.col("placement").eqNullSafe(F.col("space_placement"))
    outcome = (
        F.when(F.col("space_state").isNull() | F.col("collection_state").isNull(), "NOT_FOUND")
        .when(moved, "FORBIDDEN")
        .when(F.col("space_state").isin("suspended", "deleting", "deleted"), "SPACE_UNAVAILABLE")
        .when(F.col("collection_state") == "deleted", "NOT_FOUND")
        .when(F.col("granted").isNull(), "FORBIDDEN")
        .when(F.col("write") & ((F.col("space_state") == "readOnly") | (F.col("collection_state") == "readOnly")), "SPACE_UNAVAILABLE")
        .otherwise("ok")
    )
    return rows.withColumn("outcome", outcome).select(*requests.columns, "outcome")


def discover(collections: DataFrame, fields: DataFrame, readable: DataFrame, after: str = "", limit: int = 8) -> DataFrame:
    """The next visible collections by id, with `ready` and `pending` field lists; one row more than `limit` tells of others."""
    listed = collections.join(readable, "collection_id", "left_semi").filter((F.col("lifecycle") != "deleted") & (F.col("collection_id") > after)).orderBy("collection_id").limit(limit + 1)
    held = fields.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.when(F.col("ready"), F.col("field")))).alias("ready"), F.array_sort(F.collect_list(F.when(~F.col("ready"), F.col("field")))).alias("pending"))
    none = F.array().cast("array<string>")
    return listed.join(held, "collection_id", "left").withColumn("ready", F.coalesce("ready", none)).withColumn("pending", F.coalesce("pending", none))
