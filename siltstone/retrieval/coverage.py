"""Which embedder serves, and how far a projection has come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.types import EngineError

#: Projection states from best to worst; fixed values.
STATES = ("current", "pending", "degraded", "unindexed")


def choose(embedders: list[dict], identity: str, regions: list[str]) -> dict:
    """Of the embedders of an identity in allowed regions: the cheapest, then the best, then by region order, then by name."""
    able = [e for e in embedders if e["identity"] == identity and e["region"] in regions]
    if not able:
        raise EngineError("PROVIDER_UNAVAILABLE", f"no embedder for {identity}")
    return min(able, key=lambda e: (e["cost"], -e["quality"], regions.index(e["region"]), e["name"]))


def projection_state(refs: DataFrame, outbox: DataFrame, keys: list[str]) -> DataFrame:
    """Per collection the worst state of its refs, and how many are in each.

    A ref without an outbox row is unindexed, one with failures degraded, one not delivered pending.
    """
    rows = refs.join(outbox, keys, "left")
    rank = F.when(F.col("delivered").isNull(), 3).when(F.col("failures") > 0, 2).when(~F.col("delivered"), 1).otherwise(0)
    names = F.array(*map(F.lit, STATES))
    counts = [F.count_if(F.col("_rank") == i).alias(s) for i, s in enumerate(STATES)]
    return rows.withColumn("_rank", rank).groupBy("collection_id").agg(F.element_at(names, F.max("_rank") + 1).alias("state"), *counts)
