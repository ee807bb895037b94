"""Generations of a projection: build at a snapshot, verify against authority, switch by a pointer."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.types import EngineError

#: Moves of a generation's state; fixed values.
MOVES = {"building": ("verifying", "retired"), "verifying": ("active", "building", "retired"), "active": ("standby",), "standby": ("active", "verifying", "retired"), "retired": ()}


@dataclass(frozen=True)
class Generation:
    number: int
    state: str = "building"

    def to(self, state: str) -> Generation:
        if state not in MOVES[self.state]:
            raise EngineError("CONFLICT", f"{self.state} does not become {state}")
        return replace(self, state=state)


def activate(generations: list[Generation], number: int) -> list[Generation]:
    """The generations with one activated; the one active before stands by, for a rollback."""
    return [g.to("active") if g.number == number else g.to("standby") if g.state == "active" else g for g in generations]


def applied(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key by the forward-only fence: deleted stays, then revision, then extraction."""
    rank = F.struct(F.col("deleted").cast("int").alias("d"), "revision", F.coalesce("extraction", F.lit(0)).alias("e"))
    others = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("x")).select(*keys, "x.*")


def mismatches(projected: DataFrame, authority: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of which projection and authority differ, and how."""
    a = authority.select(key, F.struct(*columns).alias("a"))
    p = projected.select(key, F.struct(*columns).alias("p"))
    both = a.join(p, key, "full").filter(~F.col("a").eqNullSafe(F.col("p")))
    return both.select(key, F.when(F.col("p").isNull(), "absent").when(F.col("a").isNull(), "extra").otherwise("differs").alias("difference"))


def unmet(needs: DataFrame, has: DataFrame, key: str) -> DataFrame:
    """(key, missing) of what needs (key, needed: an array) more than it has (key, held: an array)."""
    both = needs.join(has, key, "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    return both.select(key, F.array_sort(F.array_except("needed", "held")).alias("missing")).filter("size(missing) > 0")
