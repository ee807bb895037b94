"""Reference-shaped inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.canonical import instant_text
from siltstone.operators.projection import typed
from siltstone.sources.scratch import scratch  # noqa: F401  (the plans' way to it)
from siltstone.types import CollectionDefinition, Field

ITEMS = CollectionDefinition("items", (Field("team", "string"), Field("score", "number", nullable=True), Field("active", "boolean"), Field("at", "date-time")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(rows: DataFrame, n: Column, team: Column, score: Column, at: Column) -> DataFrame:
    team_kind, team_val = typed(team, "string")
    score_kind, score_val = typed(score, "number", null=n % 11 == 0)
    active_kind, active_val = typed(n % 2 == 0, "boolean", missing=n % 13 == 0)
    at_kind, at_val = typed(instant_text(at), "date-time")
    return rows.select(
        F.format_string("rec_%08d", n).alias("record_id"), n.alias("n"), at.alias("created_at"), (100 + n % 50).alias("n_bytes"),
        team_kind.alias("team__kind"), team_val.alias("team__val"), score_kind.alias("score__kind"), score_val.alias("score__val"),
        active_kind.alias("active__kind"), active_val.alias("active__val"), at_kind.alias("at__kind"), at_val.alias("at__val"), at.cast("timestamp").alias("at__ts"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a typed projection: score null every 11th, active missing every 13th."""
    return _items(table(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type"), F.col("value"), F.col("ts"))


def items_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as the same projection; n from the order and part keys, which is no identity but repeats evenly."""
    n = F.col("l_orderkey") * 7 + F.col("l_partkey") + F.col("l_linenumber")
    return _items(table(spark, sf_dir, "lineitem"), n, F.col("l_returnflag"), F.col("l_extendedprice"), F.col("l_shipdate"))


def items_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with twenty teams, by the part's key."""
    n = F.col("l_orderkey") * 7 + F.col("l_partkey") + F.col("l_linenumber")
    return _items(table(spark, sf_dir, "lineitem"), n, F.concat(F.lit("team-"), (F.col("l_partkey") % 20).cast("string")), F.col("l_extendedprice"), F.col("l_shipdate"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: record = user, revision within it, position = rank of the commit."""
    events = table(spark, sf_dir, "events")
    mine = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) == 1
    revision = F.row_number().over(mine)
    op = F.when(revision == 1, "create").when(last & (F.col("event_type") == "error"), "delete").otherwise("replace")
    return events.select(
        F.format_string("user_%06d", "user_id").alias("record_id"), revision.cast("long").alias("revision"), (F.col("event_id") + 1).alias("position"), op.alias("op"), "event_type", "value", "ts", F.lit(1).alias("schema_version")
    )


ITEMS_SQL = """items AS (
  SELECT event_id AS n, 'rec_' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS record_id, ts, CAST(100 + event_id % 50 AS BIGINT) AS n_bytes, event_type AS team,
    CASE WHEN event_id % 11 = 0 THEN 'null' ELSE 'number' END AS score_kind, CASE WHEN event_id % 11 <> 0 THEN value END AS score,
    CASE WHEN event_id % 13 = 0 THEN 'missing' ELSE 'boolean' END AS active_kind, CASE WHEN event_id % 13 <> 0 THEN event_id % 2 = 0 END AS active
  FROM events)"""

BIG_SQL = """big AS (
  SELECT *, l_returnflag AS team, CASE WHEN k % 11 = 0 THEN 'null' ELSE 'number' END AS score_kind, CASE WHEN k % 11 <> 0 THEN l_extendedprice END AS score,
    CASE WHEN k % 13 = 0 THEN 'missing' ELSE 'boolean' END AS active_kind, CASE WHEN k % 13 <> 0 THEN k % 2 = 0 END AS active, l_shipdate AS ts
  FROM (SELECT *, l_orderkey * 7 + l_partkey + l_linenumber AS k FROM lineitem))"""

TEAMS_SQL = BIG_SQL.replace("l_returnflag AS team", "'team-' || l_partkey % 20 AS team")

LOG_SQL = """log AS (
  SELECT 'user_' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS record_id, revision, event_id + 1 AS position, event_type, value, ts,
    CASE WHEN revision = 1 THEN 'create' WHEN back = 1 AND event_type = 'error' THEN 'delete' ELSE 'replace' END AS op
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events))"""
