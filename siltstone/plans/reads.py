"""Queries: scans, filters, pages and aggregates over typed projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import exact
from siltstone.operators import records
from siltstone.operators.aggregate import Key, Metric, Spec, aggregated
from siltstone.operators.pages import Sort, page
from siltstone.operators.predicates import count_records, exists_record, where
from siltstone.operators.projection import drift, project
from siltstone.plans.inputs import BIG_SQL, ITEMS, ITEMS_SQL, TEAMS_SQL, items, items_big, items_teams, table
from siltstone.plans.registry import query

_I = f"WITH {ITEMS_SQL} "
_B = f"WITH {BIG_SQL} "


def _p(field, kind, operator, value=None):
    return {"field": field, "kind": kind, "operator": operator} | ({} if operator == "isNull" else {"value": value})


@query(_I + "SELECT record_id, team, score FROM items WHERE team <> 'error'")
def scan_live(spark, d):
    return records.live(_records(spark, d), 1, "items").select("record_id", F.col("team__val").alias("team"), F.col("score__val").alias("score"))


def _records(spark, d):
    """Items as records of one collection; errors are deleted ones."""
    return items(spark, d).withColumn("space_id", F.lit(1)).withColumn("collection_id", F.lit("items")).withColumn("tombstone", F.col("team__val") == "error")


@query(_I + "SELECT record_id, team, score, score_kind FROM items WHERE record_id = 'rec_00000077'")
def point_get(spark, d):
    found = records.get(_records(spark, d), "rec_00000077", include_tombstone=True)
    return found.select("record_id", F.col("team__val").alias("team"), F.col("score__val").alias("score"), F.col("score__kind").alias("score_kind"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE nfc_normalize(trim(c_name)) = 'Customer#000000042'")
def get_by_key(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("external_key"), F.lit(False).alias("tombstone"), "c_acctbal")
    found = records.by_key(rows, "external", "  Customer#000000042\u3000")
    return found.select(F.col("record_id").alias("c_custkey"), F.col("external_key").alias("c_name"), "c_acctbal")


def _filtered(spark, d, predicates):
    return where(items(spark, d), predicates, ITEMS).select("record_id", F.col("team__val").alias("team"))


@query(_I + "SELECT record_id, team FROM items WHERE team = 'click'")
def filter_eq(spark, d):
    return _filtered(spark, d, [_p("team", "string", "eq", "click")])


@query(_I + "SELECT record_id, team FROM items WHERE score >= 10 AND score < 40.5")
def filter_range(spark, d):
    return _filtered(spark, d, [_p("score", "number", "gte", 10), _p("score", "number", "lt", 40.5)])


@query(_I + "SELECT record_id, team FROM items WHERE team IN ('click', 'signup')")
def filter_in(spark, d):
    return _filtered(spark, d, [_p("team", "string", "in", ["click", "signup"])])


@query(_I + "SELECT record_id, team FROM items WHERE score_kind = 'null'")
def filter_isnull(spark, d):
    return _filtered(spark, d, [_p("score", "null", "isNull")])


@query(_I + "SELECT record_id, team FROM items WHERE team <= 'purchase' AND team >= 'click' AND active AND score > 1 AND score < 90 AND team IN ('click', 'error', 'purchase')")
def filter_and16(spark, d):
    six = [_p("team", "string", "lte", "purchase"), _p("team", "string", "gte", "click"), _p("active", "boolean", "eq", True), _p("score", "number", "gt", 1), _p("score", "number", "lt", 90)]
    return _filtered(spark, d, [*six, *[_p("team", "string", "in", ["click", "error", "purchase"])] * 11])


@query(_I + "SELECT record_id, team FROM items WHERE ts > TIMESTAMP '2024-01-10 12:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00.5'")
def filter_instant(spark, d):
    return _filtered(spark, d, [_p("at", "date-time", "gt", "2024-01-10T12:00:00Z"), _p("at", "date-time", "lte", "2024-01-20T00:00:00.500Z")])


@query(_I + "SELECT count(*) AS n FROM items WHERE team = 'view' AND score > 5")
def count_filtered(spark, d):
    return count_records(items(spark, d), [_p("team", "string", "eq", "view"), _p("score", "number", "gt", 5)])


@query(_I + "SELECT count(*) > 0 AS found FROM items WHERE team = 'view' AND score > 1000000")
def exists_filtered(spark, d):
    return exists_record(items(spark, d), [_p("team", "string", "eq", "view"), _p("score", "number", "gt", 1_000_000)])


def _paged(df):
    return df.select("record_id", F.col("position").cast("long").alias("position"), "more")


_ASC = "CASE score_kind WHEN 'missing' THEN 0 WHEN 'null' THEN 1 ELSE 2 END"


@query(_I + "SELECT record_id, row_number() OVER (ORDER BY ts, record_id) AS position, true AS more FROM items QUALIFY position <= 100")
def page_default(spark, d):
    return _paged(page(items(spark, d)))


@query(_I + f"SELECT record_id, row_number() OVER (ORDER BY {_ASC}, score, record_id) AS position, true AS more FROM items QUALIFY position <= 100")
def page_sort_asc(spark, d):
    return _paged(page(items(spark, d), Sort("score", "number"), definition=ITEMS))


@query(_I + f"SELECT record_id, row_number() OVER (ORDER BY {_ASC} DESC, score DESC, record_id) AS position, true AS more FROM items QUALIFY position <= 50")
def page_sort_desc(spark, d):
    return _paged(page(items(spark, d), Sort("score", "number", "desc"), limit=50))


@query(_I + f"SELECT record_id, row_number() OVER (ORDER BY {_ASC}, score, record_id) AS position, true AS more FROM items WHERE score_kind = 'number' AND (score > 3.5 OR (score = 3.5 AND record_id > 'rec_00001000')) QUALIFY position <= 40")
def page_continue(spark, d):
    return _paged(page(items(spark, d), Sort("score", "number"), (2, 3.5, "rec_00001000"), 40))


@query(_I + "SELECT record_id, position, more FROM (SELECT record_id, row_number() OVER w AS position, sum(n_bytes) OVER w AS b, true AS more FROM items WINDOW w AS (ORDER BY ts, record_id ROWS UNBOUNDED PRECEDING)) WHERE b <= 2000")
def page_byte_budget(spark, d):
    return _paged(page(items(spark, d), max_bytes=2000))


def _agg(df, spec, **renamed):
    out = aggregated(df, spec, ITEMS)
    return out.select(*[F.col(old).alias(new) for new, old in renamed.items()])


@query(_I + "SELECT count(*) AS n FROM items")
def agg_count(spark, d):
    return _agg(items(spark, d), Spec(), n="n")


_DEC = "regexp_replace(CAST(coalesce(sum(CAST(CAST({0} AS VARCHAR) AS DECIMAL(38, 6))), 0) AS VARCHAR), '\\.?0+$', '')"


@query(_B + f"SELECT team, count(*) AS n, {_DEC.format('score')} AS total, count(score) AS numbers, count(*) FILTER (score_kind = 'null') AS nulls FROM big GROUP BY team")
def agg_by_value(spark, d):
    spec = Spec(group_by=(Key("team"),), metrics=(Metric("count"), Metric("sum", "score")))
    return _agg(items_big(spark, d), spec, team="team__val", n="n", total="score_sum", numbers="score_values", nulls="score_nulls")


@query(_I + "SELECT active_kind, active, count(*) AS n FROM items GROUP BY ALL")
def agg_null_missing_keys(spark, d):
    return _agg(items(spark, d), Spec(group_by=(Key("active"),)), active_kind="active__kind", active="active__val", n="n")


@query(_B + "SELECT team, active_kind, active, strftime(date_trunc('year', ts), '%Y-%m-%dT%H:%M:%SZ') AS year, count(*) AS n, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_at FROM big GROUP BY ALL")
def agg_three_dims(spark, d):
    spec = Spec(group_by=(Key("team"), Key("active"), Key("at", "year")), metrics=(Metric("count"), Metric("min", "at")), max_groups=1000)
    return _agg(items_big(spark, d), spec, team="team__val", active_kind="active__kind", active="active__val", year="at__val", n="n", first_at="at_min")


@query(_B + "SELECT active_kind, active, count(*) AS n FROM big WHERE team = 'N' GROUP BY ALL")
def agg_filtered_broad(spark, d):
    return _agg(items_big(spark, d), Spec((_p("team", "string", "eq", "N"),), (Key("active"),)), active_kind="active__kind", active="active__val", n="n")


@query(_B + "SELECT team, count(*) AS n FROM big WHERE score < 1000 GROUP BY team")
def agg_filtered_selective(spark, d):
    return _agg(items_big(spark, d), Spec((_p("score", "number", "lt", 1000),), (Key("team"),)), team="team__val", n="n")


_TEAM = f"WITH {TEAMS_SQL} "
_MEAN = """
s AS (SELECT team, CAST(sum(CAST(CAST(score AS VARCHAR) AS DECIMAL(38, 2)) * 100) AS HUGEINT) AS cents, CAST(count(score) AS HUGEINT) AS k FROM big GROUP BY team),
q AS (SELECT team, 20 - length(CAST(cents // (100 * k) AS VARCHAR)) AS places, cents, k FROM s),
r AS (SELECT team, places, CAST((2 * cents * CAST(pow(10, places - 2) AS HUGEINT) + k) // (2 * k) AS VARCHAR) AS digits FROM q),
m AS (SELECT team, regexp_replace(left(digits, length(digits) - places) || '.' || right(digits, places), '\\.?0+$', '') AS mean FROM r) """


@query(f"WITH {TEAMS_SQL}, {_MEAN} SELECT team, count(*) AS n, {_DEC.format('score')} AS total, any_value(mean) AS mean, count(score) AS numbers, count(*) FILTER (score_kind = 'null') AS nulls FROM big JOIN m USING (team) GROUP BY team")
def agg_by_team(spark, d):
    """Count, exact sum and average of the score for each of twenty teams."""
    spec = Spec(group_by=(Key("team"),), metrics=(Metric("count"), Metric("sum", "score"), Metric("avg", "score")))
    return _agg(items_teams(spark, d), spec, team="team__val", n="n", total="score_sum", mean="score_avg", numbers="score_values", nulls="score_nulls")


@query(_TEAM + "SELECT strftime((date_trunc('month', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS start, count(*) AS n, max(score) AS most FROM big GROUP BY 1")
def bucket_month_max(spark, d):
    """Count and greatest score by month in New York."""
    spec = Spec(group_by=(Key("at", "month", "America/New_York"),), metrics=(Metric("count"), Metric("max", "score")), max_groups=1000)
    return _agg(items_teams(spark, d), spec, start="at__val", n="n", most="score_max")


@query(_TEAM + "SELECT team, active_kind, active, strftime(date_trunc('year', ts), '%Y-%m-%dT%H:%M:%SZ') AS year, count(*) AS n, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_at FROM big GROUP BY ALL")
def agg_team_active_year(spark, d):
    """Twenty teams by active and year: count and first instant."""
    spec = Spec(group_by=(Key("team"), Key("active"), Key("at", "year")), metrics=(Metric("count"), Metric("min", "at")), max_groups=1000)
    return _agg(items_teams(spark, d), spec, team="team__val", active_kind="active__kind", active="active__val", year="at__val", n="n", first_at="at_min")


@query(_TEAM + "SELECT active_kind, active, count(*) AS n FROM big WHERE team = 'team-3' GROUP BY ALL")
def agg_one_team(spark, d):
    return _agg(items_teams(spark, d), Spec((_p("team", "string", "eq", "team-3"),), (Key("active"),)), active_kind="active__kind", active="active__val", n="n")


@query("SELECT 0::BIGINT AS n, '0' AS total, 0::BIGINT AS numbers")
def agg_ungrouped_empty(spark, d):
    return _agg(items(spark, d), Spec((_p("team", "string", "eq", "no such team"),), metrics=(Metric("count"), Metric("sum", "score"))), n="n", total="score_sum", numbers="score_values")


@query(f"SELECT l_linestatus, {_DEC.format('l_extendedprice')} AS total, {_DEC.format('l_discount')} AS discounts FROM lineitem GROUP BY l_linestatus")
def agg_exact_sum(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_linestatus").agg(*exact.partial_sums(F.col("l_extendedprice"), "p"), *exact.partial_sums(F.col("l_discount"), "q"))
    return out.select("l_linestatus", exact.settled("p").alias("total"), exact.settled("q").alias("discounts"))


@query(f"SELECT l_returnflag, {_DEC.format('l_extendedprice')} AS total FROM lineitem GROUP BY l_returnflag")
def agg_exact_sum_slow_path(spark, d):
    return exact.slow_sums(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("""
WITH s AS (SELECT l_returnflag, CAST(sum(CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(38, 2)) * 100) AS HUGEINT) AS cents, CAST(count(*) AS HUGEINT) AS n FROM lineitem GROUP BY l_returnflag),
q AS (SELECT l_returnflag, 20 - length(CAST(cents // (100 * n) AS VARCHAR)) AS places, cents, n FROM s),
r AS (SELECT l_returnflag, places, CAST((2 * cents * CAST(pow(10, places - 2) AS HUGEINT) + n) // (2 * n) AS VARCHAR) AS digits FROM q)
SELECT l_returnflag, regexp_replace(left(digits, length(digits) - places) || '.' || right(digits, places), '\\.?0+$', '') AS mean FROM r""")
def agg_exact_avg(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*exact.partial_sums(F.col("l_extendedprice"), "p"))
    return out.select("l_returnflag", exact.average(exact.settled("p"), F.col("p__n")).alias("mean"))


@query(_I + "SELECT team, min(score) AS least, max(score) AS most FROM items GROUP BY team")
def agg_min_max_number(spark, d):
    return _agg(items(spark, d), Spec(group_by=(Key("team"),), metrics=(Metric("min", "score"), Metric("max", "score"))), team="team__val", least="score_min", most="score_max")


@query(_I + "SELECT active_kind, active, min(team) AS least, max(team) AS most FROM items GROUP BY ALL")
def agg_min_max_string(spark, d):
    return _agg(items(spark, d), Spec(group_by=(Key("active"),), metrics=(Metric("min", "team"), Metric("max", "team"))), active_kind="active__kind", active="active__val", least="team_min", most="team_max")


@query(_I + "SELECT team, regexp_replace(strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z' AS first_at, regexp_replace(strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z' AS last_at FROM items GROUP BY team")
def agg_min_max_instant(spark, d):
    return _agg(items(spark, d), Spec(group_by=(Key("team"),), metrics=(Metric("min", "at"), Metric("max", "at"))), team="team__val", first_at="at_min", last_at="at_max")


@query(_I + "SELECT team, count(*) FILTER (score_kind = 'number') AS numbers, count(*) FILTER (score_kind = 'null') AS nulls, 0::BIGINT AS missing FROM items GROUP BY team")
def agg_value_counters(spark, d):
    return _agg(items(spark, d), Spec(group_by=(Key("team"),), metrics=(Metric("max", "score"),)), team="team__val", numbers="score_values", nulls="score_nulls", missing="score_missing")


def _bucket_sql(relation, unit, zone, ts="ts"):
    local = f"(ts AT TIME ZONE 'UTC') AT TIME ZONE '{zone}'"
    # An hour's start has its members' own offset; a longer bucket's is the zone's at its start.
    start = f"date_trunc('hour', {local}) - ({local} - ts)" if unit == "hour" else f"(date_trunc('{unit}', {local}) AT TIME ZONE '{zone}') AT TIME ZONE 'UTC'"
    again = f"(start_ AT TIME ZONE 'UTC') AT TIME ZONE '{zone}'"
    off = f"CAST(epoch({again}) - epoch(start_) AS BIGINT)"
    shown = f"strftime({again}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {off} < 0 THEN '-' ELSE '+' END || lpad(CAST(abs({off}) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs({off}) // 60 % 60 AS VARCHAR), 2, '0')"
    return f"SELECT strftime(start_, '%Y-%m-%dT%H:%M:%SZ') AS start, {shown} AS local, n FROM (SELECT {start} AS start_, count(*) AS n FROM (SELECT {ts} AS ts FROM {relation}) GROUP BY 1)"


def _bucketed(df, unit, zone):
    return _agg(df, Spec(group_by=(Key("at", unit, zone),), max_groups=1000), start="at__val", local="at__local", n="n")


@query(_bucket_sql("events", "hour", "America/New_York"))
def bucket_hour_ny(spark, d):
    return _bucketed(items(spark, d), "hour", "America/New_York")


@query(_bucket_sql("events", "day", "Europe/Berlin"))
def bucket_day_berlin(spark, d):
    return _bucketed(items(spark, d), "day", "Europe/Berlin")


@query(_bucket_sql("lineitem", "week", "Australia/Lord_Howe", "l_shipdate"))
def bucket_week_lord_howe(spark, d):
    return _bucketed(items_big(spark, d), "week", "Australia/Lord_Howe")


@query(_bucket_sql("lineitem", "month", "America/New_York", "l_shipdate"))
def bucket_month_ny(spark, d):
    return _bucketed(items_big(spark, d), "month", "America/New_York")


@query(_bucket_sql("lineitem", "quarter", "UTC", "l_shipdate"))
def bucket_quarter_utc(spark, d):
    return _bucketed(items_big(spark, d), "quarter", "UTC")


@query(_bucket_sql("lineitem", "year", "UTC", "l_shipdate"))
def bucket_year_utc(spark, d):
    return _bucketed(items_big(spark, d), "year", "UTC")


def _documents(spark, d):
    """Items as JSON text: score null every 11th, active left out every 13th."""
    e = table(spark, d, "events")
    score = F.when(F.col("event_id") % 11 == 0, F.lit("null")).otherwise(F.col("value").cast("string"))
    active = F.when(F.col("event_id") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit(',"active":'), (F.col("event_id") % 2 == 0).cast("string")))
    text = F.concat(F.lit('{"team":"'), "event_type", F.lit('","score":'), score, active, F.lit("}"))
    return e.select(F.format_string("rec_%08d", "event_id").alias("record_id"), text.alias("canonical_data"))


@query(_I + "SELECT record_id, team, score_kind, score, active_kind, active, 'missing' AS at_kind FROM items")
def json_projection(spark, d):
    p = project(_documents(spark, d), ITEMS)
    return p.select("record_id", F.col("team__val").alias("team"), F.col("score__kind").alias("score_kind"), F.col("score__val").alias("score"), F.col("active__kind").alias("active_kind"), F.col("active__val").alias("active"), F.col("at__kind").alias("at_kind"))


@query(_I + """SELECT record_id, 'score' AS field, CASE WHEN n % 1000 = 1 THEN 'missing' WHEN score_kind = 'null' THEN 'kind' ELSE 'value' END AS difference
FROM items WHERE n % 1000 = 1 OR (n % 100 = 2 AND NOT (score_kind = 'number' AND score + 1 = score))
UNION ALL SELECT record_id, 'active', 'missing' FROM items WHERE n % 1000 = 1""")
def index_drift(spark, d):
    expected = items(spark, d)
    off = F.col("n") % 100 == 2
    actual = expected.filter("n % 1000 <> 1").withColumn("score__val", F.when(off, F.coalesce(F.col("score__val"), F.lit(0.0)) + 1).otherwise(F.col("score__val"))).withColumn("score__kind", F.when(off, "number").otherwise(F.col("score__kind")))
    return drift(expected, actual, ["score", "active"]).select("record_id", "field", "difference")
