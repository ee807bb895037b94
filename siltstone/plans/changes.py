"""Queries: the change log, mutations, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import access, evidence, facts, history, jobs, ledger, mutate, schemas, space_export
from siltstone.operators.aggregate import merged as merged_groups
from siltstone.plans.inputs import LOG_SQL, change_log, scratch, table
from siltstone.plans.registry import query
from siltstone.sources import feed_source
from siltstone.streaming import feeds, folds
from siltstone.types import CollectionDefinition, Field

_L = f"WITH {LOG_SQL} "
_AT = 5000


@query(_L + f"SELECT record_id, revision, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY revision DESC) AS r FROM log WHERE position <= {_AT}) WHERE r = 1 AND op <> 'delete'")
def asof_records(spark, d):
    return history.as_of(change_log(spark, d), _AT, ["event_type", "value"])


@query(_L + "SELECT position, record_id, op FROM log WHERE position > 1234 ORDER BY position LIMIT 100")
def feed_page(spark, d):
    return history.feed(change_log(spark, d).select("position", "record_id", "op"), 1234)


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) + 10 AS position FROM orders")
def event_publication(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderpriority").alias("collection_id"), F.col("o_orderdate").alias("committed_at"), F.col("o_orderkey").alias("event_id"))
    return history.published(rows, 10, scratch(spark, "published")).select("o_orderkey", "o_orderpriority", F.col("position").cast("long").alias("position"))


@query(_L + f"SELECT max(position) AS head, count(*) FILTER (position > {_AT}) AS later, CASE WHEN count(*) FILTER (position > {_AT}) = 0 THEN 'exact' ELSE 'stale' END AS freshness FROM log")
def freshness_state(spark, d):
    return history.freshness(change_log(spark, d), _AT, 1)


def _lines(spark, d):
    """Records as of the log's end; their notes differ in length, and deleted ones have no line."""
    last = history.as_of(change_log(spark, d), 10**12, ["event_type", "position"], dead=True)
    data = F.concat(F.lit('{"event":"'), "event_type", F.lit('","note":"'), F.repeat(F.lit("n"), (F.col("position") % 61).cast("int")), F.lit('"}'))
    return history.export_lines(last, F.when(F.col("op") != "delete", data))


# Pages by the contract: one begins where the last one ended and takes rows as long as it has no more than 40 and 3,400 bytes.
_LINES = (
    f"WITH RECURSIVE {LOG_SQL}"
    + """, last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY revision DESC) = 1),
lines AS MATERIALIZED (
  SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS place,
    CASE WHEN op <> 'delete' THEN '{"id":"' || record_id || '","revision":' || revision || ',"data":{"event":"' || event_type || '","note":"' || repeat('n', position % 61) || '"}}' || chr(10) END AS line
  FROM last
), run AS MATERIALIZED (SELECT *, CAST(sum(coalesce(strlen(line), 0)) OVER (ORDER BY place) AS BIGINT) AS upto, CAST(coalesce(sum(coalesce(strlen(line), 0)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM lines),
steps AS MATERIALIZED (SELECT a.place, max(b.place) + 1 AS next FROM run a JOIN run b ON b.place >= a.place AND b.place < a.place + 40 AND b.upto - a.before <= 3400 GROUP BY a.place),
start AS (SELECT CAST(0 AS BIGINT) AS place WHERE EXISTS (SELECT 1 FROM run) UNION ALL SELECT onward.place FROM start JOIN steps ON steps.place = start.place JOIN steps onward ON onward.place = steps.next),
pages AS (
  SELECT min(record_id) AS first_id, count(*) AS rows, CAST(sum(strlen(line)) AS BIGINT) AS bytes, sha256(string_agg(line, '' ORDER BY record_id)) AS sha256
  FROM (SELECT start.place AS page, run.* FROM start JOIN steps USING (place) JOIN run ON run.place >= start.place AND run.place < next) WHERE line IS NOT NULL GROUP BY page
) """
)


def _pages(spark, d):
    return history.export_pages(_lines(spark, d), scratch(spark, "export"), max_rows=40, max_bytes=3400)


@query(_LINES + "SELECT * FROM pages")
def export_pages(spark, d):
    return _pages(spark, d).drop("body")


@query(_LINES + "SELECT count(*) AS pages, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes, sha256(string_agg(sha256, '' ORDER BY first_id)) AS digest FROM pages")
def export_manifest_digest(spark, d):
    pages = scratch(spark, "pages")
    _pages(spark, d).write.parquet(pages)
    return history.manifest(spark.read.parquet(pages))


@query(_L + f"""
, last AS (SELECT * FROM log WHERE position <= {_AT} AND record_id > 'user_000010' QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY revision DESC) = 1),
run AS (SELECT *, row_number() OVER (ORDER BY record_id) AS n, CASE WHEN op = 'delete' THEN 0 ELSE strlen('{{"event_type":"' || event_type || '"}}') END AS b FROM last),
cut AS (SELECT *, coalesce(sum(b) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM run)
SELECT record_id, revision, event_type, n AS position, true AS more, max(record_id) OVER () AS cursor FROM cut WHERE n <= 50 AND before < 700 QUALIFY op <> 'delete'""")
def asof_page(spark, d):
    """The page of live records at a position that follows user_000010: 50 records, and none after the first 700 bytes."""
    page = history.as_of_page(change_log(spark, d), _AT, ["event_type"], "user_000010", 50, 700)
    return page.select("record_id", "revision", "event_type", F.col("position").cast("long").alias("position"), "more", "cursor")


@query("SELECT l_returnflag, count(*) AS n, regexp_replace(CAST(sum(CAST(CAST(l_tax AS VARCHAR) AS DECIMAL(38, 6))) AS VARCHAR), '\\.?0+$', '') AS total, min(l_shipdate)::VARCHAR AS first_at FROM lineitem GROUP BY l_returnflag")
def agg_partial_merge(spark, d):
    """Partial groups per supplier, merged exactly."""
    part = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_tax").cast("decimal(28,6)")).alias("total"), F.min("l_shipdate").alias("first_at"))
    return merged_groups(part, ["l_returnflag"], counts=["n"], sums=["total"], least=["first_at"]).withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss"))


@query("""
WITH s AS (SELECT l_returnflag, CAST(sum(CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(38, 2)) * 100) AS HUGEINT) AS cents, CAST(count(*) AS HUGEINT) AS n, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag),
q AS (SELECT *, 20 - length(CAST(cents // (100 * n) AS VARCHAR)) AS places FROM s),
r AS (SELECT *, CAST((2 * cents * CAST(pow(10, places - 2) AS HUGEINT) + n) // (2 * n) AS VARCHAR) AS digits FROM q)
SELECT l_returnflag, CAST(n AS BIGINT) AS n, most, regexp_replace(left(digits, length(digits) - places) || '.' || right(digits, places), '\\.?0+$', '') AS mean FROM r""")
def agg_partial_merge_avg(spark, d):
    """Averages of merged partial groups: of the sums, not of the averages."""
    part = table(spark, d, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(28,2)")).alias("total"), F.max("l_quantity").alias("most"))
    return merged_groups(part, ["l_returnflag"], counts=["n"], sums=["total"], most=["most"], averages={"mean": ("total", "n")}).select("l_returnflag", "n", "most", "mean")


_OPS = "CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'replace' WHEN 'click' THEN 'patch' WHEN 'error' THEN 'delete' ELSE 'replace' END"


def _requests(spark, d):
    data = F.concat(F.lit('{"v":'), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("record_id"), F.col("event_id").alias("ordinal"), F.expr(_OPS).alias("operation"), data.alias("data"), data.alias("set"))


@query(f"""
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS record_id, event_id AS ordinal, {_OPS} AS operation FROM events),
c AS (SELECT record_id, min(ordinal) AS born FROM r WHERE operation = 'create' GROUP BY record_id),
x AS (SELECT r.record_id, min(ordinal) AS died FROM r JOIN c USING (record_id) WHERE operation = 'delete' AND ordinal > born GROUP BY r.record_id),
o AS (SELECT r.*, CASE WHEN born IS NULL OR ordinal < born THEN 'NOT_FOUND' WHEN operation = 'create' THEN CASE WHEN ordinal = born THEN 'ok' WHEN died IS NOT NULL AND ordinal > died THEN 'KEY_RESERVED' ELSE 'CONFLICT' END
  WHEN died IS NOT NULL AND ordinal > died THEN 'NOT_FOUND' ELSE 'ok' END AS outcome FROM r LEFT JOIN c USING (record_id) LEFT JOIN x USING (record_id))
SELECT record_id, ordinal, outcome, CASE WHEN outcome = 'ok' THEN count(*) FILTER (outcome = 'ok') OVER (PARTITION BY record_id ORDER BY ordinal) ELSE 0 END AS revision,
  CASE WHEN outcome = 'ok' AND operation <> 'delete' THEN '{{"v":' || ordinal || '}}' END AS canonical_data FROM o""")
def mutation_fold(spark, d):
    return mutate.fold(_requests(spark, d)).select("record_id", "ordinal", "outcome", F.coalesce("revision", F.lit(0).cast("long")).alias("revision"), "canonical_data")


@query("""
WITH r AS (SELECT *, user_id || '-' || event_id % 7 AS idempotency_key, row_number() OVER w AS n, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, event_id % 7 ORDER BY event_id))
SELECT event_id, CASE WHEN n = 1 THEN 'applied' WHEN event_type = f THEN 'replayed' ELSE 'IDEMPOTENCY_MISMATCH' END AS outcome FROM r""")
def receipt_replay(spark, d):
    keyed = table(spark, d, "events").withColumn("key", F.concat("user_id", F.lit("-"), F.col("event_id") % 7))
    return mutate.receipts(keyed, ["user_id", "key"], "event_type", "event_id").select("event_id", "outcome")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)
SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 THEN 'KEY_RESERVED' WHEN o_custkey % 10 = 4 THEN 'UNIQUE_CONFLICT' WHEN n = 1 THEN 'ok' ELSE 'UNIQUE_CONFLICT' END AS outcome FROM r""")
def unique_conflicts(spark, d):
    from siltstone.functions.canonical import unique_tuple

    orders = table(spark, d, "orders").withColumn("tuple", unique_tuple([("number", F.col("o_custkey")), ("string", F.col("o_orderpriority"))]))
    held = orders.filter("o_custkey % 10 IN (3, 4)").groupBy("tuple").agg(F.first(F.col("o_custkey") % 10 == 3).alias("tombstone"))
    return mutate.unique_outcomes(orders, "tuple", held, "o_orderkey").select("o_orderkey", "outcome")


@query("""
SELECT event_id, '{' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '"a":1' || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',' END END || CASE WHEN event_id % 5 = 0 THEN '' ELSE '"b":' || event_id END || '}' AS canonical_data FROM events""")
def patch_set_unset(spark, d):
    """Create {a:1,b:0}, then a patch that sets b and unsets a every third, b every fifth time."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("record_id"))
    n = F.col("record_id").cast("long")
    unset = F.filter(F.array(F.when(n % 3 == 0, "a"), F.when(n % 5 == 0, "b")), lambda x: x.isNotNull())
    first = e.select("record_id", F.lit(1).alias("ordinal"), F.lit("create").alias("operation"), F.lit('{"a":1,"b":0}').alias("data"), F.lit(None).cast("string").alias("set"), F.lit(None).cast("array<string>").alias("unset"))
    set_ = F.when(n % 5 == 0, "{}").otherwise(F.concat(F.lit('{"b":'), "record_id", F.lit("}")))
    then = e.select("record_id", F.lit(2).alias("ordinal"), F.lit("patch").alias("operation"), F.lit(None).cast("string").alias("data"), set_.alias("set"), unset.alias("unset"))
    return mutate.fold(first.unionByName(then)).filter("ordinal = 2").select(F.col("record_id").cast("long").alias("event_id"), "canonical_data")


@query("""
WITH s AS (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders)
SELECT o_orderkey, was, o_orderstatus FROM s WHERE was IS NOT NULL AND was <> o_orderstatus AND NOT (was = 'O' AND o_orderstatus IN ('P', 'F')) AND NOT (was = 'P' AND o_orderstatus = 'F')""")
def lifecycle_violations(spark, d):
    from pyspark.sql import Window

    was = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    allowed = F.concat("was", "o_orderstatus").isin("OP", "OF", "PF")
    return table(spark, d, "orders").withColumn("was", was).filter(F.col("was").isNotNull() & (F.col("was") != F.col("o_orderstatus")) & ~allowed).select("o_orderkey", "was", "o_orderstatus")


@query("""
WITH b AS (SELECT event_id // 20 AS batch, event_id AS ordinal, event_type || ':' || event_id AS item, event_type <> 'error' AS good FROM events)
SELECT batch, count(*) AS items, count(*) FILTER (good) AS succeeded, count(*) FILTER (NOT good) AS failed, sha256(string_agg(item, chr(10) ORDER BY ordinal)) AS digest, count(*) FILTER (NOT good) > 0 AS retry FROM b GROUP BY batch""")
def batch_status(spark, d):
    rows = table(spark, d, "events").select(F.expr("event_id div 20").alias("batch"), F.col("event_id").alias("ordinal"), F.concat("event_type", F.lit(":"), "event_id").alias("item"), "event_type")
    return mutate.batch_status(rows, "batch", F.col("event_type") != "error")


def _grants(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.when(F.col("n_nationkey") < 10, "k1").otherwise("k2").alias("credential"), F.col("n_nationkey").alias("collection_id"), F.array(F.lit("records.read"), F.lit("sources.read")).alias("capabilities"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey < 10")
def semi_join_grants(spark, d):
    open_ = evidence.readable(_grants(spark, d), "k1", "records.read")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(open_, F.col("c_nationkey") == F.col("collection_id"), "left_semi")


def _claims(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    claims = orders.select(F.col("o_orderkey").alias("claim_id"), "o_custkey", "o_orderstatus")
    cites = claims.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("claim_id", F.col("c_nationkey").alias("cited"))
    more = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).filter("l_linenumber = 1").select(F.col("l_orderkey").alias("claim_id"), F.col("s_nationkey").alias("cited"))
    return claims, cites.unionByName(more)


_HIDDEN = """
WITH cites AS (SELECT o_orderkey AS claim_id, c_nationkey AS cited FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT l_orderkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1) """


@query(_HIDDEN + "SELECT o_orderkey AS claim_id, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM cites WHERE claim_id = o_orderkey AND cited >= 10)")
def anti_join_claim_rule(spark, d):
    claims, cites = _claims(spark, d)
    return evidence.visible_claims(claims, cites, evidence.readable(_grants(spark, d), "k1", "sources.read")).select("claim_id", "o_orderstatus")


@query("""
WITH r AS (SELECT l_orderkey AS claim_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS revision, l_partkey, l_returnflag FROM lineitem)
SELECT claim_id, revision, l_partkey, l_returnflag FROM r QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY revision DESC) = 1""")
def claims_current(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    revisions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.row_number().over(by).cast("long").alias("revision"), "l_partkey", "l_returnflag")
    return evidence.current_claims(revisions)


@query("SELECT o_orderkey AS claim_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 AND o_orderstatus = 'F' ORDER BY 1 LIMIT 25")
def claims_citing(spark, d):
    claims, _ = _claims(spark, d)
    customers = table(spark, d, "customer").filter("c_nationkey = 7")
    return claims.filter("o_orderstatus = 'F'").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("claim_id").orderBy("claim_id").limit(25)


def _links(spark, d):
    policy = F.when(F.col("o_orderpriority").startswith("1"), "restrict").otherwise("detach")
    return table(spark, d, "orders").select(F.format_string("l%09d", "o_orderkey").alias("link_id"), policy.alias("policy"), F.concat(F.lit("o"), "o_orderkey").alias("from_id"), F.concat(F.lit("c"), "o_custkey").alias("to_id"))


@query("""
SELECT 'c' || c_custkey AS id, CASE WHEN bool_or(o_orderpriority LIKE '1%') THEN 'LINK_RESTRICTED' ELSE 'ok' END AS outcome, CASE WHEN bool_or(o_orderpriority LIKE '1%') THEN 0 ELSE count(o_orderkey) END AS detached
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 = 0 GROUP BY c_custkey""")
def links_detach_restrict(spark, d):
    gone = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return evidence.delete_endpoints(_links(spark, d), gone)[0]


@query("""
WITH e AS (SELECT o_orderkey, unnest(['o' || o_orderkey, 'c' || o_custkey]) AS id, o_orderpriority LIKE '1%' AS restrict FROM orders WHERE o_orderkey % 2 = 0 OR o_custkey % 3 = 0),
gone AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0),
held AS (SELECT DISTINCT id FROM e WHERE restrict),
first AS (SELECT o_orderkey, min(id) AS id FROM e WHERE NOT restrict AND id IN (SELECT id FROM gone) AND id NOT IN (SELECT id FROM held) GROUP BY o_orderkey)
SELECT id, CASE WHEN id IN (SELECT id FROM held) THEN 'LINK_RESTRICTED' ELSE 'ok' END AS outcome, (SELECT count(*) FROM first WHERE first.id = gone.id) AS detached FROM gone""")
def links_both_ends(spark, d):
    """Customers and orders deleted together: a link between two of them is counted once, for the first."""
    gone = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    gone = gone.unionByName(table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id")))
    return evidence.delete_endpoints(_links(spark, d), gone)[0]


@query("SELECT 'l' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS link_id, 'o' || o_orderkey AS from_id FROM orders WHERE o_custkey = 11 ORDER BY 1 LIMIT 50")
def links_of_endpoint(spark, d):
    return evidence.links_of(_links(spark, d), "c11").select("link_id", "from_id")


@query("SELECT 'l' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS link_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_nationkey < 10")
def links_visible(spark, d):
    ends = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.lit("record").alias("kind"), F.concat(F.lit("o"), "o_orderkey").alias("id"))
    ends = ends.unionByName(table(spark, d, "customer").filter("c_nationkey < 10").select(F.lit("record").alias("kind"), F.concat(F.lit("c"), "c_custkey").alias("id")))
    links = _links(spark, d).withColumn("from_kind", F.lit("record")).withColumn("to_kind", F.lit("record"))
    return evidence.visible_links(links, ends).select("link_id")


@query("SELECT o_custkey, o_orderkey, position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) WHERE position <= 3")
def lateral_topk_per_group(spark, d):
    return evidence.top_per_group(table(spark, d, "orders"), ["o_custkey"], 3, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", F.col("position").cast("long").alias("position"))


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS pair_turn FROM events)
SELECT event_id, pair_turn, row_number() OVER (PARTITION BY event_type ORDER BY pair_turn, user_id) AS space_turn FROM p""")
def fair_turns(spark, d):
    out = evidence.fair_turns(table(spark, d, "events"), scratch(spark, "turns"), "event_type", "user_id", "event_id")
    return out.select("event_id", F.col("pair_turn").cast("long").alias("pair_turn"), F.col("space_turn").cast("long").alias("space_turn"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def distinct_on_best(spark, d):
    return evidence.distinct_best(table(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_pairs(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()


@query("SELECT user_id, 1::BIGINT AS generation, max(event_id) AS revision FROM events GROUP BY user_id")
def outbox_heads(spark, d):
    log = table(spark, d, "events").select("user_id", F.lit(1).cast("long").alias("generation"), F.col("event_id").alias("revision"))
    return feeds.heads(log, ["user_id"])


@query("SELECT CASE WHEN event_id % 17 = 0 THEN 'delivered' WHEN event_id % 10 >= 8 THEN 'dead-letter' WHEN event_id % 10 > 0 THEN 'degraded' ELSE 'pending' END AS state, count(*) AS n, max(CAST(least(5 * pow(2, greatest(event_id % 10 - 1, 0)), 3600) AS BIGINT)) AS longest FROM events GROUP BY 1")
def outbox_status(spark, d):
    failures = F.col("event_id") % 10
    out = table(spark, d, "events").select(feeds.delivery_state(failures, F.col("event_id") % 17 == 0).alias("state"), feeds.backoff(failures).alias("wait"))
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.max("wait").alias("longest"))


@query("SELECT event_id, event_id < max(event_id) OVER (PARTITION BY user_id) AS superseded FROM events")
def outbox_superseded(spark, d):
    log = table(spark, d, "events").select("event_id", "user_id", F.col("event_id").alias("revision"))
    return feeds.superseded(log, ["user_id"]).select("event_id", "superseded")


@query("""
SELECT o_orderkey AS request_id, CASE WHEN c_custkey IS NULL OR o_custkey % 100 = 99 THEN 'NOT_FOUND' WHEN o_orderkey % 7 = 0 THEN 'FORBIDDEN' WHEN c_nationkey = 3 THEN 'SPACE_UNAVAILABLE' WHEN o_custkey % 100 = 50 THEN 'NOT_FOUND'
  WHEN o_orderstatus = 'P' THEN 'FORBIDDEN' WHEN o_orderstatus = 'F' AND (c_nationkey = 4 OR o_custkey % 100 = 10) THEN 'SPACE_UNAVAILABLE' ELSE 'ok' END AS outcome
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def scope_checks(spark, d):
    """Orders as requests: spaces are nations, collections customers; nation 3 is suspended, nation 4 read-only."""
    customer = table(spark, d, "customer")
    asked = table(spark, d, "orders").join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("space_id")), "o_custkey", "left")
    requests = asked.select(
        F.col("o_orderkey").alias("request_id"), "space_id", F.col("o_custkey").alias("collection_id"), F.lit("k1").alias("credential"), F.when(F.col("o_orderstatus") == "P", "admin").otherwise("records").alias("capability"),
        F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(2).alias("policy"), (F.col("o_orderstatus") == "F").alias("write"),
    )
    spaces = table(spark, d, "nation").select(F.col("n_nationkey").alias("space_id"), F.when(F.col("n_nationkey") == 3, "suspended").when(F.col("n_nationkey") == 4, "readOnly").otherwise("active").alias("lifecycle"), F.lit(2).alias("policy"))
    last = F.col("c_custkey") % 100
    collections = customer.filter(last != 99).select(F.col("c_nationkey").alias("space_id"), F.col("c_custkey").alias("collection_id"), F.when(last == 50, "deleted").when(last == 10, "readOnly").otherwise("active").alias("lifecycle"))
    grants = customer.select(F.col("c_nationkey").alias("space_id"), F.col("c_custkey").alias("collection_id"), F.lit("k1").alias("credential"), F.array(F.lit("records")).alias("capabilities"))
    return access.scope_outcomes(requests, spaces, collections, grants).select("request_id", "outcome")


@query("SELECT n_name AS collection_id, CASE WHEN n_nationkey % 2 = 0 THEN 'name' ELSE '' END AS ready, CASE WHEN n_nationkey % 2 = 0 THEN 'region' ELSE 'name,region' END AS pending FROM nation WHERE n_nationkey < 20 AND n_nationkey <> 5 AND n_name > 'C' ORDER BY n_name LIMIT 9")
def collection_discovery(spark, d):
    n = table(spark, d, "nation")
    collections = n.select(F.col("n_name").alias("collection_id"), F.when(F.col("n_nationkey") == 5, "deleted").otherwise("active").alias("lifecycle"))
    fields = n.select(F.col("n_name").alias("collection_id"), F.explode(F.array(F.struct(F.lit("name").alias("field"), (F.col("n_nationkey") % 2 == 0).alias("ready")), F.struct(F.lit("region").alias("field"), F.lit(False).alias("ready")))).alias("x")).select("collection_id", "x.*")
    out = access.discover(collections, fields, n.filter("n_nationkey < 20").select(F.col("n_name").alias("collection_id")), "C")
    return out.select("collection_id", F.array_join("ready", ",").alias("ready"), F.array_join("pending", ",").alias("pending"))


@query("SELECT l_returnflag, count(*) AS n, max(l_extendedprice) AS most, CAST(sum(CAST(CAST(l_quantity AS VARCHAR) AS DECIMAL(38, 2))) AS VARCHAR) AS quantity FROM lineitem GROUP BY l_returnflag")
def snapshot_job(spark, d):
    """An aggregate job over the lines: partial groups by cut of the orders in one Spark job, then merged."""
    job = jobs.Job(scratch(spark, "job"), 0, max_records=10**12)
    partial = lambda df, cut: df.groupBy(*cut, "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("most"), F.sum(F.col("l_quantity").cast("decimal(28,2)")).alias("q"))
    done = jobs.run(job, table(spark, d, "lineitem"), "l_orderkey", partial)
    return jobs.merged(spark, done, lambda df: df.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("q").cast("string").alias("quantity")))


@query("SELECT p_partkey AS source_id, p_partkey % 9 = 0 OR p_partkey % 4 = 1 AS tombstone, p_partkey % 4 <> 1 AS has_bytes FROM part")
def source_erasure(spark, d):
    """Sources after a quarter of them is deleted: tombstones, and whose bytes are still there."""
    sources = table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), (F.col("p_partkey") % 9 == 0).alias("tombstone"))
    marked, left = evidence.erased(sources, sources.select("source_id"), sources.filter("source_id % 4 = 1").select("source_id"))
    return marked.join(left.withColumn("has_bytes", F.lit(True)), "source_id", "left").select("source_id", "tombstone", F.coalesce("has_bytes", F.lit(False)).alias("has_bytes"))


@query("SELECT p_partkey AS source_id FROM part WHERE p_partkey % 9 = 0")
def orphan_contents(spark, d):
    sources = table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), (F.col("p_partkey") % 9 == 0).alias("tombstone"))
    return evidence.orphans(sources.select("source_id"), sources)


@query("SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey <> 7")
def space_purge(spark, d):
    """What is left of two tables after a space (a nation) is purged."""
    tables = {"customer": table(spark, d, "customer").withColumn("space_id", F.col("c_nationkey")), "supplier": table(spark, d, "supplier").withColumn("space_id", F.col("s_nationkey"))}
    a, b = (rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in evidence.purged(tables, 7).items())
    return a.unionByName(b)


@query(_HIDDEN + "SELECT o_orderkey AS claim_id, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM cites WHERE claim_id = o_orderkey AND (cited >= 10 OR cited = 4))")
def claim_rule_live_collections(spark, d):
    """Claims whose every cited collection is readable and live; collection 4 is deleted."""
    claims, cites = _claims(spark, d)
    live = table(spark, d, "nation").filter("n_nationkey <> 4").select(F.col("n_nationkey").alias("collection_id"))
    return evidence.visible_claims(claims, cites, evidence.readable(_grants(spark, d), "k1", "sources.read"), live).select("claim_id", "o_orderstatus")


@query(_HIDDEN + """SELECT 'l' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS link_id FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_nationkey < 10 AND NOT EXISTS (SELECT 1 FROM cites WHERE claim_id = o_orderkey AND cited >= 10)""")
def links_of_claims_visible(spark, d):
    """Links from claims to records: a claim that cites what cannot be read hides its links."""
    claims, cites = _claims(spark, d)
    open_ = evidence.readable(_grants(spark, d), "k1", "sources.read")
    customer = table(spark, d, "customer")
    ends = claims.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("claim").alias("kind"), F.concat(F.lit("o"), "claim_id").alias("id"), F.col("c_nationkey").alias("collection_id"))
    ends = ends.unionByName(customer.select(F.lit("record").alias("kind"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").alias("collection_id")))
    hidden = evidence.hidden_claims(cites, open_).select(F.concat(F.lit("o"), "claim_id").alias("claim_id"))
    links = _links(spark, d).withColumn("from_kind", F.lit("claim")).withColumn("to_kind", F.lit("record"))
    return evidence.visible_links(links, evidence.readable_endpoints(ends, open_, hidden)).select("link_id")


@query("SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS receipts FROM events GROUP BY user_id")
def facts_appended(spark, d):
    """Facts appended in two batches, the second one three times: what is committed stays, and a repeat, of other rows even, adds nothing."""
    rows = table(spark, d, "events")
    store = facts.Store(scratch(spark, "facts"))
    tables = lambda df: {"events": df.select("user_id", "event_id"), "receipts": df.filter("event_type = 'purchase'").select("user_id", "event_id")}
    store.append(tables(rows.filter("event_id % 2 = 0")), 1)
    for again in (rows.filter("event_id % 2 = 1"), rows.filter("event_id % 2 = 1"), rows):
        store.append(tables(again), 2)
    count = lambda name: store.read(spark, name).groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    return count("events").join(count("receipts"), "user_id", "left").select("user_id", "events", F.coalesce("receipts", F.lit(0)).alias("receipts"))


@query("SELECT o_orderkey, was, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders) WHERE (was IS NULL AND o_orderstatus <> 'O') OR (was = 'O' AND o_orderstatus NOT IN ('O', 'P', 'F')) OR (was = 'P' AND o_orderstatus NOT IN ('P', 'F')) OR (was = 'F' AND o_orderstatus <> 'F')")
def lifecycle_moves_refused(spark, d):
    """Orders of a customer as states of one record, by the lifecycle check itself: what is no declared move."""
    from pyspark.sql import Window

    was = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    definition = CollectionDefinition("orders", (Field("status", "string"),), lifecycle="status", initial=("O",), transitions={"O": ("P", "F"), "P": ("F",)})
    rows = table(spark, d, "orders").withColumn("was", was)
    return rows.filter(~mutate.move_allowed(F.col("was"), F.col("o_orderstatus"), definition)).select("o_orderkey", "was", "o_orderstatus")


@query("""
WITH b AS (SELECT event_id // 20 AS batch, event_id AS ordinal, event_type <> 'error' AS good, event_id % 20 >= 15 AS late, event_id // 20 % 10 = 3 AS gone FROM events)
SELECT batch, count(*) FILTER (NOT late AND good) AS succeeded, count(*) FILTER (NOT late AND NOT good) AS failed, count(*) FILTER (late AND NOT gone) AS pending, count(*) FILTER (late AND gone) AS cancelled,
  count(*) FILTER (late AND NOT gone OR NOT late AND NOT good AND NOT gone) AS todo FROM b GROUP BY batch""")
def batch_resume(spark, d):
    """Batches that stopped at their fifteenth item, some of them cancelled: what a resumption with retries has to do."""
    items = table(spark, d, "events").select(F.expr("event_id div 20").alias("batch"), F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 20 < 15, F.when(F.col("event_type") == "error", "failed").otherwise("succeeded")).alias("outcome"))
    gone = items.filter("batch % 10 = 3").select("batch").distinct()
    status = mutate.batch_items(items, gone)
    todo = mutate.batch_todo(status, retry_failed=True).groupBy("batch").agg(F.count(F.lit(1)).alias("todo"))
    counts = status.groupBy("batch").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("succeeded", "failed", "pending", "cancelled")])
    return counts.join(todo, "batch", "left").select("batch", "succeeded", "failed", "pending", "cancelled", F.coalesce("todo", F.lit(0)).alias("todo"))


@query("SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'delivered' WHEN event_id % 10 = 9 THEN 'cancelled' WHEN event_id % 10 = 8 THEN 'pending' WHEN event_id % 10 > 0 THEN 'degraded' ELSE 'pending' END AS state FROM events")
def outbox_repair(spark, d):
    """An operator's retry of what failed eight times and cancellation of what failed nine."""
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 10).alias("failures"), (F.col("event_id") % 17 == 0).alias("delivered"))
    retry, cancel = (rows.filter(F.col("failures") == n).select("event_id") for n in (8, 9))
    return feeds.repaired(rows, ["event_id"], retry, cancel).select("event_id", "state")


@query("SELECT CASE WHEN event_id % 17 = 0 THEN 'delivered' WHEN event_id % 10 >= 8 THEN 'dead-letter' WHEN event_id % 10 > 0 THEN 'degraded' ELSE 'pending' END AS state, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest, max(10001 - event_id) AS lag FROM events GROUP BY 1")
def outbox_lag(spark, d):
    """Counts, the oldest and the greatest distance to the log's head by delivery state."""
    rows = table(spark, d, "events").select((F.col("event_id") % 10).alias("failures"), (F.col("event_id") % 17 == 0).alias("delivered"), "ts", F.col("event_id").alias("position"))
    return feeds.status(rows, 10_001).select("state", "n", F.date_format("oldest", "yyyy-MM-dd HH:mm:ss").alias("oldest"), "lag")


@query("""
WITH r AS (SELECT o_custkey AS claim_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision, o_orderpriority FROM orders)
SELECT claim_id, revision, CASE WHEN o_orderkey % 3 = 0 THEN 'unreviewed' ELSE o_orderpriority END AS status FROM r QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY revision DESC) = 1""")
def claims_reviewed(spark, d):
    """Customers as claims, their orders as revisions: the status of the last review of the current revision, of two."""
    from pyspark.sql import Window

    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    revisions = table(spark, d, "orders").select(F.col("o_custkey").alias("claim_id"), F.row_number().over(by).cast("long").alias("revision"), "o_orderkey", "o_orderpriority")
    seen = revisions.filter("o_orderkey % 3 <> 0")
    reviews = seen.select("claim_id", "revision", F.lit("old").alias("status"), F.lit(1).alias("reviewed_at")).unionByName(seen.select("claim_id", "revision", F.col("o_orderpriority").alias("status"), F.lit(2).alias("reviewed_at")))
    return evidence.reviewed(evidence.current_claims(revisions), reviews).select("claim_id", "revision", "status")


@query("""
SELECT event_id, CASE WHEN event_id % 10 IN (0, 1, 2, 3) THEN 'SCHEMA_INVALID' ELSE 'ok' END AS outcome FROM events""")
def schema_checks(spark, d):
    """A record per event, created under a definition: text for a number, a required field missing, a value that is not listed, a field not declared."""
    definition = CollectionDefinition("checked", (Field("v", "number", required=True), Field("kind", "string", enum=("click", "error", "purchase", "signup", "view"))))
    n, kind = F.col("event_id") % 10, F.concat(F.lit(',"kind":"'), "event_type", F.lit('"}'))
    v = F.concat(F.lit('{"v":'), "event_id")
    data = (
        F.when(n == 0, F.concat(F.lit('{"v":"x"'), kind)).when(n == 1, F.concat(F.lit('{"kind":"'), "event_type", F.lit('"}'))).when(n == 2, F.concat(v, F.lit(',"kind":"other"}'))).when(n == 3, F.concat(v, F.lit(',"more":1}'))).otherwise(F.concat(v, kind))
    )
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("record_id"), F.lit(1).alias("ordinal"), F.lit("create").alias("operation"), data.alias("data"))
    return mutate.fold(rows, definition).select(F.col("record_id").cast("long").alias("event_id"), "outcome")


_ORDER = {
    "$schema": schemas.DIALECT, "type": "object", "additionalProperties": False, "required": ["key", "status", "customer", "lines"],
    "properties": {
        "key": {"type": "integer", "minimum": 0}, "status": {"type": "string", "enum": ["F", "O", "P"]}, "placed": {"type": "string", "format": "date-time"}, "note": {"type": ["string", "null"], "maxLength": 12},
        "customer": {"type": "object", "additionalProperties": False, "required": ["key"], "properties": {"key": {"type": "integer"}, "segment": {"type": "string"}}},
        "lines": {"type": "array", "maxItems": 5, "items": {
            "type": "object", "additionalProperties": False, "required": ["number", "quantity"],
            "properties": {"number": {"type": "integer"}, "quantity": {"type": "number", "maximum": 49}, "flags": {"type": "array", "items": {"type": "string"}, "minItems": 1}},
        }},
    },
}


def _order_documents(spark, d):
    """Orders as records with a nested customer and an array of lines; some have faults of their own, others their figures are faults."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 20
    line = F.concat(F.lit('{"number":'), "l_linenumber", F.lit(',"quantity":'), "l_quantity", F.lit(',"flags":["'), "l_returnflag", F.lit('"]}'))
    # An order has few lines.
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("lines"))
    customer = F.when(k == 1, F.lit('{"segment":"A"}')).when(k == 2, F.concat(F.lit('{"key":'), "o_custkey", F.lit(',"name":"x"}'))).when(k == 3, F.lit("null")).otherwise(F.concat(F.lit('{"key":'), "o_custkey", F.lit("}")))
    note = F.when(k == 4, F.lit('"more than a dozen"')).when(k == 5, F.lit("7")).when(k == 6, F.lit("null")).otherwise(F.lit('"n"'))
    placed = F.when(k == 7, F.lit("2024-02-30T00:00:00Z")).when(k == 8, F.lit("2016-12-31T23:59:60.5Z")).otherwise(F.lit("2024-01-01T00:00:00Z"))
    body = F.concat(F.lit('{"key":'), "o_orderkey", F.lit(',"status":"'), "o_orderstatus", F.lit('","placed":"'), placed, F.lit('","note":'), note, F.lit(',"customer":'), customer, F.lit(',"lines":['), F.coalesce("lines", F.lit("")), F.lit("]}"))
    return o.join(lines, "o_orderkey", "left").select("o_orderkey", body.alias("document"))


@query("""
WITH l AS (SELECT l_orderkey, '{"number":' || l_linenumber || ',"quantity":' || l_quantity || ',"flags":["' || l_returnflag || '"]}' AS line, l_quantity > 49 AS much FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY line) - 1 AS i FROM l),
g AS (SELECT l_orderkey, count(*) AS lines, min(i) FILTER (much) AS much FROM n GROUP BY l_orderkey),
f AS (SELECT o_orderkey, CASE o_orderkey % 20 WHEN 7 THEN '/placed' WHEN 4 THEN '/note' WHEN 5 THEN '/note' WHEN 1 THEN '/customer/key' WHEN 2 THEN '/customer/name' WHEN 3 THEN '/customer'
  ELSE CASE WHEN lines > 5 THEN '/lines' WHEN much IS NOT NULL THEN '/lines/' || much || '/quantity' END END AS fault FROM orders LEFT JOIN g ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN fault IS NOT NULL THEN 'SCHEMA_INVALID' END AS code, fault FROM f""")
def schema_nested(spark, d):
    """Nested records checked under a schema tree: whether each is valid, and where its first fault lies."""
    return schemas.checked(_order_documents(spark, d), "document", _ORDER).select("o_orderkey", "code", "fault")


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS lines, bool_or(l_quantity > 49) AS much FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 20 IN (1, 2, 3, 4, 5, 7) OR lines > 5 OR much THEN 'SCHEMA_INVALID' ELSE 'ok' END AS outcome FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def schema_nested_created(spark, d):
    """The same records created in a collection whose definition has the tree."""
    definition = schemas.definition("orders", _ORDER, filterable=("key", "status"), lifecycle="status", initial=("F", "O", "P"))
    rows = _order_documents(spark, d).select(F.col("o_orderkey").cast("string").alias("record_id"), F.lit(1).alias("ordinal"), F.lit("create").alias("operation"), F.col("document").alias("data"))
    return mutate.fold(rows, definition).select(F.col("record_id").cast("long").alias("o_orderkey"), "outcome")


@query(f"""
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS record_id, event_id AS ordinal, {_OPS} AS operation, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events),
c AS (SELECT record_id, min(ordinal) AS born FROM r WHERE operation = 'create' GROUP BY record_id),
x AS (SELECT r.record_id, min(ordinal) AS died FROM r JOIN c USING (record_id) WHERE operation = 'delete' AND ordinal > born GROUP BY r.record_id),
o AS (SELECT r.*, CASE WHEN born IS NULL OR ordinal < born THEN 'NOT_FOUND' WHEN operation = 'create' THEN CASE WHEN ordinal = born THEN 'ok' WHEN died IS NOT NULL AND ordinal > died THEN 'KEY_RESERVED' ELSE 'CONFLICT' END
  WHEN died IS NOT NULL AND ordinal > died THEN 'NOT_FOUND' ELSE 'ok' END AS outcome FROM r LEFT JOIN c USING (record_id) LEFT JOIN x USING (record_id))
SELECT record_id, sequence, outcome, CASE WHEN outcome = 'ok' THEN count(*) FILTER (outcome = 'ok') OVER (PARTITION BY record_id ORDER BY ordinal) END AS revision,
  CASE WHEN outcome = 'ok' AND operation <> 'delete' THEN '{{"v":' || ordinal || '}}' END AS canonical_data FROM o""")
def stream_fold(spark, d):
    """The fold as a stream: files in any order, a third of the requests twice, and a restart from the checkpoint half way."""
    base = scratch(spark, "stream")
    rows = folds.sequenced(_requests(spark, d))
    rows.repartition(8, "sequence").write.parquet(f"{base}/made")
    made = spark.read.schema(folds.REQUEST).parquet(f"{base}/made")
    store = facts.Store(f"{base}/store")
    for part in (made.filter("sequence % 3 > 0"), made.filter("sequence % 3 < 2")):
        part.repartition(4).write.mode("append").parquet(f"{base}/requests")
        folds.run(folds.folded(folds.requests_from(spark, f"{base}/requests", 3)), store, "outcomes", f"{base}/checkpoint").awaitTermination()
    return store.read(spark, "outcomes").select("record_id", "sequence", "outcome", "revision", "canonical_data")


@query("""
WITH r AS (SELECT o_orderkey AS ordinal, o_orderkey % 3 AS batch, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || '-' || o_orderkey % 5 END AS identity, o_orderpriority AS digest,
  CASE WHEN o_orderkey % 2 = 1 THEN o_custkey || '/' || o_orderstatus END AS tuple, o_custkey % 7 = 0 AS gone FROM orders),
i AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY batch, ordinal) AS n, first_value(digest) OVER (PARTITION BY identity ORDER BY batch, ordinal) AS f FROM r WHERE identity IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY tuple ORDER BY batch, ordinal) AS n, first_value(batch) OVER (PARTITION BY tuple ORDER BY batch, ordinal) AS b FROM r WHERE tuple IS NOT NULL)
SELECT ordinal, CASE WHEN n = 1 THEN 'applied' WHEN digest = f THEN 'replayed' ELSE 'IDEMPOTENCY_MISMATCH' END AS outcome FROM i
UNION ALL SELECT ordinal, CASE WHEN n = 1 THEN 'applied' WHEN gone AND b < 2 AND batch = 2 THEN 'KEY_RESERVED' ELSE 'UNIQUE_CONFLICT' END FROM t""")
def ledger_batches(spark, d):
    """Three batches against stored uniques and receipts, the second one twice; before the third some holders are deleted."""
    o = table(spark, d, "orders")
    requests = o.select(
        F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") % 3).alias("batch"), F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_custkey", F.lit("-"), F.col("o_orderkey") % 5)).alias("identity"),
        F.col("o_orderpriority").alias("digest"), F.when(F.col("o_orderkey") % 2 == 1, F.concat("o_custkey", F.lit("/"), "o_orderstatus")).alias("tuple"), F.concat(F.lit("r"), "o_orderkey").alias("record_id"),
    )
    book, outs = ledger.Ledger(scratch(spark, "ledger")), {}
    for batch in (0, 1, 1, 2):
        gone = book.table(spark, "keys").filter(F.split("tuple", "/")[0].cast("long") % 7 == 0) if batch == 2 else None
        outs[batch] = book.apply(requests.filter(F.col("batch") == batch), batch, 1_000_000 + batch, gone)
    return outs[0].unionByName(outs[1]).unionByName(outs[2]).select("ordinal", "outcome")


@query(_L + "SELECT position, record_id, revision, op FROM log WHERE position > 1234")
def feed_source_resumed(spark, d):
    """The log as a source of its own, streamed from a cursor: stopped half way, and late files published before the restart."""
    base = scratch(spark, "feed")
    log = change_log(spark, d).select("position", "record_id", "revision", "op")
    log.filter("position <= 4000").repartitionByRange(3, "position").write.parquet(f"{base}/log")
    feed_source.register(spark)
    store = facts.Store(f"{base}/store")
    for late in (None, log.filter("position > 4000")):
        if late is not None:
            late.repartitionByRange(4, "position").write.mode("append").parquet(f"{base}/log")
        stream = spark.readStream.format("siltstone_feed").schema(log.schema).options(path=f"{base}/log", cursor=1234).load()
        folds.run(stream, store, "events", f"{base}/checkpoint").awaitTermination()
    return store.read(spark, "events")


def _space_lines(spark, d):
    """Lines of four sections: nations as permissions, orders as claims, users' records, and the whole log as revisions."""
    log = change_log(spark, d)
    line = lambda *columns: F.concat(F.to_json(F.struct(*columns)), F.lit("\n"))
    of = lambda name, rows, key, *columns: rows.select(F.lit(name).alias("section"), key.alias("key"), line(*columns).alias("line"))
    out = of("permissions", table(spark, d, "nation"), F.format_string("%06d", "n_nationkey"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    out = out.unionByName(of("claims", table(spark, d, "orders"), F.format_string("%012d", "o_orderkey"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.repeat(F.lit("s"), (F.col("o_custkey") % 9).cast("int")).alias("statement")))
    out = out.unionByName(of("records", history.as_of(log, 10**12, ["event_type"]), F.col("record_id"), F.col("record_id").alias("id"), "revision", F.col("event_type").alias("data")))
    return out.unionByName(of("revisions", log, F.format_string("%012d", "position"), "position", F.col("record_id").alias("id"), "op"))


@query(_L + """, lines AS (
  SELECT 'permissions' AS section, lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS key, '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' || chr(10) AS line FROM nation
  UNION ALL SELECT 'claims', lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","statement":"' || repeat('s', o_custkey % 9) || '"}' || chr(10) FROM orders
  UNION ALL SELECT 'records', record_id, '{"id":"' || record_id || '","revision":' || revision || ',"data":"' || event_type || '"}' || chr(10) FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY revision DESC) = 1) WHERE op <> 'delete'
  UNION ALL SELECT 'revisions', lpad(CAST(position AS VARCHAR), 12, '0'), '{"position":' || position || ',"id":"' || record_id || '","op":"' || op || '"}' || chr(10) FROM log
), whole AS (SELECT section, string_agg(line, '' ORDER BY key) AS w FROM lines GROUP BY section),
cut AS (SELECT section, unnest(range((length(w) + 4092) // 4093)) AS part, w FROM whole),
body AS (SELECT section, CAST(part AS BIGINT) AS part, substr(w, part * 4093 + 1, 4093) AS b FROM cut)
SELECT section, part, length(b) - length(replace(b, chr(10), '')) AS rows, CAST(strlen(b) AS BIGINT) AS bytes, sha256(b) AS sha256 FROM body""")
def space_export_parts(spark, d):
    """A space's sections as parts of at most 4,096 bytes, cut at prefix sums."""
    return space_export.parts(_space_lines(spark, d), scratch(spark, "space"), 4096).drop("body")


@query(_L + f"""
, live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY revision DESC) AS r FROM log WHERE position <= {_AT}) WHERE r = 1 AND op <> 'delete')
SELECT event_type, count(*) AS n, CAST(sum(revision) AS BIGINT) AS revisions FROM live GROUP BY event_type""")
def snapshot_job_asof(spark, d):
    """An aggregate job over what was live at its watermark, cut by cut."""
    job = jobs.Job(scratch(spark, "job"), _AT, max_records=10**12)
    partial = lambda df, cut: df.groupBy(*cut, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("revision").alias("revisions"))
    done = jobs.run_as_of(job, change_log(spark, d), ["event_type"], partial, cuts=4)
    return jobs.merged(spark, done, lambda df: df.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("revisions").alias("revisions")))


@query(_L + """SELECT max(position) AS head, count(*) FILTER (position > (SELECT max(position) FROM log WHERE position % 10 <> 0)) AS later,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS unpublished, 'stale' AS freshness FROM log WHERE position % 10 <> 0""")
def freshness_unpublished(spark, d):
    """A snapshot at the head of the log, while events are committed that have no position yet."""
    log = change_log(spark, d).filter("position % 10 <> 0")
    head = log.agg(F.max("position")).first()[0]
    return history.freshness(log, head, 1, table(spark, d, "orders").filter("o_orderstatus = 'P'"))
