"""URL filter: host and path rules, and for what they leave open a list of canonical URLs.

The list is met in two steps: a blocked Bloom filter of its canonical URLs, sized by their number and broadcast
(up to a bound; beyond it every row is a possible hit), passes possible hits, and an exact join of these with
the list removes false positives.  Only possible hits are shuffled.  All steps are DataFrame expressions.

A canonical URL is host (without a leading `www.` and a default port), path (without trailing slashes, index
page or `.html`), and query (parameters sorted, without those that only track: `utm_*`, `ref`, `fbclid`,
`gclid`); scheme and fragment do not count.

Null urls and urls without `://` have an empty host and path; no rule fits them, and they are allowed.  Null
entries of the list are not used; repeated ones count once.  Every row of the pages is judged by itself, rows
that repeat a page_id too; an empty table gives an empty result, and an empty list blocks nothing; columns other than
page_id and url are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import bloom, maybe_listed, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def _rest(url: str):
    """What follows the first ://, or null."""
    u = F.col(url)
    return F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u)))


def host(url: str = "url"):
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: str = "url"):
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: str = "url"):
    """The canonical URL, or null where there is none."""
    h = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)$", ""), r"^www\.", "")
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path(url), r"/index\.html?$", ""), r"\.html?$", ""), r"/+$", "")
    query = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(query, lambda x: (x != "") & ~x.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    return F.when(h != "", F.concat(h, p, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def judged_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """The pages with host, path, rule (host + path of the longest that fits, or null) and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return pages.withColumn("host", host()).withColumn("path", path()).withColumn("rule", rule).withColumn("by_rule", verdict)


def filtered(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict; `listed` has the blocked urls, in any form, in its column url."""
    list_ = written(listed.select(canonical().alias("canonical")).filter("canonical IS NOT NULL").distinct(), "listed")
    judged = judged_by_rules(pages.select("page_id", "url"), rules).withColumn("canonical", canonical())
    # Only what no rule decides is looked up.
    judged = judged.withColumn("canonical", F.when(F.col("rule").isNull(), F.col("canonical")))
    filter_ = bloom(list_, "canonical")
    probed = maybe_listed(judged, "canonical", filter_, "maybe")
    passed = probed.filter("NOT maybe").withColumn("hit", F.lit(False))
    exact = list_.withColumn("hit", F.lit(True))
    # A list that has a filter is small enough, split by its keys, for hash tables.
    hits = probed.filter("maybe").join(exact.hint("shuffle_hash") if filter_.table is not None else exact, "canonical", "left")
    verdict = F.coalesce("by_rule", F.when(F.coalesce("hit", F.lit(False)), "block").otherwise("allow"))
    columns = ["page_id", "host", "path", "rule", verdict.alias("verdict")]
    return passed.select(*columns).unionByName(hits.select(*columns))
