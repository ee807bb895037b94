"""The queries opN_<name> of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import class_lm, decontamination, lz_fingerprint, packing, secret_scan, sentencepiece_codec, spelling_variants, token_counts, url_filter, vector_codes, warc
from siltstone.llm import toxicity as tox
from siltstone.llm.ngram_join import ngram_components
from siltstone.llm.shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the urls of the pages whose id is divisible by 20; every page is judged."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.filtered(pages, pages.filter("page_id % 20 = 0").select("url"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tox.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.language_scores(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
WITH RECURSIVE cut AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents
), word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM cut),
five AS (
  SELECT doc_id, w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d || ' ' || lead(w, 3) OVER d || ' ' || lead(w, 4) OVER d AS g
  FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM five WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM cut WHERE len(ws) BETWEEN 1 AND 4
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y, c = p.n AND c = q.n AS same FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN (SELECT x, y FROM link UNION ALL SELECT y, x FROM link) l ON l.x = r.y
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(x) FROM link WHERE same AND y = d.doc_id), d.doc_id) AS class_id,
  (SELECT min(y) FROM reach WHERE x = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""

_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS chief FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((
    (strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1
  ) >> CAST(3 - 5 * i % 4 AS BIGINT)) & 31) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = chief THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> chief THEN chief END AS refers_to
FROM p
"""

_OP7 = rf"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
named AS (
  SELECT page_id, rest, {_LOWER.format("coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), canon AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_replace(regexp_replace(path, '/index\.html?$', ''), '\.html?$', ''), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort([x FOR x IN string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&')
         IF x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')]), '&'), ''), '') END AS c
  FROM named
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM canon
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN c IN (SELECT c FROM canon WHERE page_id % 20 = 0 AND c IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def _op11(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd rounds in SQL: every part against every entry, one pair of subqueries a round."""
    steps = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), part AS MATERIALIZED (SELECT i, vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM part WHERE vec_id IN (SELECT DISTINCT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
"""
    nearest = """a{0} AS MATERIALIZED (
  SELECT i, part.p, any_value(x) AS x, min({{'far': CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, c)]) AS BIGINT), 'e': e}}) AS best FROM part JOIN c{0} USING (p) GROUP BY i, part.p
)"""
    for r in range(1, rounds + 1):
        steps += nearest.format(r - 1) + f""",
m{r} AS (SELECT p, best.e AS e, k, sum(y) AS s, count(*) AS n FROM (SELECT p, best, unnest(x) AS y, generate_subscripts(x, 1) AS k FROM a{r - 1}) GROUP BY ALL),
n{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM m{r} GROUP BY p, e),
c{r} AS MATERIALIZED (SELECT p, e, coalesce(n{r}.c, c{r - 1}.c) AS c FROM c{r - 1} LEFT JOIN n{r} USING (p, e)),
"""
    return steps + nearest.format(rounds) + f""",
coded AS (SELECT i, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{rounds} GROUP BY i),
books AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS k FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (i), books
"""


def _crc_by_nibble(poly: int = 0xEDB88320) -> list[int]:
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ poly * (c & 1)
        out.append(c)
    return out


def _op13() -> str:
    def half(c: str) -> str:
        return f"xor({c} >> 4, {_crc_by_nibble()}[({c} & 15) + 1])"

    return rf"""
WITH RECURSIVE run AS MATERIALIZED (
  SELECT d, r, count(*) AS m FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents
  ) GROUP BY ALL
), bytes AS (
  SELECT *, flatten([CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 | (unicode(x) >> 6) AS BIGINT), CAST(128 | (unicode(x) & 63) AS BIGINT)] END FOR x IN string_split(d || ':' || r, '')]) AS b FROM run
), hashed AS (
  SELECT r, m, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: {half(half("xor(c, x)"))}), 4294967295) AS h FROM bytes
), w AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, CAST(sum(m) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(m) >= 5
), less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), longer AS (SELECT b.word AS x, b.n AS xn, a.word AS y, a.n AS yn FROM less a JOIN w b ON a.s = b.word),
near AS (
  SELECT a.word AS x, a.n AS xn, b.word AS y, b.n AS yn FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT x, xn, y, yn FROM longer UNION SELECT y, yn, x, xn FROM longer
), best AS (SELECT x, xn, y, yn, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY yn DESC, y) AS k FROM near),
stat AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN yn >= 5 * n THEN y END AS form, CASE WHEN yn >= 5 * n THEN yn END AS form_n
  FROM w LEFT JOIN best ON x = word AND k = 1
), walk AS (
  SELECT word, word AS root, form AS next FROM stat
  UNION ALL SELECT walk.word, stat.word, stat.form FROM walk JOIN stat ON stat.word = walk.next
)
SELECT word, form, root, n, n_near, form_n FROM stat JOIN (SELECT word, root FROM walk WHERE next IS NULL) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": _OP2, "op5_warc": _OP5, "op7_url_filter": _OP7, "op11_vector_codes": _op11(), "op13_spelling_variants": _op13()}
