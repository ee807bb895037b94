"""Queries: texts, retrieval, relevance, encodings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions.canonical import canonical_column, key_column, unique_tuple
from siltstone.operators import history
from siltstone.operators.evidence import extract_text as extracted
from siltstone.plans.inputs import scratch, table
from siltstone.plans.registry import query
from siltstone.retrieval import bundle, candidates, chunk, coverage, digests, generations, kinds, requests, search, vector_index
from siltstone.sources import files


def _end(start):
    """Where the chunk from `start` ends: with the text, or after the last white space of its second half."""
    half = rf"length(regexp_extract(substr(text, {start} + 501, 500), '(?s)^(.*\s)', 1))"
    return f"CASE WHEN {start} + 1000 >= length(text) THEN length(text) ELSE {start} + 500 + CASE WHEN {half} > 0 THEN {half} ELSE 500 END END"


@query(f"""
WITH RECURSIVE c AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS s, CAST({_end('0')} AS BIGINT) AS e FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, c.e - 100, CAST({_end('(c.e - 100)')} AS BIGINT) FROM c JOIN documents USING (doc_id) WHERE c.e < length(text)
), part AS (SELECT doc_id AS ref_id, s AS start, e AS "end", substr(text, s + 1, e - s) AS content FROM c JOIN documents USING (doc_id))
SELECT ref_id, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY start) - 1 AS INTEGER) AS chunk_index, start, "end", content FROM part WHERE trim(content, chr(32) || chr(10)) <> ''""")
def chunk_documents(spark, d):
    return chunk.chunked(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, true AS covered FROM documents WHERE length(trim(text)) > 0")
def chunk_offsets_roundtrip(spark, d):
    """Whether each text's chunks start at 0, overlap by 100, end with the text and are its very substrings."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    parts = chunk.chunked(docs, "doc_id", "text").withColumnRenamed("ref_id", "doc_id")
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    joined = parts.withColumn("before", before).join(docs, "doc_id")
    whole = joined.withColumn("same", (F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("content")) & (F.coalesce(F.col("before") - 100, F.lit(0)) == F.col("start")))
    return whole.groupBy("doc_id").agg((F.every("same") & (F.max("end") == F.max(F.length("text")))).alias("covered"))


@query("SELECT page_id AS source_id, CAST(length(html) AS BIGINT) AS n, CAST(strlen(html) AS BIGINT) AS source_end, CAST(NULL AS VARCHAR) AS code FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 0, 0, 'UNSUPPORTED' FROM pages WHERE page_id % 2 = 1")
def extract_text(spark, d):
    mime = F.when(F.col("page_id") % 2 == 0, "text/plain").otherwise("text/html")
    out = extracted(table(spark, d, "pages").select(F.col("page_id").alias("source_id"), mime.alias("mime"), F.encode("html", "utf-8").alias("content")))
    return out.select("source_id", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.element_at("segments", 1)["source_end"], F.lit(0).cast("long")).alias("source_end"), "code")


@query()
def embed_feature_hash(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return chunk.embedded(docs).select("doc_id", "content_sha256", "embedding")


@query("""
SELECT 'd' || doc_id AS ref_id, lang AS collection_id, 0::INTEGER AS position, 'source' AS field, source AS text FROM documents WHERE lang IN ('en', 'de')
UNION ALL SELECT 'd' || doc_id, lang, 1, 'text', text FROM documents WHERE lang = 'en' AND doc_id % 5 <> 0""")
def configured_content(spark, d):
    """What two collections' policies index of their documents: fields in order, strings only."""
    docs = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    data = F.to_json(F.struct("source", "doc_id", text.alias("text")), {"ignoreNullFields": "false"})
    records = docs.select(F.concat(F.lit("d"), "doc_id").alias("ref_id"), F.col("lang").alias("collection_id"), data.alias("canonical_data"))
    return chunk.configured(records, {"en": ["source", "text", "doc_id"], "de": ["source"]})


@query("SELECT sha256(text) AS content_sha256, bool_or(doc_id % 2 = 0) AS known, CAST(max(CASE WHEN doc_id % 2 = 0 THEN doc_id END) AS DOUBLE) AS was FROM documents GROUP BY 1")
def embedding_reuse(spark, d):
    """Contents whose vectors are there from before, the latest of each digest, and those still to be embedded."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    before = [docs.filter(f"doc_id % 4 = {k}").select("content_sha256", F.array(F.col("doc_id").cast("float")).alias("embedding"), F.col("doc_id").alias("at")) for k in (0, 2)]
    known = chunk.reusable(*before)
    return docs.select("content_sha256").distinct().join(known, "content_sha256", "left").select("content_sha256", F.col("embedding").isNotNull().alias("known"), F.element_at("embedding", 1).cast("double").alias("was"))


_COS = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])) * list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[])))"


@query(f"""
SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format('e.embedding', 'q.embedding')}, 9) DESC, e.vec_id) AS position
FROM embeddings e JOIN embeddings q ON q.vec_id < 5 AND e.vec_id <> q.vec_id QUALIFY position <= 10""")
def vector_topk_exact(spark, d):
    v = table(spark, d, "embeddings")
    return candidates.nearest(v, v.filter("vec_id < 5"), 10).select("query_id", "vec_id", F.col("position").cast("long").alias("position"))


@query(f"""
SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format('e.embedding', 'q.embedding')}, 9) DESC, e.vec_id) AS position
FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id QUALIFY position <= 10""")
def vector_topk_every_20th(spark, d):
    """The search of vector_topk_exact for every vector whose id is divisible by 20."""
    v = table(spark, d, "embeddings")
    return candidates.nearest(v, v.filter("vec_id % 20 = 0"), 10).select("query_id", "vec_id", F.col("position").cast("long").alias("position"))


#: Lists of the index, and how many of them a query looks into.
_LISTS, _PROBES = 32, 24


@query()
def vector_topk_indexed(spark, d):
    """The search of vector_topk_every_20th in an index of inverted lists, by its nearest lists only; the tests print its recall."""
    v = table(spark, d, "embeddings")
    index = vector_index.build(v, scratch(spark, "lists"), _LISTS)
    found = index.nearest(v.filter("vec_id % 20 = 0"), 10, "vec_id", "embedding", _PROBES)
    return found.select("query_id", "vec_id", F.col("position").cast("long").alias("position"), F.lit(True).alias("approximate"))


_QUERY = 'the "of the" or en -und'


_indexes: dict[tuple, str] = {}


def _built(spark, d):
    """Write the postings of the documents, a chunk each, to a new folder."""
    folder = scratch(spark, "postings")
    candidates.write_index(_refs(spark, d).withColumn("content", F.col("text")), ["doc_id", *search.REF, "revision", "chunk_index"], folder)
    return folder


def _index(spark, d):
    """The written postings; they are made once for a session and a state of the documents' files."""
    key = (spark.sparkContext.applicationId, files.signature(table(spark, d, "documents")))
    if key not in _indexes:
        _indexes[key] = _built(spark, d)
    return candidates.stored_index(spark, _indexes[key])


def _refs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.col("lang").alias("collection_id"), F.lit("record").alias("kind"), F.format_string("d%08d", "doc_id").alias("ref_id"), (F.col("doc_id") % 3 + 1).alias("revision"), F.lit(0).alias("chunk_index"), "text")


@query(r"""
WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents)
SELECT doc_id FROM w WHERE ((contains(t, ' the ') AND contains(t, ' of the ')) OR contains(t, ' en ')) AND NOT contains(t, ' und ')""")
def lexical_match_simple(spark, d):
    return candidates.lexical(_index(spark, d), ["doc_id"], _QUERY).select("doc_id")


@query()
def lexical_match_english(spark, d):
    """Matches and ranks under the English configuration: stems, and stop words that only keep their place."""
    folder = scratch(spark, "postings")
    chunks = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    candidates.write_index(chunks, ["doc_id"], folder, configuration="english")
    found = candidates.lexical(candidates.stored_index(spark, folder), ["doc_id"], 'relied or edges -une', "english")
    return found.select("doc_id", F.round("score", 9).alias("score"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY ALL)
SELECT length(term) AS letters, count(DISTINCT term) AS terms, count(*) AS postings, CAST(sum(n) AS BIGINT) AS positions FROM p GROUP BY 1""")
def lexical_index_build(spark, d):
    """The index built anew: how many terms of each length, postings and positions it holds."""
    return candidates.extent(candidates.stored_index(spark, _built(spark, d)))


_COVERS = r"""
word AS (SELECT doc_id, lang, unnest(ws) AS t, generate_subscripts(ws, 1) AS p FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents)),
near AS (SELECT *, lag(t) OVER v AS last_t, lag(p) OVER v AS last_p FROM word WHERE t IN ('the', 'and') WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
cover AS (SELECT doc_id, lang, round(sum(0.1::DOUBLE / (p - last_p)), 9) AS score FROM near WHERE last_t <> t GROUP BY ALL)"""


@query(f"WITH {_COVERS} SELECT doc_id, score FROM cover ORDER BY score DESC, doc_id LIMIT 40")
def lexical_rank(spark, d):
    found = candidates.lexical(_index(spark, d), ["doc_id"], "the and").select("doc_id", F.round("score", 9).alias("score"))
    return found.orderBy(F.desc("score"), "doc_id").limit(candidates.overfetch(10))


_HYBRID = f"""
WITH {_COVERS},
lists AS (
  SELECT doc_id, 0 AS list, row_number() OVER (ORDER BY score DESC, lang, doc_id) AS position FROM cover WHERE doc_id % 11 <> 0 AND lang <> 'es' QUALIFY position <= 40
  UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY round({_COS.format('e.embedding', 'q.embedding')}, 9) DESC, lang, doc_id) AS position
  FROM embeddings e JOIN documents ON e.vec_id = doc_id JOIN embeddings q ON q.vec_id = 0 WHERE doc_id % 11 <> 0 AND lang <> 'es' QUALIFY position <= 40
), told AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'stale' ELSE 'ok' END AS verdict FROM lists),
again AS (SELECT doc_id, list, row_number() OVER (PARTITION BY list ORDER BY position) AS position FROM told WHERE verdict = 'ok')"""


def _searched(spark, d, limit=10):
    """Documents and their vectors as refs of a collection per language; one in five is deleted and one in seven has moved on by the reread."""
    refs = _refs(spark, d)
    authority = refs.select(*search.REF, "revision", (F.col("doc_id") % 11 == 0).alias("tombstone"))
    now = refs.select(*search.REF, F.when(F.col("doc_id") % 7 == 0, 9).otherwise(F.col("revision")).alias("revision"), (F.col("doc_id") % 5 == 0).alias("tombstone"))
    readable = spark.createDataFrame([("en",), ("fr",), ("de",)], "collection_id string")
    embeddings = table(spark, d, "embeddings")
    vectors = embeddings.join(refs.drop("text"), F.col("vec_id") == F.col("doc_id")).withColumn("generation", F.lit(1))
    wanted = embeddings.filter("vec_id = 0").select(F.col("embedding").cast("array<double>")).first()
    return search.search(search.Request("the and", tuple(wanted[0]), limit), _index(spark, d), vectors, authority, readable, now=now)


@query(_HYBRID + """
SELECT row_number() OVER (ORDER BY round(score, 12) DESC, best, first_list, doc_id) AS rank, 'd' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS ref_id, round(score, 9) AS score
FROM (SELECT doc_id, lang, sum(1.0::DOUBLE / (60 + position)) AS score, min(position) AS best, min(CASE WHEN position = m THEN list END) AS first_list
  FROM (SELECT *, min(position) OVER (PARTITION BY doc_id) AS m FROM again) JOIN documents USING (doc_id) GROUP BY ALL)
ORDER BY 1 LIMIT 10""")
def search_hybrid(spark, d):
    """From a request to its hits: lexical and vector candidates that are live, fused, reread and fused anew."""
    return _searched(spark, d)[0].select(F.col("rank").cast("long").alias("rank"), "ref_id", F.round("score", 9).alias("score"))


@query(_HYBRID + """,
hit AS (SELECT doc_id, lang, sum(1.0::DOUBLE / (60 + position)) AS score, min(position) AS best, min(CASE WHEN position = m THEN list END) AS first_list, bool_or(list = 0) AS lex, bool_or(list = 1) AS vec
  FROM (SELECT *, min(position) OVER (PARTITION BY doc_id) AS m FROM again) JOIN documents USING (doc_id) GROUP BY ALL ORDER BY round(score, 12) DESC, best, first_list, doc_id LIMIT 10)
SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS ref_id, substr(text, 11, 40) AS text, CASE WHEN lex AND vec THEN '0,1' WHEN lex THEN '0' ELSE '1' END AS matched_by FROM hit JOIN documents USING (doc_id)""")
def search_citations(spark, d):
    """The hits of search_hybrid with their citations, here the 40 characters that follow the tenth, and the lists that had them."""
    refs = _refs(spark, d)
    spans = refs.select(*search.REF, "chunk_index", F.lit(10).alias("start"), F.lit(50).alias("end"))
    out = search.cited(_searched(spark, d)[0], spans, refs.select(*search.REF, F.lit("text").alias("field"), "text"))
    return out.select("ref_id", "text", F.array_join(F.transform("matched_by", lambda x: x.cast("string")), ",").alias("matched_by"))


def _of_kinds(spark, d):
    """Documents as records, sources and claims; some have a later revision, another extraction, or are deleted, and claims cite collections."""
    docs = table(spark, d, "documents")
    n, kind = F.col("doc_id"), F.element_at(F.array(*map(F.lit, kinds.KINDS)), (F.col("doc_id") % 3 + 1).cast("int"))
    refs = docs.select("doc_id", F.col("lang").alias("collection_id"), kind.alias("kind"), F.format_string("d%08d", "doc_id").alias("ref_id"), "text", F.when(n % 7 == 0, 2).otherwise(1).cast("long").alias("now"), (n % 11 == 0).alias("tombstone"))
    records = refs.filter("kind = 'record'").select("collection_id", F.col("ref_id").alias("record_id"), F.col("now").alias("revision"), "tombstone", F.lit("text").alias("field"), "text")
    entities = refs.filter("kind <> 'record'").select("collection_id", "kind", F.col("ref_id").alias("entity_id"), F.col("now").alias("revision"), "tombstone")
    sources = refs.filter("kind = 'source'")
    segment = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.char_length("text").cast("long").alias("end"), F.lit(3).cast("long").alias("source_start"), (F.octet_length("text") + 3).cast("long").alias("source_end")))
    extraction = lambda version: F.struct(F.lit(version).cast("long").alias("version"))
    versions = F.when(n % 5 == 0, F.array(extraction(1), extraction(2))).otherwise(F.array(extraction(1)))
    extractions = sources.select("collection_id", F.col("ref_id").alias("source_id"), F.explode(versions).alias("v"), F.col("text").alias("content"), segment.alias("segments")).select("collection_id", "source_id", "v.version", "content", "segments")
    claims = refs.filter("kind = 'claim'").select("collection_id", F.col("ref_id").alias("claim_id"), F.col("now").alias("revision"), F.col("text").alias("statement"))
    cites = refs.filter("kind = 'claim'").select("collection_id", F.col("ref_id").alias("claim_id"), F.col("now").alias("revision"), F.lit(0).alias("ordinal"), F.when(n % 13 == 0, "es").otherwise("en").alias("source_collection_id"), F.lit("s").alias("source_id"))
    chunks = refs.select("doc_id", *search.REF, F.lit(1).cast("long").alias("revision"), F.when(F.col("kind") == "source", 1).cast("long").alias("extraction"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    return chunks, records, entities, extractions, claims, cites


def _kinds_found(spark, d, parts):
    chunks, records, entities, extractions, _, cites = parts
    key = ("kinds", spark.sparkContext.applicationId, files.signature(table(spark, d, "documents")))
    if key not in _indexes:
        folder = scratch(spark, "postings")
        candidates.write_index(chunks, [*search.REF, "revision", "extraction", "chunk_index"], folder)
        _indexes[key] = folder
    readable = spark.createDataFrame([("en",), ("fr",), ("de",)], "collection_id string")
    hidden = cites.filter("source_collection_id = 'es'").select(F.col("claim_id").alias("ref_id")).distinct()
    collections = table(spark, d, "documents").select(F.col("lang").alias("collection_id")).distinct().withColumn("lifecycle", F.when(F.col("collection_id") == "de", "deleted").otherwise("active"))
    able = kinds.authority(records, entities, extractions, collections)
    return search.search(search.Request("the and", limit=25, mode="lexical"), candidates.stored_index(spark, _indexes[key]), None, able, readable, hidden)


_KINDS_SQL = f"""
WITH {_COVERS},
live AS (
  SELECT doc_id, lang, score, ['record', 'source', 'claim'][doc_id % 3 + 1] AS kind, 'd' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS ref_id FROM cover
  WHERE lang IN ('en', 'fr') AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND NOT (doc_id % 3 = 1 AND doc_id % 5 = 0) AND NOT (doc_id % 3 = 2 AND doc_id % 13 = 0)
), hit AS (SELECT *, row_number() OVER (ORDER BY score DESC, lang, kind, ref_id) AS rank FROM live QUALIFY rank <= 25)"""


@query(_KINDS_SQL + """
SELECT rank, kind, ref_id, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM hit""")
def search_kinds(spark, d):
    """A search over records at their revision, sources at their latest extraction and claims that cite what may be read."""
    return _kinds_found(spark, d, _of_kinds(spark, d))[0].select(F.col("rank").cast("long").alias("rank"), "kind", "ref_id", F.round("score", 9).alias("score"))


@query(_KINDS_SQL + """
SELECT rank, kind, ref_id, substr(text, 6, least(length(text), 45) - 5) AS text,
  CASE WHEN kind = 'source' THEN 3 + strlen(substr(text, 1, 5)) END AS source_start, CASE WHEN kind = 'source' THEN 3 + strlen(substr(text, 1, least(length(text), 45))) END AS source_end,
  CASE WHEN kind = 'claim' THEN 'en/s' END AS evidence
FROM hit JOIN documents USING (doc_id)""")
def search_kinds_cited(spark, d):
    """The same hits with their citations: the text that stands there now, of sources the bytes it came from, of claims their evidence."""
    chunks, records, entities, extractions, claims, cites = parts = _of_kinds(spark, d)
    end = F.least(F.char_length("content"), F.lit(45)).cast("long")
    spans = chunks.select(*search.REF, "revision", "extraction", "chunk_index", F.when(F.col("kind") == "record", "text").alias("field"), F.lit(5).cast("long").alias("start"), end.alias("end"))
    out = kinds.cited(_kinds_found(spark, d, parts)[0], spans, records, extractions, claims, cites)
    told = F.array_join(F.transform("evidence", lambda e: F.concat(e["source_collection_id"], F.lit("/"), e["source_id"])), ",")
    return out.select(F.col("rank").cast("long").alias("rank"), "kind", "ref_id", "text", "source_start", "source_end", told.alias("evidence"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 100 = 1 THEN 'absent' WHEN doc_id % 100 = 3 THEN 'extra' ELSE 'differs' END AS difference FROM documents WHERE doc_id % 100 IN (1, 2, 3)""")
def generation_digests(spark, d):
    """A projection held against the authority by a tree of digests; only leaves that differ are read."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), "lang")
    base, n = scratch(spark, "digests"), F.col("doc_id") % 100
    authority, projection = (digests.Ranged(f"{base}/{x}", "doc_id", ("sha", "lang")) for x in ("authority", "projection"))
    authority.write(rows.filter(n != 3))
    projection.write(rows.filter(n != 1).withColumn("lang", F.when(n == 2, None).otherwise(F.col("lang"))))
    return digests.compared(spark, projection, authority)


@query(_HYBRID + """
SELECT CAST(least(10, count(*) FILTER (verdict = 'ok')) AS BIGINT) AS found, count(*) FILTER (verdict = 'deleted') AS deleted, count(*) FILTER (verdict = 'stale') AS stale, 0::BIGINT AS unauthorized
FROM (SELECT DISTINCT doc_id, verdict FROM told)""")
def search_hybrid_report(spark, d):
    told = search.report(_searched(spark, d)[1], search.Request("the and", (1.0,), 10))
    return told.select(F.col("found").cast("long").alias("found"), "deleted", "stale", "unauthorized")


@query(_HYBRID + """,
n AS (SELECT list, count(*) AS n FROM lists GROUP BY list),
r AS (SELECT count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict <> 'ok') AS rejected, (SELECT max(n) FROM n) AS fetched FROM (SELECT DISTINCT doc_id, verdict FROM told))
SELECT least(ok, 50) AS found, CASE WHEN ok >= 50 THEN '' ELSE concat_ws(',', CASE WHEN rejected > 0 THEN 'rejected' END, CASE WHEN fetched >= 200 THEN 'capped' ELSE 'exhausted' END, 'degraded') END AS reasons FROM r""".replace("position <= 40", "position <= 200"))
def search_hybrid_reasons(spark, d):
    """Why a search for fifty hits found fewer, if it did: what was rejected, how far the lists went, and what the projections' states say."""
    states = spark.createDataFrame([("degraded",), ("current",)], "state string")
    told = search.report(_searched(spark, d, 50)[1], search.Request("the and", (1.0,), 50), states)
    return told.select(F.col("found").cast("long").alias("found"), F.array_join("reasons", ",").alias("reasons"))


_RANKS = """
lists AS (SELECT 0 AS list, doc_id AS ref_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents
  UNION ALL SELECT 1, doc_id, row_number() OVER (ORDER BY length(text) % 97, doc_id) FROM documents),
top_ AS (SELECT * FROM lists WHERE position <= 200),
f AS (SELECT ref_id, sum(1.0::DOUBLE / (60 + position)) AS score, min(position) AS best_rank, min(CASE WHEN position = m THEN list END) AS best_list
  FROM (SELECT *, min(position) OVER (PARTITION BY ref_id) AS m FROM top_) GROUP BY ref_id)"""


def _lists(spark, d):
    docs = table(spark, d, "documents")
    a = docs.orderBy(F.desc("n_chars"), "doc_id").limit(200).withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_chars"), "doc_id")))
    key = F.length("text") % 97
    b = docs.orderBy(key, "doc_id").limit(200).withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key, "doc_id")))
    return a.select(F.lit(0).alias("list"), F.col("doc_id").alias("ref_id"), "position").unionByName(b.select(F.lit(1).alias("list"), F.col("doc_id").alias("ref_id"), "position"))


@query(f"WITH {_RANKS} SELECT ref_id, round(score, 9) AS score, best_rank FROM f ORDER BY round(score, 12) DESC, best_rank, best_list, ref_id LIMIT 40")
def rrf_fuse(spark, d):
    return candidates.fused(_lists(spark, d), 40).select("ref_id", F.round("score", 9).alias("score"), F.col("best_rank").cast("long").alias("best_rank"))


def _authority(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("ref_id"), F.col("lang").alias("collection_id"), (F.col("doc_id") % 3).alias("revision"), (F.col("doc_id") % 11 == 0).alias("tombstone"))


@query(f"""WITH {_RANKS} SELECT ref_id, CASE WHEN ref_id % 11 = 0 THEN 'deleted' WHEN lang NOT IN ('en', 'de') THEN 'unauthorized' WHEN ref_id % 3 <> 1 THEN 'stale' ELSE 'ok' END AS verdict
FROM (SELECT * FROM f ORDER BY round(score, 12) DESC, best_rank, best_list, ref_id LIMIT 200) JOIN documents ON doc_id = ref_id""")
def search_reread_reject(spark, d):
    found = candidates.fused(_lists(spark, d), 200).withColumn("revision", F.lit(1))
    open_ = table(spark, d, "documents").filter("lang IN ('en', 'de')").select(F.col("lang").alias("collection_id")).distinct()
    return candidates.reread(found, _authority(spark, d), open_).select("ref_id", "verdict")


@query(f"""WITH {_RANKS}, s AS (SELECT ref_id % 11 <> 0 AND lang IN ('en', 'de') AND ref_id % 3 = 1 AS good FROM (SELECT * FROM f ORDER BY round(score, 12) DESC, best_rank, best_list, ref_id LIMIT 200) JOIN documents ON doc_id = ref_id)
SELECT count(*) AS fetched, count(*) FILTER (good) AS found, count(*) FILTER (NOT good) AS rejected FROM s""")
def search_underfill(spark, d):
    checked = search_reread_reject(spark, d)
    return checked.agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("verdict") == "ok").alias("found"), F.count_if(F.col("verdict") != "ok").alias("rejected"))


@query()
def bundle_pack(spark, d):
    """One row: a bundle of the best-ranked documents' chunks, at most 50, within 4,096 bytes."""
    best = candidates.fused(_lists(spark, d), 10).withColumnRenamed("ref_id", "doc_id")
    parts = chunk.chunked(table(spark, d, "documents").join(best.select("doc_id"), "doc_id", "left_semi"), "doc_id", "text")
    hits = parts.join(best, parts.ref_id == best.doc_id).orderBy(F.desc("score"), "ref_id", "chunk_index").limit(50)
    rank = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "ref_id", "chunk_index"))
    ranked = hits.withColumn("request", F.lit(0).cast("long")).withColumn("rank", rank)
    return bundle.packed(spark.range(1).toDF("request"), ranked.select("request", "rank", "ref_id", F.lit("text").alias("field"), "start", "end", F.col("content").alias("text")), "request", 4096).drop("request")


@query()
def question_classifier(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", requests.classified(F.col("text")).alias("kind"))


@query("""
WITH r AS (SELECT lang AS query_id, quality AS grade, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS position FROM documents JOIN labels USING (doc_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, position) AS ideal FROM r),
g AS (SELECT query_id, sum(CASE WHEN position <= 10 THEN (pow(2, grade) - 1) / log2(position + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END) AS idcg,
  count(*) FILTER (position <= 10 AND grade > 0) AS hits, count(*) FILTER (grade > 0) AS relevant, min(CASE WHEN grade > 0 THEN position END) AS first_ FROM i GROUP BY query_id)
SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg, round(CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END, 6) AS recall, round(hits / 10, 6) AS precision_, round(coalesce(1.0::DOUBLE / first_, 0), 6) AS mrr FROM g""")
def relevance_metrics(spark, d):
    ranked = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    placed = history.placed(ranked.select(F.col("lang").alias("query_id"), F.col("quality").alias("grade"), "n_chars", "doc_id"), scratch(spark, "ranked"), ["query_id"], "n_chars", "doc_id", name="position")
    out = candidates.relevance(placed.select("query_id", "grade", "position"))
    return out.select("query_id", *[F.round(c, 6).alias(n) for c, n in (("ndcg", "ndcg"), ("recall", "recall"), ("precision", "precision_"), ("mrr", "mrr"))])


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') AS digest FROM documents")
def sha256_canonical(spark, d):
    text = F.concat(F.lit('{"doc_id":'), "doc_id", F.lit(',"lang":"'), "lang", F.lit('"}'))
    return table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("digest"))


@query("SELECT c_custkey, nfc_normalize('é' || c_name) AS key FROM customer")
def nfc_trim_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", key_column(F.concat(F.lit("  é"), "c_name", F.lit(" "))).alias("key"))


@query("SELECT c_custkey, 'string:' || strlen(c_mktsegment) || ':' || c_mktsegment || 'number:' || strlen(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey AS encoded FROM customer")
def unique_tuple_encode(spark, d):
    return table(spark, d, "customer").select("c_custkey", unique_tuple([("string", F.col("c_mktsegment")), ("number", F.col("c_custkey"))]).alias("encoded"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'absent' ELSE 'differs' END AS difference FROM documents WHERE doc_id % 10 IN (1, 2)")
def generation_verify(spark, d):
    authority = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    projection = authority.filter("doc_id % 10 <> 1").withColumn("sha", F.when(F.col("doc_id") % 10 == 2, F.lit("old")).otherwise(F.col("sha")))
    return generations.mismatches(projection, authority, "doc_id", ["sha"])


@query("SELECT user_id, event_id AS revision, event_type = 'error' AS deleted FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error' DESC, event_id DESC) = 1")
def apply_fence(spark, d):
    log = table(spark, d, "events").select("user_id", F.col("event_id").alias("revision"), (F.col("event_type") == "error").alias("deleted"), F.lit(None).cast("long").alias("extraction"))
    return generations.applied(log, ["user_id"]).drop("extraction")


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS sha256 FROM documents")
def text_digests(spark, d):
    return files.digested(table(spark, d, "documents"), "text").select("doc_id", "n_bytes", "sha256")


@query("""
WITH r AS (SELECT lang, CASE WHEN doc_id % 50 = 0 THEN 3 WHEN doc_id % 7 = 0 AND lang <> 'es' THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS k FROM documents)
SELECT lang AS collection_id, CASE max(k) WHEN 3 THEN 'unindexed' WHEN 2 THEN 'degraded' WHEN 1 THEN 'pending' ELSE 'current' END AS state, count(*) FILTER (k = 0) AS current, count(*) FILTER (k = 1) AS pending,
  count(*) FILTER (k = 2) AS degraded, count(*) FILTER (k = 3) AS unindexed FROM r GROUP BY lang""")
def projection_state(spark, d):
    docs = table(spark, d, "documents")
    failed = (F.col("doc_id") % 7 == 0) & (F.col("lang") != "es")
    outbox = docs.filter("doc_id % 50 <> 0").select("doc_id", failed.cast("int").alias("failures"), (F.col("doc_id") % 3 != 0).alias("delivered"))
    return coverage.projection_state(docs.select("doc_id", F.col("lang").alias("collection_id")), outbox, ["doc_id"])


@query("""SELECT event_id, sha256('{"a":[1,null,true],"event":"' || event_type || '","n":' || event_id || '}') AS digest FROM events""")
def canonical_json_digest(spark, d):
    """Digests of canonical JSON, from texts whose keys and numbers are written otherwise."""
    text = F.concat(F.lit('{ "n" : '), "event_id", F.lit('.0, "event":"'), "event_type", F.lit('",\n"a":[1e0, null,true] }'))
    return table(spark, d, "events").select("event_id", F.sha2(canonical_column(text), 256).alias("digest"))


@query("SELECT r_name, array_to_string(list_sort(list(n_name) FILTER (n_nationkey % 3 = 0)), ',') AS missing FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name HAVING bool_or(n_nationkey % 3 = 0)")
def dependencies_unmet(spark, d):
    """Regions that need all their nations and have those whose key is not divisible by three."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    needs = n.groupBy("r_name").agg(F.collect_list("n_name").alias("needed"))
    has = n.filter("n_nationkey % 3 <> 0").groupBy("r_name").agg(F.collect_list("n_name").alias("held"))
    return generations.unmet(needs, has, "r_name").select("r_name", F.array_join("missing", ",").alias("missing"))
