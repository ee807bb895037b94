"""Chunks, candidates, fusion, bundles, classifier and relevance against plain versions."""

import itertools
import math
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.plans import retrievals
from siltstone.retrieval import bundle, candidates, chunk, configurations, generations, neighbours, requests, search, vector_index
from siltstone.types import EngineError


@given(st.text(alphabet="ab \n\té", max_size=400), st.integers(20, 60))
def test_chunks_cover_the_text(text, size):
    overlap = size // 5
    got = list(chunk.spans(text, size, overlap))
    assert all(0 < b - a <= size and text[a:b].strip() for a, b in got)
    held = {i for a, b in got for i in range(a, b)}
    assert all(not text[i].strip() for i in range(len(text)) if i not in held)
    for a, b in got:
        if b < len(text) and any(c.isspace() for c in text[a + size // 2 : a + size]):
            assert text[b - 1].isspace()


def test_embedding(spark):
    memo = {}
    assert chunk._fnv("a") == 0xE40C292C
    v = chunk.embed("The cat, the CAT", 64, memo)
    assert abs((v * v).sum() - 1) < 1e-12 and np.allclose(v, chunk.embed("cat the", 64, {})) and not chunk.embed("...", 8, {}).any()
    df = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, None)], "id long, content string")
    got = {r.id: r.embedding for r in chunk.embedded(df, dimensions=16).collect()}
    assert got[1] == got[2] and len(got[1]) == 16


def test_providers_are_checked_and_tried_again():
    waits, calls = [], []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise chunk.Outage
        return [[1.0, 0.0]] * len(texts)

    assert chunk.provided(flaky, ["a", "b"], 2, waits.append).tolist() == [[1, 0], [1, 0]] and waits == [0.25, 1.0]

    def down(texts):
        raise chunk.Outage

    for bad in (down, lambda t: [[0.0, 0.0]], lambda t: [[1.0]], lambda t: [[1.0, float("inf")]]):
        with pytest.raises(EngineError):
            chunk.provided(bad, ["a"], 2, waits.append)


def test_embeddings_are_reused_and_batched(spark):
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "id long, content string")
    known = chunk.embedded(df.filter("id < 3"), dimensions=4).select("content_sha256", F.array(*[F.lit(9.0)] * 4).alias("embedding"))

    def provider(texts):
        if len(texts) > 2:
            raise ValueError("too many at once")
        return [[float(len(t)), 1.0, 0.0, 0.0] for t in texts]

    got = {r.id: r.embedding for r in chunk.embedded(df, dimensions=4, embed_batch=provider, max_batch=2, known=known).collect()}
    assert len(got) == 40 and all(got[i] == ([9.0] * 4 if i % 7 < 3 else [6.0, 1.0, 0.0, 0.0]) for i in got)
    rows = spark.createDataFrame([("r", 1, 0, "x"), ("r", 1, 1, "y")], "ref_id string, revision int, chunk_index int, content_sha256 string")
    assert {r.chunk_index: r.done for r in chunk.checkpointed(rows, rows.filter("chunk_index = 1")).collect()} == {0: False, 1: True}


def test_what_is_indexed(spark):
    records = spark.createDataFrame([("r1", "c", '{"b":"two","a":"one","n":3}'), ("r2", "c", '{"a":null}'), ("r3", "other", '{"a":"x"}'), ("r4", "c", "no json")], "ref_id string, collection_id string, canonical_data string")
    sources = spark.createDataFrame([("s", "c", "body"), ("t", "c", None)], "ref_id string, collection_id string, content string")
    claims = spark.createDataFrame([("k", "c", "said")], "ref_id string, collection_id string, statement string")
    got = sorted((r.kind, r.ref_id, r.position, r.field, r.text) for r in chunk.indexed(records, sources, claims, {"c": ["a", "n", "b"]}).collect())
    assert got == [("claim", "k", 0, "statement", "said"), ("record", "r1", 0, "a", "one"), ("record", "r1", 2, "b", "two"), ("source", "s", 0, "content", "body")]


DOCS = {1: "the cat sat on the mat", 2: "a cat and a dog", 3: "the dog sat", 4: "Cat. Dog? the-end", 5: ""}


@pytest.mark.parametrize(("query", "want"), [("cat", {1, 2, 4}), ("cat dog", {2, 4}), ('"the cat"', {1}), ("cat or sat", {1, 2, 3, 4}), ("cat -dog", {1}), ('dog -"a dog"', {3, 4}), ("zebra", set())])
def test_lexical(spark, query, want):
    index = candidates.postings(spark.createDataFrame(list(DOCS.items()), "id long, content string"), ["id"])
    assert {r.id for r in candidates.lexical(index, ["id"], query).collect()} == want


def plain_covers(text, alternatives):
    """The least stretches that hold an alternative, by trying all."""
    words = [w.lower() for w in re.findall(r"\w+", text)]
    asked = {t for a in alternatives for t in a}
    holds = lambda i, j: any(set(a) <= set(words[i : j + 1]) for a in alternatives)
    covers = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if holds(i, j) and not (i < j and (holds(i + 1, j) or holds(i, j - 1)))]
    return sum(0.1 / (1 + sum(w not in asked for w in words[i : j + 1])) for i, j in covers)


@pytest.mark.parametrize(("query", "alternatives"), [("cat dog", [["cat", "dog"]]), ("cat", [["cat"]]), ("cat or dog", [["cat"], ["dog"]]), ("a cat or dog", [["a", "cat"], ["dog"]])])
def test_ranks_are_cover_densities(spark, query, alternatives, tmp_path):
    rng = np.random.default_rng(7)
    texts = {i: " ".join(rng.choice(["cat", "dog", "a", "x", "y", "z"], 12)) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "id long, content string")
    candidates.write_index(df, ["id"], f"{tmp_path}/index")
    got = {r.id: r.score for r in candidates.lexical(candidates.read_index(spark, f"{tmp_path}/index"), ["id"], query).collect()}
    want = {i: plain_covers(t, alternatives) for i, t in texts.items() if any(set(a) <= set(t.split()) for a in alternatives)}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-12) for i in want)


def test_a_written_index_has_a_row_per_term_and_block(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "The", "\u00c9t\u00e9", "x1", "\u65e5\u672c", f"only{i}"], rng.integers(0, 60))) + rng.choice(["", ".", "  -- "]) for i in range(300)]
    texts += [None, "", " ... ", "a " * 20000 + "last"]
    # Two chunks of each key are two chunks.
    rows = [(i // 2, f"d{i // 2}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, name string, content string").coalesce(1)
    want = {}
    for i, _, t in rows:
        for term in set(held := re.findall(r"\w+", (t or "").lower())):
            want.setdefault(term, []).append((i, f"d{i}", [p for p, w in enumerate(held) if w == term]))
    for size, blocks in ((8 << 20, 1), (1 << 12, None)):
        monkeypatch.setattr(candidates, "BLOCK_BYTES", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
        candidates.write_index(df, ["id", "name"], f"{tmp_path}/{size}")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        index = candidates.stored_index(spark, f"{tmp_path}/{size}")
        made = index.filter("term IS NULL").count()
        assert made == blocks if blocks else made > 10
        assert index.filter("term IS NOT NULL").count() == (len(want) if blocks else index.select("term", "block").dropna().distinct().count())
        got = {}
        for r in candidates.read_index(spark, f"{tmp_path}/{size}").collect():
            got.setdefault(r.term, []).append((r.id, r.name, r.positions))
        assert {t: sorted(x) for t, x in got.items()} == {t: sorted(x) for t, x in want.items()}
        told = {r.letters: (r.terms, r.postings, r.positions) for r in candidates.extent(index).collect()}
        for n in told:
            mine = [x for t, x in want.items() if len(t) == n]
            assert told[n] == (len(mine), sum(map(len, mine)), sum(len(p) for x in mine for *_, p in x))
        assert sorted(r.id for r in candidates.lexical(index, ["id"], "a").collect()) == sorted(i for i, *_ in want["a"])
    big = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**35 - 1])
    assert candidates._unpacked(candidates._packed(big)[0]).tolist() == big.tolist()


def test_words_have_one_form(spark):
    text = "\ufb01ne \uff23\uff21\uff34 Stra\u00dfe"
    df = spark.createDataFrame([(1, text), (2, None)], "id long, content string")
    got = {r.id: r.w for r in df.select("id", candidates.words(F.col("content")).alias("w")).collect()}
    assert got == {1: ["fine", "cat", "stra\u00dfe"], 2: None}
    memo = {}
    chunk.embed(text, 16, memo)
    assert set(memo) == set(got[1])


def test_search_end_to_end(spark):
    rng = np.random.default_rng(11)
    rows, vectors = [], []
    for i in range(120):
        kind, collection = ("claim" if i % 6 == 0 else "record"), f"c{i % 4}"
        for c in range(1 + i % 3):
            rows.append((collection, kind, f"r{i:03d}", 1 + i % 2, c, " ".join(rng.choice(["storm", "harbour", "x", "y", "z", "w"], 9))))
            v = np.round(rng.normal(size=6), 2)
            vectors.append((*rows[-1][:5], 1 + c % 2, v.tolist()))
    chunks = spark.createDataFrame(rows, "collection_id string, kind string, ref_id string, revision int, chunk_index int, content string")
    embedded = spark.createDataFrame(vectors, "collection_id string, kind string, ref_id string, revision int, chunk_index int, generation int, embedding array<double>")
    refs = sorted({r[:4] for r in rows})
    gone = {r[2] for r in refs if int(r[2][1:]) % 10 == 9}
    authority = spark.createDataFrame([(*r, r[2] in gone) for r in refs], "collection_id string, kind string, ref_id string, revision int, tombstone boolean")
    moved = {r[2] for r in refs if int(r[2][1:]) % 7 == 0}
    now = spark.createDataFrame([(*r[:3], r[3] + (r[2] in moved), r[2] in gone or int(r[2][1:]) % 13 == 0) for r in refs], authority.schema)
    readable = spark.createDataFrame([("c0",), ("c1",), ("c2",)], "collection_id string")
    hidden_ids = {"r012", "r024"}
    hidden = spark.createDataFrame([(x,) for x in hidden_ids], "ref_id string")
    index = candidates.postings(chunks, [*search.REF, "revision", "chunk_index"])
    wanted = np.array([1.0, -0.5, 0.2, 0.1, 0.0, 2.0])

    able = {r[:3] for r in refs if r[2] not in gone and r[0] != "c3" and not (r[1] == "claim" and r[2] in hidden_ids)}
    lexical, cosine = {}, {}
    for *ref, _, _, text in rows:
        if tuple(ref) in able and {"storm", "harbour"} <= set(text.split()):
            lexical[tuple(ref)] = max(lexical.get(tuple(ref), 0), plain_covers(text, [["storm", "harbour"]]))
    for *ref, _, _, generation, v in vectors:
        if tuple(ref) in able and generation == 1:
            cosine[tuple(ref)] = max(cosine.get(tuple(ref), -9), float(np.dot(v, wanted) / np.linalg.norm(v) / np.linalg.norm(wanted)))
    for mode in search.MODES:
        request = search.Request("storm harbour", tuple(wanted), 8, mode)
        lists = {"lexical": lexical, "vector": cosine}
        lists = {k: sorted(v, key=lambda r: (-round(v[r], 9), r))[:32] for k, v in lists.items() if mode in (k, "hybrid")}
        ok = lambda r: r[2] not in moved and int(r[2][1:]) % 13
        score = {}
        for held in lists.values():
            for rank, r in enumerate([r for r in held if ok(r)], 1):
                score[r] = score.get(r, 0) + 1 / (60 + rank)
        hits, checked = search.search(request, index, embedded, authority, readable, hidden, now)
        got = [(r.collection_id, r.kind, r.ref_id) for r in hits.orderBy("rank").collect()]
        assert len(got) == min(8, len(score)) and all(math.isclose(score[a], score[b]) or score[a] > score[b] for a, b in zip(got, got[1:], strict=False))
        assert math.isclose(sum(score[r] for r in got), sum(sorted(score.values(), reverse=True)[:8]))
        told = search.report(checked, request).first()
        every = {r for held in lists.values() for r in held}
        assert told.found == min(8, len(score)) and told.deleted + told.stale == sum(not ok(r) for r in every) and told.unauthorized == 0 and told.reasons == []
    for bad in (search.Request("x", None), search.Request(None, (1.0,), mode="lexical"), search.Request("x", (0.0, 0.0)), search.Request("x", (float("nan"),)), search.Request("x", (1.0,), 0)):
        with pytest.raises(EngineError):
            search.search(bad, index, embedded, authority, readable)


def test_short_results_say_why(spark):
    rows = [("a", "record", "x", 1, 1, "lexical", "ok"), ("a", "record", "y", 1, 2, "lexical", "stale")]
    checked = spark.createDataFrame(rows, "collection_id string, kind string, ref_id string, revision int, position int, list string, verdict string")
    states = spark.createDataFrame([("pending",), ("current",)], "state string")
    told = search.report(checked, search.Request("x", None, 5, "lexical"), states).first()
    assert (told.found, told.stale, told.reasons) == (1, 1, ["rejected", "exhausted", "pending"])
    assert candidates.underfill(60, 3, 200, 1, 200, ("unprojected",)) == ["rejected", "capped", "unprojected"]


def test_lexical_needs_a_word(spark):
    with pytest.raises(EngineError):
        candidates.lexical(spark.createDataFrame([], "id long, term string, positions array<int>"), ["id"], '-x ""')


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = candidates.nearest(df, df.filter("vec_id < 3"), 5).collect()
    w = v.astype(float)
    cos = w @ w.T / np.outer(np.linalg.norm(w, axis=1), np.linalg.norm(w, axis=1))
    for q in range(3):
        want = [i for i in sorted(range(60), key=lambda i: (-round(cos[q, i], 9), i)) if i != q][:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.position)] == want
    with pytest.raises(EngineError):
        candidates.nearest(df, df, 5, max_queries=10)


def test_nearest_takes_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "VECTOR_ROWS", 300)
    rng = np.random.default_rng(2)
    w = np.round(rng.normal(size=(1100, 4)), 1) + 0.01
    w[100:400] = w[0]  # many equal ones: the ids decide
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in candidates.nearest(df, df, 5).collect():
        got.setdefault(r.query_id, {})[r.position] = r.vec_id
    cos = np.round(w @ w.T / np.outer(np.linalg.norm(w, axis=1), np.linalg.norm(w, axis=1)), 9)
    assert len(got) == 1100
    for q in range(1100):
        assert [got[q][p] for p in range(1, 6)] == [i for i in np.lexsort((np.arange(1100), -cos[q])) if i != q][:5]


def test_every_20th_vector_is_a_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(90, 8)))], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = retrievals.vector_topk_every_20th(spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == {0, 20, 40, 60, 80} and len(got) == 50


def test_fusion(spark):
    lists = [(0, "a", 1), (0, "b", 2), (0, "a", 3), (1, "b", 1), (1, "c", 2), (1, "d", 3), (0, "d", 4)]
    got = candidates.fused(spark.createDataFrame(lists, "list int, ref_id string, position int")).collect()
    score = {"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62, "d": 1 / 63 + 1 / 63}
    assert [r.ref_id for r in got] == sorted(score, key=lambda k: -score[k]) and all(math.isclose(r.score, score[r.ref_id]) for r in got)


def test_relevance(spark):
    rows = [("q", 1, 0), ("q", 2, 2), ("q", 3, 1), ("q", 12, 1), ("none", 1, 0)]
    got = {r.query_id: r for r in candidates.relevance(spark.createDataFrame(rows, "query_id string, position int, grade int")).collect()}
    dcg = 3 / math.log2(3) + 1 / math.log2(4)
    idcg = 3 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert math.isclose(got["q"].ndcg, dcg / idcg) and math.isclose(got["q"].recall, 2 / 3) and got["q"].precision == 0.2 and got["q"].mrr == 0.5
    assert tuple(got["none"])[1:] == (0, 0, 0, 0) and candidates.nearest_rank([3, 1, 2, 4], 50) == 2


def test_underfill():
    assert candidates.underfill(5, 5, 20, 0, 20) == [] and candidates.underfill(5, 3, 20, 2, 20) == ["rejected", "bounded"] and candidates.underfill(5, 3, 4, 0, 20) == ["exhausted"]


def hit(ref, start, text):
    return {"ref_id": ref, "field": "f", "start": start, "end": start + len(text), "text": text}


def test_bundle_is_packed_from_whole_texts(spark, tmp_path):
    texts = {i: " ".join(f"d{i}w{j}" for j in range(n)) for i, n in enumerate((900, 30, 20))}
    rows = [(i, t, "en", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = retrievals.bundle_pack(spark, str(tmp_path)).collect()
    best = [r.ref_id for r in candidates.fused(retrievals._lists(spark, str(tmp_path)), 10).collect()]
    hits = [{"ref_id": i, "field": "text", "start": a, "end": b, "text": texts[i][a:b]} for i in best for a, b in chunk.spans(texts[i])]
    want = bundle.assemble(hits[:50], 4096)
    assert len(out) == 1 and tuple(out[0]) == (want["context"], want["bytes"], len(want["excerpts"]), want["truncated"])
    assert "d0w400" in out[0].context
    none = bundle.packed(spark.range(2).toDF("request"), spark.createDataFrame([], "request long, rank int, ref_id long, field string, start long, end long, text string"), "request", 4096)
    assert {tuple(r)[2:] for r in none.collect()} == {(len(bundle.assemble([], 4096)["context"]), 0, False)}


def test_bundles_merge_cut_and_frame():
    whole = "".join(chr(97 + i % 26) for i in range(300))
    parts = [hit("x", 100, whole[100:200]), hit("y", 0, "<b>&"), hit("x", 0, whole[:100]), hit("x", 150, whole[150:260])]
    assert [(h["ref_id"], h["start"], h["end"], h["text"]) for h in bundle.merged(parts)] == [("x", 0, 260, whole[:260]), ("y", 0, 4, "<b>&")]
    out = bundle.assemble(parts, 4096)
    assert "&lt;b&gt;&amp;" in out["context"] and not out["truncated"] and out["complete"] is False
    cut = bundle.assemble([hit("x", 0, "word " * 1000), hit("y", 0, "after")], 1024)
    assert cut["bytes"] <= 1024 and cut["truncated"] and [e["ref_id"] for e in cut["excerpts"]] == ["x"] and cut["context"].count("<excerpt") == 1
    with pytest.raises(EngineError):
        bundle.assemble([], 100)


def test_bundles_merge_ranges_in_any_order():
    whole = "".join(chr(97 + i * 7 % 26) for i in range(400))
    part = lambda a, b: hit("x", a, whole[a:b])
    for ranges in ([(0, 100), (150, 250), (90, 160)], [(300, 400), (0, 100), (150, 250), (90, 310)], [(0, 50), (50, 60), (200, 210)], [(10, 20), (0, 40), (30, 35)], [(0, 1), (2, 3), (4, 5), (1, 2), (3, 4)]):
        held = [any(a <= i < b for a, b in ranges) for i in range(401)]
        starts = [i for i in range(401) if held[i] and not (i and held[i - 1])]
        want = [(a, a + next(n for n in range(401) if not held[a + n])) for a in starts]
        for order in itertools.permutations(ranges):
            got = bundle.merged([hit("y", 0, "other"), *[part(*r) for r in order]])
            assert got[0]["ref_id"] == "y" and sorted((h["start"], h["end"]) for h in got[1:]) == want
            assert all(h["text"] == whole[h["start"] : h["end"]] for h in got[1:])
            first = lambda h: next(k for k, (a, b) in enumerate(order) if h["start"] <= a and b <= h["end"])  # noqa: B023, E731
            assert [first(h) for h in got[1:]] == sorted(first(h) for h in got[1:])


def test_a_rewritten_table_is_indexed_anew(spark, tmp_path):
    docs = lambda text: spark.createDataFrame([(1, text, "en", 3), (2, "the other", "en", 9)], "doc_id long, text string, lang string, n_chars long")
    docs("of the old").write.parquet(f"{tmp_path}/documents.parquet")
    found = lambda: sorted(r.doc_id for r in candidates.lexical(retrievals._index(spark, str(tmp_path)), ["doc_id"], "old").collect())
    assert found() == [1]
    docs("of the new").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert found() == []


@pytest.mark.parametrize("kind", ["clustered", "table"])
def test_recall_of_the_vector_index(spark, tmp_path, kind):
    """Ten nearest of every twentieth row against all rows."""
    if kind == "table":
        rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
        lists, probes = retrievals._LISTS, retrievals._PROBES
    else:
        rng = np.random.default_rng(4)
        centres = rng.normal(size=(40, 24))
        v = centres[rng.integers(0, 40, 3000)] + rng.normal(scale=0.35, size=(3000, 24))
        v[:1000] = centres[0] + rng.normal(scale=0.35, size=(1000, 24))  # a third of all in one list
        rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5020, [0.0] * 24), (5040, [1.0])], "vec_id long, embedding array<double>")
        lists, probes = 24, 4
    asked = rows.filter("vec_id % 20 = 0")
    index = vector_index.build(rows, f"file://{tmp_path}/{kind}", lists, sample=1500)
    got = index.nearest(asked, 10, "vec_id", "embedding", probes).collect()
    exact = candidates.nearest(rows, asked, 10).filter("score IS NOT NULL").collect()
    want = {(r.query_id, r.vec_id): (r.score, r.position) for r in exact}
    scored = {(r.query_id, r.vec_id): r.score for r in got}
    recall = len(set(want) & set(scored)) / len(want)
    print(f"recall at 10, {kind}: {recall:.3f} over {len({q for q, _ in want})} queries, {probes} of {lists} lists")
    assert recall >= 0.9 and all(math.isclose(scored[x], want[x][0], abs_tol=1e-8) for x in set(want) & set(scored))
    # Every vector that has a direction is listed, and looking into all lists is exact.
    listed = spark.read.parquet(index.folder)
    assert listed.count() == rows.filter("embedding IS NOT NULL AND vec_id NOT IN (5000, 5020, 5040)").count()
    if kind == "clustered":
        few = asked.filter("vec_id < 200")
        whole = index.nearest(few, 10, "vec_id", "embedding", lists).select("query_id", "vec_id", "position").collect()
        assert sorted(map(tuple, whole)) == sorted((q, v, p) for (q, v), (_, p) in want.items() if q < 200)
        vector_index.save(spark, index, f"file://{tmp_path}/centroids")
        again = vector_index.load(spark, index.folder, f"file://{tmp_path}/centroids")
        assert np.allclose(again.at, index.at)


#: Words and stems by the published rules, each for a rule of its own.
STEMS = {
    "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "us": "us", "agreed": "agre", "feed": "feed", "hopping": "hop", "hoping": "hope", "luxuriated": "luxuri", "troubling": "troubl",
    "sized": "size", "bled": "bled", "sing": "sing", "cry": "cri", "by": "by", "say": "say", "relational": "relat", "conditional": "condit", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "vietnamization": "vietnam", "predication": "predic",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "analogi": "analog", "happily": "happili", "triplicate": "triplic",
    "formative": "format", "formalize": "formal", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt",
    "communism": "communism", "activate": "activ", "effective": "effect", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generate": "generat", "general": "general", "arsenal": "arsenal", "skies": "sky", "dying": "die", "news": "news", "inning": "inning",
    "proceeds": "proceed", "youth": "youth", "boyish": "boyish", "knackeries": "knackeri", "consolations": "consol", "consisting": "consist", "consistency": "consist", "knightly": "knight", "geology": "geolog", "fluently": "fluentli",
}


def test_stems_by_their_rules():
    assert {w: configurations.stem(w) for w in STEMS} == STEMS


def test_a_configuration_reduces_texts_and_queries(spark, tmp_path):
    texts = {1: "Repairs of the bridge were finished", 2: "the bridge repairing", 3: "A bridge and its repair", 4: "bridges repaired", 5: "repaired the bridges", 6: "nothing of this"}
    chunks = spark.createDataFrame(list(texts.items()), "k int, content string")
    candidates.write_index(chunks, ["k"], f"file://{tmp_path}/en", configuration="english")
    candidates.write_index(chunks, ["k"], f"file://{tmp_path}/simple")
    en, simple = (candidates.read_index(spark, f"file://{tmp_path}/{x}") for x in ("en", "simple"))
    found = lambda q, index=en, c="english": sorted(r.k for r in candidates.lexical(index, ["k"], q, c).collect())
    assert found("repairing bridges") == [1, 2, 3, 4, 5] and found("repairing bridges", simple, "simple") == []
    # Stop words keep their place: "repair of the bridge" is two words three apart.
    assert found('"repair of the bridge"') == [1] and found('"repaired a bridge"') == [5] and found('"bridge repair"') == [2, 4]
    assert found("the of this") == [] and found("bridge -finishing") == [2, 3, 4, 5] and found("of or finish") == [1]
    held = {(r.k, r.term): list(r.positions) for r in en.collect()}
    assert held[1, "repair"] == [0] and (1, "the") not in held and held[3, "repair"] == [4]
    with pytest.raises(EngineError):
        candidates.write_index(chunks, ["k"], f"file://{tmp_path}/no", configuration="klingon")


REFUSED = {
    "count": [
        "How many loans are late?", "count the broken sensors", "number of greenhouses in the valley", "What is the TOTAL rent?", "how much do we owe the nursery", "the quantity of seed", "how often did the pump stop", "how-many seedlings",
        "how_many seedlings", "how\u200bmany seedlings", "c\u00adount the plots", "\uff48\uff4f\uff57 \uff4d\uff41\uff4e\uff59 plots", "how\nmany plots", "What is the size of the seed bank?", "Why did rents rise, and how many loans are late?", "What is the sum?",
    ],
    "status": [
        "status of the dam", "Is the fence mended?", "Please, is loan nine repaid?", "find out whether the gardener signed", "plots still vacant", "Which loans have been repaid?", "show me the unpaid bills", "has the seed arrived", "Isn\u2019t the well fixed?",
        "Will the frost end on Monday?", "tell me if the pump works", "Whose applications got rejected", "which greenhouse is closed", "give me the overall progress", "loan nine paid?", "any update on the well", "Confirm the rent was paid", "bills not paid", "unpaid",
        "How is the harvest going?", "when will the rain come", "loan nine: paid", "the rent, paid or not", "Summarize which loans were repaid", "Describe the unpaid bills", "\u0130S THE RENT PA\u0130D", "Lantern talk: was it approved", "Can you check if the gate is shut",
    ],
    "completeness": [
        "Are there any other gardens?", "list the tenants", "the rest of the tenants", "give me every tenant", "complete list of gardens", "enumerate all plots", "Is there anything else about the frost?", "Name each tenant", "please itemize the repairs", "what else did the gardener record",
        "Describe every tenant", "list\ufeff all tenants", "bills outstanding", "items left", "tenant list", "Summarize the frost notes and list the tenants", "frost notes\n- list the tenants", "frost notes / list the tenants", "Summarize the notes then list the tenants",
        "First list the tenants", "Summarize the notes \u2192 enumerate the tenants", "Summarize the notes list the tenants",
    ],
    "unrecognized": [
        "???", "please", "tell me about", "Summarize everything", "why not", "Give me the tenants", "What broke?", "Show me the tenants", "What did the board approve?", "Who handles the permits?", "Where is the seed log?", "Rattle off tenants", "Quantify the backlog",
        "I need the tenants", "What happened to the seed?", "Walk me through the tenants", "Summarize the notes and also give me the tenants", "Summarize the notes while you fetch the tenants", "information on", "Explain it to me", "\u200b", "=>", "frost notes give me the tenants",
        "the tenants?", "storms and so on", "Present the tenants", "Compile tenant names", "Describe the frost so you can see the tenants",
    ],
}
SERVED = [
    "garden frost", "Why was the gate left open in March?", "Summarize the dam repair discussion", "What did the gardener write about the frost?", "Find notes about the old well", "tell me about the head gardener", "everything about mulch", "Can you summarize the seed log?",
    "Describe how the fence was mended", "How does the pump mechanism work?", "what the gardener said about mulch", "Who reviewed the seed log?", "Give me an overview of the water treaty", "Explain why the pump failed, then outline the repair", "a shopping list for the garden",
    "compare frost and drought", "- garden frost\n- rain gauge", "What happened during the flood?", "Do you have notes about drought?", "briefly describe the flood", "notes on the frost before the flood", "Caf\u00e9 notes about the garden", "Summarize the overdue bill", "loan nine",
]


def test_classifier_fails_closed(spark):
    asked = [(k, x) for k, xs in REFUSED.items() for x in xs] + [("served", x) for x in SERVED]
    assert [(k, x, requests.classify(x)) for k, x in asked if (requests.classify(x) == "served") != (k == "served")] == []
    exact = [(k, x) for k, x in asked if k in ("count", "served")]
    assert [(k, x, requests.classify(x)) for k, x in exact if requests.classify(x) != k] == []
    # What does not look like a form that is known is refused.
    for x in ("Frobnicate the tenants", "Which gardener waters the roses?", "we mended the fence"):
        assert requests.classify(x) != "served", x
    df = spark.createDataFrame([*asked, ("unrecognized", None), ("unrecognized", "")], "k string, x string")
    got = df.select("x", requests.classified(F.col("x")).alias("got")).collect()
    assert [r.got for r in got] == [requests.classify(r.x) for r in got]


@given(st.text(max_size=60))
def test_classifier_takes_any_text(text):
    assert requests.classify(text) in ("served", "count", "status", "completeness", "unrecognized")


def test_generations(spark):
    gens = [generations.Generation(1, "active"), generations.Generation(2, "verifying")]
    assert [g.state for g in generations.activate(gens, 2)] == ["standby", "active"]
    with pytest.raises(EngineError):
        generations.Generation(1, "retired").to("active")
    rows = [("a", 1, False, None), ("a", 3, False, 1), ("a", 3, False, 2), ("b", 2, True, None), ("b", 5, False, None)]
    got = {r.k: (r.revision, r.extraction) for r in generations.applied(spark.createDataFrame(rows, "k string, revision long, deleted boolean, extraction long"), ["k"]).collect()}
    assert got == {"a": (3, 2), "b": (2, None)}
