"""The pipeline: each stage's decisions on its own input, and the whole."""

import random

import pytest
from test_llm import base_spans, components, edited, plain_ids, plain_leaks, plain_toxicity, prose

import corpus_pipeline
from siltstone.llm import decontamination, ngram_join, secret_scan, sentencepiece_codec, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "sentencepiece"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).cache()
        assert out.columns == docs.columns and out.schema == docs.schema, name
        before, after = ids(kept), ids(out)
        if name == "toxicity":
            model = toxicity.fit(kept, labels)
            want = {r.doc_id for r in toxicity.score(kept, model).filter("score < 0.5").collect()}
        elif name == "near_duplicates":
            want = {r.doc_id for r in ngram_join.ngram_components(kept).filter("component_id = doc_id").collect()}
        elif name == "decontamination":
            want = before - ids(decontamination.contamination(kept, bench))
        else:
            want = before
            assert {r.doc_id: r.text for r in out.collect()} == {r.doc_id: secret_scan.masked(r.text) for r in kept.collect()}
        assert after == want, name
        kept = out
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert ids(last) == ids(kept)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, last.collect()))


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, maybe string, rejected boolean, _rejected int, score string, bloom_hash long, sentences string, n int, a long, sig string"


def store(spark, folder, rows, labels, items):
    """A folder of the pipeline's tables; the documents have columns that the operators' own might clash with."""
    docs = [(i, t, None if k % 3 else "en", None, None if t is None else len(t), "m", None, 7, "s", k, None, k, k, None) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, CLASHES).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_the_whole_against_plain_versions_of_all_stages(spark, tmp_path):
    rng = random.Random(31)
    items = [(k, prose(rng, rng.choice([12, 30, 60]), 150)) for k in range(8)] + [(9, None), (10, "")]
    rows = []
    for i in range(240):
        text = prose(rng, rng.randrange(20, 90), 2000)
        if i % 6 == 0:
            text += " you vileword thing."
        if i % 9 == 4:
            text = prose(rng, 30, 2000) + " " + items[i % 8][1] + " " + prose(rng, 30, 2000)
        if i % 7 == 3:
            text += f' password = "{"abcXYZ"[i % 6] * 9}" {"deadbeef" * 5}'
        if i % 5 == 1 and rows and rows[-1][1]:
            text = edited(rng, rows[-1][1], 1)
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, " \n"), (None, "a text without an id that nothing else is like at all"), rows[10], rows[10], (503, "ü" * 3000), (504, rows[12][1])]
    labels = [(i, 1, int("vileword" in t)) for i, t in rows[:240]] + [(None, 1, 1), (3, None, None)]
    folder = store(spark, str(tmp_path / "sf"), rows, labels, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    # Each stage by hand, on what the one before kept.
    model, left = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")), list(rows)
    want = [[(i, t) for i, t in left if plain_toxicity(model, t or "", 2)[0] < 0.5]]
    assert {i for i, t in rows if t and "vileword" in t} == {i for i, t in rows} - {i for i, t in want[0]}
    known = sorted({(i, t) for i, t in want[0] if i is not None})
    sizes, roots = components([t for _, t in known])
    first = {}
    for (i, _), r in zip(known, roots, strict=True):
        first[i] = min(known[r][0], first.get(i, known[r][0]))
    want.append([(i, t) for i, t in want[0] if i is None or first[i] == i])
    leaks = {d for d, _ in plain_leaks({k: t for k, t in items if t}, [t for _, t in want[1]])}
    want.append([x for k, x in enumerate(want[1]) if k not in leaks])
    masked = []
    for i, t in want[2]:
        out, done = "", 0
        for a, _, b in base_spans(t or ""):
            out, done = (out + t[done:a] + secret_scan.MASK, b) if a >= done else (out, max(done, b))
        masked.append((i, None if t is None else out + t[done:]))
    want.append(masked)
    kept, key = docs, lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    for (name, stage), rows_ in zip(corpus_pipeline.STAGES[:-1], want, strict=False):
        kept = stage(spark, kept, folder).cache()
        assert kept.schema == docs.schema and sorted([(r.doc_id, r.text) for r in kept.collect()], key=key) == sorted(rows_, key=key), name
    assert len(want[0]) > len(want[1]) > len(want[2]) > 50 and want[3] != want[2] and {500, 501, 502, None, 503} <= {i for i, _ in want[3]}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.collect())
    vocab = sentencepiece_codec.Vocabulary.load()
    ids = sorted([(i, plain_ids(vocab, t or "")) for i, t in want[3] if i is not None])
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and sorted([(r.doc_id, r.ids) for r in got.collect() if r.doc_id is not None]) == ids


def test_empty_tables_go_through(spark, tmp_path):
    folder = store(spark, str(tmp_path / "none"), [], [], [])
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, folder)
        assert out.schema == kept.schema and out.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
    some = store(spark, str(tmp_path / "some"), [(1, "a b c d e f"), (2, None)], [], [])
    assert corpus_pipeline.run(spark, some).count() == 2


@pytest.mark.parametrize("name", ["op2_ngram_jaccard", "op5_warc", "op7_url_filter"])
def test_queries_against_sql(spark, name):
    import duckdb

    from siltstone.llm import queries

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.queries()[name](spark, SF)
    mine = {tuple(r[k] for k in sorted(out.columns)) for r in out.collect()}
    cursor = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(out.columns)
    assert mine == {tuple(dict(zip(columns, r, strict=True))[k] for k in sorted(columns)) for r in cursor.fetchall()}
