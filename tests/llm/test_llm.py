"""The training-data operators against brute force, and on the cases that no table has."""

import base64
import collections
import hashlib
import json
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chunks, decontamination, kernel, lz_fingerprint, ngram_join, packing, secret_scan, sentencepiece_codec, shared, token_counts, toxicity, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def documents(spark, texts):
    """Texts, a null and an empty one, with a column whose name clashes with results."""
    rows = [(i, t, None, "s", None if t is None else len(t), 0.5) for i, t in enumerate([None, "", *texts])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice(["the", "of", f"w{rng.randrange(vocabulary)}", f"w{rng.randrange(vocabulary)}é"]) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


def doubled():
    """Two words of 1,024 letters that a polynomial modulo 2**64 does not tell apart, whatever its odd base."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    return a, b


def test_hashes_of_doubling_patterns_differ(spark):
    a, b = doubled()
    raw = f"{a} {b} {a} x{b} {a[:8]} {a[:9]} {a[:8]}\x00".encode()
    buf = np.frombuffer(raw, np.uint8)
    starts, ends = kernel.tokens(buf, np.array([0, len(buf)]))
    words = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
    h = kernel.hashes(buf, starts, ends).tolist()
    assert len(set(h)) == len(set(words)) and h[0] == h[2]
    df = documents(spark, [a, b, a + " " + b, b + " " + a])
    texts = {r.doc_id: r.text for r in df.collect()}
    assert len({tuple(r.ids) for r in sentencepiece_codec.encoded(df).collect()}) == 5 and all(r.round_trip for r in sentencepiece_codec.encoded(df).collect())
    vocab = sentencepiece_codec.Vocabulary.load()
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()} == {i: len(plain_ids(vocab, t or "")) for i, t in texts.items()}
    rows = packing.packed(df)
    encoding = packing.Ranks.load().open()
    assert {(r.doc_id, encoding.decode(np.frombuffer(bytes(r.ids), "<u2").tolist())) for r in packing.unpacked(rows).collect()} == {(i, t) for i, t in texts.items() if t}
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(df).collect()} == {i: i for i in texts}
    bench = spark.createDataFrame([(1, "Is it so? " + a), (2, "Is it so? " + b)], "item_id long, text string")
    asked = documents(spark, ["Is it so? " + a, "Is it so? " + b])
    assert {(r.doc_id, r.item_id) for r in decontamination.contamination(asked, bench).collect()} == {(2, 1), (3, 2)}


def test_chunks_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    raw = b"one two one six two ones"
    buf = np.frombuffer(raw, np.uint8)
    starts, ends = kernel.tokens(buf, np.array([0, len(buf)]))
    want = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
    for hashed in (kernel.hashes, lambda b, s, e: np.zeros(len(s), np.uint64), lambda b, s, e: (e - s).astype(np.uint64)):
        monkeypatch.setattr(kernel, "hashes", hashed)
        sample, number = chunks.unique(buf, starts, ends)
        assert [want[sample[k]] for k in number] == want and len(sample) == len(set(want))


# -- 1 ---------------------------------------------------------------------------------------------------


def base_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def field(tag, content):
    size = len(content)
    head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + content


def keys():
    rng = random.Random(5)
    number = lambda n: field(2, b"\x01" + rng.randbytes(n))
    rsa = field(0x30, field(2, b"\0") + b"".join(number(n) for n in (64, 3, 64, 32, 32, 32, 32, 32)))
    sec1 = field(0x30, field(2, b"\1") + field(4, rng.randbytes(32)) + field(0xA0, field(6, b"\x2a\x86\x48")))
    pkcs8 = field(0x30, field(2, b"\0") + field(0x30, field(6, b"\x2b\x65\x70")) + field(4, field(4, rng.randbytes(32))))
    text = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + text(b"none") + text(b"none") + text(b"") + (1).to_bytes(4, "big") + text(rng.randbytes(51)) + text(rng.randbytes(136))
    return {"rsa": rsa, "sec1": sec1, "pkcs8": pkcs8, "ssh": ssh}


def token():
    part = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    return ".".join([part(json.dumps({"alg": "HS256"}).encode()), part(b'{"sub":"1"}'), part(random.Random(1).randbytes(32))])


def test_secrets_confirm_structure():
    for name, der in keys().items():
        coded = base64.b64encode(der).decode()
        pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(coded[i : i + 64] for i in range(0, len(coded), 64)) + "\n-----END PRIVATE KEY-----"
        for text in (f"é {coded} x", pem, base64.b64encode(pem.encode()).decode(), der.hex() if name != "ssh" else coded):
            found = [s for s in secret_scan.find_spans(text) if s[2] == "private_key"]
            assert len(found) == 1, (name, text[:40])
        assert text[found[0][0] :][:2] in ("30", coded[:2])
        # One length that does not fit, and it is none.
        broken = base64.b64encode(der[:-1]).decode() if name != "ssh" else base64.b64encode(der[:-5]).decode()
        assert not [s for s in secret_scan.find_spans(broken) if s[2] == "private_key"]
    assert [s[2] for s in secret_scan.find_spans(f"Bearer {token()}.")] == ["signed_token"]
    head, body, sign = token().split(".")
    for bad in (f"{head}.{body}.", f"eyJhbGci.{body}.{sign}", f"{base64.urlsafe_b64encode(b'[1,2,3,4,5]').decode()}.{body}.{sign}"):
        assert not [s for s in secret_scan.find_spans(bad) if s[2] == "signed_token"]


def test_keys_end_where_they_say():
    found = lambda text: [text[a:b] for a, b, k in secret_scan.find_spans(text) if k == "private_key"]
    for der in keys().values():
        coded = base64.b64encode(der).decode()
        lines = [coded[i : i + 64] for i in range(0, len(coded), 64)]
        for gap in ("\n", "\n      ", "\r\n\t", r"\n", r"\r\n"):
            body = gap.join(lines)
            pem = f"-----BEGIN PRIVATE KEY-----{gap}{body}{gap}-----END PRIVATE KEY-----"
            assert found(pem) == [body], gap
            assert found(f"x {body}{gap}Thanks{gap}MAny{'a' * 30}{gap}") == [body], gap
            assert found(f"MA{'a' * 40}{gap}{body}") == [body], gap
        pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END PRIVATE KEY-----\n"
        again = base64.b64encode(pem.encode()).decode()
        assert found(f"{again}\nThanks\nall") == [again]
        for hexed in (der.hex(), der.hex().upper(), pem.encode().hex(), "\n".join(der.hex()[i : i + 60] for i in range(0, 2 * len(der), 60))):
            assert found(f"key: {hexed}\ndead\nbeef") == [hexed]
        assert not found(der[:-5].hex()) and not found(coded[:-12] + "\nThanks")
    ed25519 = field(0x30, field(2, b"\0") + field(0x30, field(6, b"\x2b\x65\x70")) + field(4, field(4, b"\7" * 32)))
    assert len(ed25519) == 48 and found(base64.b64encode(ed25519).decode() + "\nThanks") == [base64.b64encode(ed25519).decode()]
    text = f"eyABCDEFGH.{token()}"
    assert [text[a:b] for a, b, k in secret_scan.find_spans(text) if k == "signed_token"] == [token()]


def test_tokens_begin_anywhere():
    found = lambda text: [text[a:b] for a, b, k in secret_scan.find_spans(text) if k == "signed_token"]
    for before in ("apikey-", "they_", "é", "x.", "a.b.", "eyJ", "eyJhbGciOiJIUzI1NiJ9."):
        for after in ("", ".", " ", ".more.parts", "é"):
            got = found(before + token() + after)
            assert got and token() in got[0] if before == "eyJhbGciOiJIUzI1NiJ9." else got == [token()], (before, after)
    assert found(f"{token()} {token()}.{token()}") == [token()] * 3
    assert found("." + token().replace(".", "..")) == []


def test_secret_scan_takes_linear_time():
    import time

    coded = base64.b64encode(keys()["ssh"]).decode()
    for unit in ("ey", "eyJ", "eyJ.", "eyJhbGciOi.eyJ.", "b3BlbnNzaC1rZXktdjE" + "A" * 20 + "\n", "LS0tLS1CRUdJTi" + "A" * 26 + "\n", "MIIE" + "A" * 30 + "\n", "token = ", "3082" * 8 + "\n", coded[:40] + "\\n"):
        took = []
        for size in (10_000, 80_000):
            text = unit * (size // len(unit))
            began = time.process_time()
            secret_scan.find_spans(text)
            took.append(time.process_time() - began)
        assert took[1] < 24 * took[0] + 0.5, (unit, took)


def test_secrets_against_brute_force(spark):
    rng = random.Random(2)
    bits = ["token", "SECRET", "ſecret", "toKen", "api_key", "apikey", "passwd", '"', "'", " ", ":", "=", "AKIA", "ABCD1234", "deadbeef" * 4, "0f" * 15, "é", "\n", "abc", "Xy9+/_.-", "token=apikey= abcdefghij"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ["a" * 200_000, f"token = {token()}"]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in secret_scan.secrets(df).collect()}
    for i, text in enumerate([None, "", *texts]):
        want = base_spans(text or "")
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        spelt = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(spelt.encode()).hexdigest()
        assert ",".join(x for x in got[i].spans.split(",") if x.split(":")[0] in secret_scan.BASE) == spelt
    assert secret_scan.secrets(empty(spark)).count() == 0
    masked = {r.doc_id: r for r in secret_scan.mask_secrets(df).collect()}
    assert len(masked) == len(texts) + 2 and masked[0].text is None and not any(secret_scan.find_spans(r.text) for r in masked.values() if r.text and "token" not in r.text.lower() and "secret" not in r.text.lower())
    assert masked[len(texts) + 1].text == secret_scan.MASK and masked[len(texts) + 1].n_chars == len(secret_scan.MASK)


# -- 2 ---------------------------------------------------------------------------------------------------


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        k = rng.randrange(len(words))
        words[k : k + rng.randrange(2)] = [f"new{rng.randrange(10**6)}"] * rng.randrange(2)
    return " ".join(words)


def test_join_against_brute_force(spark):
    rng = random.Random(11)
    passage = prose(rng, 70)
    texts = ["one two", "One  TWO\n", "one two three", "a b c d e", "A b c d e f", "a\x00b", "é É", "É é", "   \n"]
    for size in (6, 9, 20, 40, 63, 64, 70, 86, 120, 200, 400, 1500):
        for _ in range(3):
            base = prose(rng, size)
            texts += [base, base.upper() if "é" not in base else base]
            for share in (0.005, 0.01, 0.02, 0.04, 0.06, 0.1):
                texts.append(edited(rng, base, max(1, int(size * share))))
            texts += [base + " " + prose(rng, max(1, size // 4)), base + " " + prose(rng, max(1, size // 3)), " ".join(base.split(" ")[: max(1, size * 3 // 4)])]
    texts += [passage + " " + prose(rng, n) for n in (10, 20, 30, 80, 200)] * 2 + [passage]
    hub = prose(rng, 300)
    texts += [edited(rng, hub, rng.randrange(1, 14)) for _ in range(60)] + [hub] + [prose(rng, 25_000)]
    df = documents(spark, texts)
    sizes, comps = components([None, "", *texts])
    got = {r.doc_id: r for r in ngram_join.ngram_components(df).collect()}
    assert {i: got[i].n_shingles for i in got} == dict(enumerate(sizes))
    assert {i: (got[i].component_id, i) for i in got if got[i].component_id != comps[i]} == {}
    kept = {r.doc_id for r in ngram_join.keep_one(df).select("doc_id").collect()}
    assert kept == {i for i in got if comps[i] == i}


def test_recall_of_a_twentieth_against_all_rows(spark):
    """Links of every document whose id is divisible by 20 with all others, by an inverted index in plain Python."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets, held = {r.doc_id: shingle_set(r.text) for r in rows}, collections.defaultdict(list)
    for i, grams in sets.items():
        for g in grams:
            held[g].append(i)
    links = set()
    for q in (i for i in sets if i % 20 == 0):
        shared = collections.Counter(j for g in sets[q] for j in held[g] if j != q)
        links |= {(q, j) for j, c in shared.items() if 100 * c >= 75 * (len(sets[q]) + len(sets[j]) - c)}
    part = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    found = sum(part[a] == part[b] for a, b in links)
    print(f"recall {found / len(links):.4f} of {len(links)} links")
    assert links and found == len(links)


def test_join_of_odd_tables(spark):
    assert ngram_join.ngram_components(empty(spark)).count() == 0
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "x y"), (2, "a b c d e")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 2, 2), (False, 2, 2), (False, 3, 2), (False, 3, 2), (True, 0, None)]
    # A text of an id that repeats is linked to by its own likes, whichever text of the id is seen first.
    rng = random.Random(3)
    a, b = prose(rng, 120), prose(rng, 150)
    for rows in ([(1, a), (1, b), (2, edited(rng, a, 2)), (3, edited(rng, b, 2))], [(1, a), (1, b), (0, b), (3, edited(rng, a, 2))], [(5, a), (4, b), (5, b), (6, a)]):
        out = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.component_id for r in out} == {min(i for i, _ in rows)}, rows[0][0]


def test_crowded_groups_go_the_other_exact_way(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    monkeypatch.setattr(ngram_join, "CROWD", 10)
    rng = random.Random(14)
    passage = prose(rng, 60)
    texts = []
    for n in (20, 25, 30, 60, 100):
        for _ in range(25):
            base = passage + " " + prose(rng, n, 3000)
            texts += [base] + [edited(rng, base, max(1, len(base.split()) // 40))] * rng.randrange(2)
    _, comps = components([None, "", *texts])
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(documents(spark, texts)).collect()}
    assert got == dict(enumerate(comps)) and len(set(comps)) > 100


def test_components_of_chains(spark):
    rng = random.Random(1)
    ids = list(range(200))
    rng.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(199) if i % 50 != 49] + [(5, 5)]
    got = {r.node: r.component for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: min(ids[i // 50 * 50 : i // 50 * 50 + 50]) for i, x in enumerate(ids)}
    assert got == want


def test_bloom_lets_no_key_slip(spark):
    listed = spark.range(0, 3000).selectExpr("concat('k', id) AS key")
    rows = spark.range(0, 60_000).selectExpr("concat('k', id) AS key", "id", "7 AS bloom_block", "8 AS bloom_hash", "9 AS bloom_w3")
    probed = shared.maybe_listed(rows, "key", shared.bloom(listed, "key"), "maybe")
    ids = [r.id for r in probed.filter("maybe").select("id").collect()]
    assert set(range(3000)) <= set(ids) and len(ids) < 4500 and probed.columns == [*rows.columns, "maybe"] and probed.filter("bloom_w3 = 9 AND bloom_block = 7").count() == 60_000
    assert {r.id for r in shared.without(spark.range(100), "id", spark.range(0, 100, 2).toDF("id")).collect()} == set(range(1, 100, 2))
    clashing = spark.range(100).selectExpr("id", "'x' AS maybe", "id AS bloom_hash", "null AS Bloom_W0")
    kept = shared.without(clashing, "id", spark.range(0, 100, 2).toDF("id"))
    assert kept.columns == clashing.columns and {tuple(r) for r in kept.collect()} == {(i, "x", i, None) for i in range(1, 100, 2)}


def test_too_many_keys_are_met_without_a_filter(spark, monkeypatch):
    monkeypatch.setattr(shared, "MAX_BLOCKS", 1)
    assert shared.bloom(spark.range(9), "id").table is None
    assert {r.id for r in shared.without(spark.range(100), "id", spark.range(0, 100, 2).toDF("id")).collect()} == set(range(1, 100, 2))
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/x"), (3, None)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filtered(pages, pages.filter("page_id = 2").select("url")).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow"}


def test_shared_folder_is_not_made_up_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    session = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(ValueError):
        shared.shared_folder(session)


# -- 3 ---------------------------------------------------------------------------------------------------


def plain_best_fit(sizes, length):
    rows, room = [], []
    for k, size in enumerate(sizes):
        fits = [r for r in range(len(rows)) if room[r] >= size]
        if fits:
            r = min(fits, key=lambda r: room[r])
            rows[r].append(k)
            room[r] -= size
        else:
            rows.append([k])
            room.append(length - size)
    return sorted(room)


@pytest.mark.parametrize("length", [7, 16, 100])
def test_best_fit_is_best_fit(length):
    rng = random.Random(length)
    sizes = sorted((rng.randrange(1, length + 1) for _ in range(400)), reverse=True)
    rows = packing.best_fit(sizes, length)
    assert sorted(k for r in rows for k in r) == list(range(400))
    assert sorted(length - sum(sizes[k] for k in r) for r in rows) == plain_best_fit(sizes, length)


def test_packing_is_lossless(spark, tmp_path):
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (1, 5, 60, 61, 300, 3000)] + ["a  b\n c  d  x 's 12 !? ", "   ", "　", "日本 語", "x" * 5000]
    df = documents(spark, texts).unionByName(documents(spark, ["other text"]))
    rows = packing.packed(df, length=64, shard_bytes=8000).cache()
    encoding, pad = packing.Ranks.load().open(), packing.Ranks.load().pad
    want = {(i, tuple(encoding.encode_ordinary(t))) for i, t in enumerate(["", "", *texts]) if t} | {(2, tuple(encoding.encode_ordinary("other text")))}
    assert {(r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u2").tolist())) for r in packing.unpacked(rows).collect()} == want
    for r in rows.collect():
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == pad).all()
        assert r.position_resets == r.cu_seqlens[:-1] + [r.n_tokens] * (r.n_tokens < 64) and len(r.doc_ids) == len(r.parts) == len(r.cu_seqlens) - 1
    files = packing.write_matrices(rows, f"file://{tmp_path}/m", 64).collect()
    assert sum(f.n_rows for f in files) == rows.count()
    one = files[0]
    matrix = np.fromfile(tmp_path / "m" / f"{one.shard:06d}.ids.bin", one.dtype).reshape(one.n_rows, one.length)
    first = rows.filter(F.col("shard") == one.shard).orderBy("row").first()
    assert matrix[0].tobytes() == bytes(first.ids)
    assert packing.packed(empty(spark)).count() == 0 and packing.waste(packing.packed(empty(spark))) == 0
    none = packing.packed(spark.createDataFrame([(None, "no id here"), (None, "no id here")], "doc_id long, text string"), length=64)
    assert none.count() == 1 and none.first().doc_ids == [None, None]


def test_a_shard_costs_no_more_than_a_row(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, many = (packing.packed(df, shard_bytes=b).select("shard", "n_tokens").cache() for b in (1 << 40, 300_000))
    print(f"padding: one run {packing.waste(one):.4%}, {many.select('shard').distinct().count()} shards {packing.waste(many):.4%}")
    assert one.count() <= many.count() <= one.count() + many.select("shard").distinct().count()


# -- 4, 6 ------------------------------------------------------------------------------------------------


def plain_viterbi(vocab, text):
    """Best cut of a text with marks for spaces: ends from the left, starts ascending, strictly better replaces."""
    score = {vocab.pieces[i]: vocab.scores[i] for i in vocab.normal}
    best = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - vocab.longest), end):
            piece = text[start:end]
            gain = score.get(piece, vocab.unknown_score if end - start == 1 else None)
            if gain is not None and (best[end] is None or best[start][0] + gain > best[end][0]):
                best[end] = (best[start][0] + gain, [*best[start][1], piece])
    return best[-1][1]


def plain_ids(vocab, text):
    number = {vocab.pieces[i]: i for i in vocab.normal}
    pieces = plain_viterbi(vocab, (" " + text).replace(" ", "▁")) if text else []
    return [i for p in pieces for i in ([number[p]] if p in number else [int(vocab.byte_ids[b]) for b in p.encode()])]


ODD = ["a", "  two  spaces ", "héllo\nwörld\n\n", "日本語 🙂🙂", "x" * 9000, "1234 token=\"24be64439e3e49cf\"", "\x00\x01", "%%% &&& end.", "́́"]


def test_encoding_against_plain_viterbi_and_back(spark):
    rng = random.Random(9)
    vocab = sentencepiece_codec.Vocabulary.load()
    texts = ODD + [prose(rng, n) for n in (3, 40, 200)] + ["".join(rng.choice("ab é\n▁thein.") for _ in range(300))]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in sentencepiece_codec.encoded(df).collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()}
    for i, t in enumerate([None, "", *texts]):
        assert got[i].ids == plain_ids(vocab, t or "") and got[i].n_tokens == len(got[i].ids) == counts[i], i
        assert got[i].round_trip == ("▁" not in (t or ""))
    back = {r.doc_id: r.text for r in sentencepiece_codec.decoded(sentencepiece_codec.encoded(df)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate([None, "", *texts]))
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sentencepiece_codec.decoded(nothing).collect()} == {1: None, 2: ""}
    # A very long text, and rows that repeat.
    long = documents(spark, [" ".join(ODD[:3] * 20_000)])
    twice = long.unionByName(long)
    whole = sentencepiece_codec.encoded(twice).collect()
    assert len(whole) == 6 and all(r.round_trip for r in whole) and max(r.n_tokens for r in whole) > 100_000
    assert sorted((r.doc_id, r.n_tokens) for r in whole) == sorted((r.doc_id, r.n_tokens) for r in token_counts.token_counts(twice).collect())
    assert sentencepiece_codec.encoded(empty(spark)).count() == token_counts.token_counts(empty(spark)).count() == 0


def test_encoding_is_the_librarys_best_lattice_path():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model

    m = model.ModelProto()
    with open(sentencepiece_codec.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    lattice = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    vocab, rng = sentencepiece_codec.Vocabulary.load(), random.Random(3)
    for _ in range(60):
        text = " ".join(rng.choice(["the", "of", "reading", "Otherwise", "tions", "it's", "zebra"]) for _ in range(4))
        best = lattice.nbest_encode(text, nbest_size=2)
        mine = plain_ids(vocab, text)
        total = lambda ids: sum(vocab.scores[i] for i in ids)
        assert mine == best[0] or total(mine) == total(best[0])


# -- 5 ---------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "x"), (2, "http://b/\r\nEvil: 1", "<p>é\r\n\r\nWARC/1.1</p>"), (3, None, "x"), (4, "u", None), (5, "u", ""), (6, "u", "x"), (7, "u", "y" * 300_000), (None, "u", "solo"), (None, "u", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = {(r.page_id, r.payload_digest): r for r in warc.archived(df, f"file://{tmp_path}/w", roll=1000).collect()}
    assert len(got) == len(pages)
    for page_id, _, html in pages:
        raw = (html or "").encode()
        r = got[page_id, base64.b32encode(hashlib.sha1(raw).digest()).decode()]
        chief = max((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
        assert r.payload_bytes == len(raw) and (r.record_type, r.refers_to) == (("response", None) if chief in (page_id, None) else ("revisit", chief))
    folder = tmp_path / "w" / "members"
    for side in folder.glob("*.idx.jsonl"):
        data = (folder / side.name.removesuffix(".idx.jsonl")).read_bytes()
        for e in map(json.loads, side.read_text().splitlines()):
            record = zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31)
            assert record.startswith(b"WARC/1.1\r\n") and warc.record_id(record) == e["record_id"]
        assert data == b"".join(data[e["offset"] : e["offset"] + e["length"]] for e in map(json.loads, side.read_text().splitlines()))
    more = df.selectExpr("*", "1 AS maybe", "'x' AS sha", "'y' AS chief", "0 AS payload_bytes", "'z' AS record_type")
    again = warc.archived(more, f"file://{tmp_path}/x", roll=1000).collect()
    assert sorted((str(r.page_id), r.payload_digest, r.payload_bytes, r.record_type) for r in again) == sorted((str(r.page_id), r.payload_digest, r.payload_bytes, r.record_type) for r in got.values())
    none = warc.archived(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert none.count() == 0


def test_normaliser_reads_any_chunking():
    import io

    records = [warc.record(i, "u", "z" * n, n, "D", "response", None, str(i)) for i, n in enumerate((0, 5, 70_000))]
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    one = whole.compress(b"".join(records)) + whole.flush()
    members = b"".join((lambda c, r: c.compress(r) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31), r) for r in records)
    for data in (one, members):
        for chunk in (1, 7, 1 << 20):
            assert list(warc.inflated_records(io.BytesIO(data), chunk)) == records
    with pytest.raises(ValueError):
        list(warc.inflated_records(io.BytesIO(zlib.compress(records[1][:-3], wbits=31))))


# -- 7 ---------------------------------------------------------------------------------------------------


def test_url_rules_and_list(spark):
    urls = {
        1: "http://www.Example.com/en/x", 2: "https://a.example.com/en/", 3: "http://example.com/de/?q#f", 4: "http://example.com", 5: "x.net/es/", 6: "ftp://b.net/es/1", 7: None, 8: "http://notexample.com.au/a.html?utm_source=x&b=2&a=1#z",
        9: "https://NOTexample.com.au:443/a/?a=1&b=2", 10: "http://É.net/fr/", 11: "http://net/fr/", 12: "http://www.www.example.com/en/y", 13: "http://q.org/a?x=http://r.com/", 14: "://", 15: "http://planet/fr/",
    }
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    listed = spark.createDataFrame([("http://www.notexample.com.au/a?b=2&a=1&ref=me",), (None,), ("http://q.org/a",), ("junk",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filtered(pages, listed).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("example.com", "/de/", "com/", "allow") and got[4] == ("example.com", "", None, "allow") and got[5] == got[7] == ("", "", None, "allow") and got[6] == ("b.net", "/es/1", "net/es/", "block")
    assert got[8][2:] == got[9][2:] == (None, "block") and got[10] == ("É.net", "/fr/", "net/fr/", "block") and got[11][2] == "net/fr/" and got[12][2] == "www.example.com/en/"
    assert got[13] == ("q.org", "/a", None, "allow") and got[14] == ("", "", None, "allow") and got[15] == ("planet", "/fr/", None, "allow")
    # Rows that repeat are judged each; other columns are not in the way.
    twice = pages.unionByName(pages).selectExpr("*", "'x' AS host", "1 AS maybe", "'y' AS verdict", "null AS canonical", "2 AS hit")
    assert sorted((r.page_id, r.verdict) for r in url_filter.filtered(twice, listed).collect()) == sorted([(i, x[3]) for i, x in got.items()] * 2)
    assert url_filter.filtered(pages.limit(0), listed).count() == 0 and url_filter.filtered(pages, listed.limit(0)).filter("rule IS NULL AND verdict = 'block'").count() == 0


# -- 8 ---------------------------------------------------------------------------------------------------


def plain_leaks(items, texts):
    """(text, item) by brute force: BM25 shares of every passage and every item, both overlaps on tuples of words."""
    bags = {key: re.findall(r"[a-z0-9\x80-\U0010ffff]+", items[key].translate(LOWER)) for key in items}
    bags = {key: b for key, b in bags.items() if b}
    n, mean = len(bags), sum(map(len, bags.values())) / max(1, len(bags))
    df = collections.Counter(w for b in bags.values() for w in set(b))
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    found = {}
    for key, bag in bags.items():
        weight = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(bag) / mean)) for w, c in collections.Counter(bag).items()}
        total, half = sum(weight.values()), 32
        while half < len(bag):
            half *= 2
        parts = []
        for part in decontamination.split_item(items[key]):
            w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", part.translate(LOWER))
            k = max(1, min(5, len(w)))
            parts.append((k, grams(w, k)))
        for d, text in enumerate(texts):
            words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOWER))
            for start in range(0, len(words), half):
                span = words[start : start + 2 * half]
                score = sum(w for x, w in weight.items() if x in set(span)) / total
                if score >= 0.5 - 1e-9 and all(len(g & grams(span, k)) * 2 >= len(g) for k, g in parts):
                    found[d, key] = max(found.get((d, key), 0), score)
    return found


def partial_leaks(rng, items, texts, vocabulary=120):
    out = []
    for _ in range(texts):
        part = items[rng.randrange(len(items))].split(" ")
        cut = rng.choice([len(part), len(part) * 3 // 4, len(part) // 2])
        at = rng.randrange(len(part) - cut + 1)
        out.append(prose(rng, 90, vocabulary) + " " + " ".join(part[at : at + cut]) + " " + prose(rng, 60, vocabulary))
    return out


def test_leaks_are_those_of_brute_force_whatever_the_shards(spark):
    rng = random.Random(6)
    items = [prose(rng, rng.choice([9, 20, 31, 33, 60, 64, 65, 90]), 120) for _ in range(41)] + ["one word?", "é", "Why so. Yes"]
    # An id that a third of the rows have, copies of one row, items without words.
    rows = [(i if i % 3 else 0, t) for i, t in enumerate(items)] + [(7, items[7])] * 5 + [(98, None), (99, "...")]
    texts = [*partial_leaks(rng, items, 80), items[5].upper().replace("É", "é"), items[10] + "\n" + items[11], " ".join(prose(rng, 400, 120) for _ in range(30)) + items[13]]
    df, bench = documents(spark, texts), spark.createDataFrame(rows, "item_id long, text string")
    keyed = {(i, t): t for i, t in {(i, t) for i, t in rows if t is not None}} | {(7, items[7], k): items[7] for k in range(5)}
    want = {}
    for (d, key), score in plain_leaks(keyed, [None, "", *texts]).items():
        want[d, key[0]] = max(want.get((d, key[0]), 0), score)
    assert len(want) > 30
    counts = set()
    for most in (1000, 12, 5):
        counts.add(len(decontamination.indexes(bench, max_items=most)))
        got = {(r.doc_id, r.item_id): r for r in decontamination.contamination(df, bench, max_items=most).collect()}
        assert got.keys() == want.keys() and all(got[k].score == pytest.approx(want[k]) for k in want), most
        assert all(min(r.question_overlap, r.answer_overlap) >= 0.5 for r in got.values())
        assert {r.doc_id for r in decontamination.keep_uncontaminated(df, bench, max_items=most).collect()} == set(range(len(texts) + 2)) - {d for d, _ in want}
    assert len(counts) == 3


def test_pivots_skip_blocks_but_no_item():
    rng = random.Random(16)
    items = [prose(rng, rng.randrange(8, 60), 900) for _ in range(300)]
    index = decontamination.Index.build(list(enumerate(items)), 0.5)
    visited = []
    searched = np.searchsorted
    for text in partial_leaks(rng, items, 20, 900):
        words = decontamination._of_text(text)
        passage = np.unique(np.flatnonzero(np.isin(index.terms, words[: 2 * index.half])))
        got = {(i, round(s, 9)) for _, i, s in index._wand(np.zeros(len(passage), np.int64), passage, 1)}
        at = searched(index.entry_at, np.arange(len(index.entry_block)), "right") - 1
        total = np.zeros(len(items))
        for e in np.flatnonzero(np.isin(at, passage)):
            a, b = index.posting_at[e], index.posting_at[e + 1]
            np.add.at(total, index.posting_item[a:b], index.posting_weight[a:b])
        assert got == {(int(i), round(float(total[i]), 9)) for i in np.flatnonzero(total >= 0.5 - 1e-9)}
        visited.append(len(got))
    assert sum(visited) >= 5


def test_leaks(spark):
    rng = random.Random(8)
    items = [prose(rng, 30, 300) for _ in range(20)]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "..."), (3, items[3])], "item_id long, text string")
    texts = [prose(rng, 200, 300) + "\n" + items[5].upper().replace("É", "é") + " " + prose(rng, 50, 300), prose(rng, 300, 300), items[7], items[3] + " " + items[4], prose(rng, 5, 10)]
    df = documents(spark, texts)
    got = {(r.doc_id, r.item_id) for r in decontamination.contamination(df, bench).collect()}
    assert got == {(2, 5), (4, 7), (5, 3), (5, 4)}
    assert {r.doc_id for r in decontamination.keep_uncontaminated(df, bench).collect()} == {0, 1, 3, 6}
    # Rows that repeat: each is searched, a pair is reported once, and all copies go.
    twice = df.unionByName(df)
    assert {(r.doc_id, r.item_id) for r in decontamination.contamination(twice, bench).collect()} == got and decontamination.keep_uncontaminated(twice, bench).count() == 8
    assert decontamination.contamination(empty(spark), bench).count() == 0 and decontamination.contamination(df, bench.limit(0)).count() == 0
    # A question alone is no leak: its answer must be there too.
    asked = "Which of the seven grey harbours froze over first in that long winter of the old calendar? Northern Quillhaven it was by all surviving accounts."
    one = spark.createDataFrame([(1, asked)], "item_id long, text string")
    texts = documents(spark, [asked, asked.split("?")[0] + "?", prose(rng, 40) + " " + asked])
    assert {r.doc_id for r in decontamination.contamination(texts, one).collect()} == {2, 4}


# -- 9 ---------------------------------------------------------------------------------------------------


def test_toxicity_is_learnt_from_document_labels(spark):
    rng = random.Random(12)
    bad = ["awfulword", "vileness", "grimstem1", "grimstem2", "grimstem3"]
    rows, labels = [], []
    for i in range(1200):
        sentences = [" ".join(f"w{rng.randrange(300)}" for _ in range(8)) + "." for _ in range(rng.randrange(1, 12))]
        toxic = i % 6 == 0
        if toxic:
            sentences[rng.randrange(len(sentences))] += f" you {rng.choice(bad)} thing. "
        rows.append((i, " ".join(sentences), None, None, None, 9.0))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, None, None, None, None), (5001, "", None, None, None, None), (5002, "A clean start. What an awfulword\nhere", None, None, None, None)]
    df, told = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, told).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in range(1200) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert got[5000].score == got[5001].score == 0 and [rows[-1][1][s.start : s.end] for s in got[5002].sentences] == ["What an awfulword"]
    kept = toxicity.keep_clean(df, told)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted == 0}
    assert {r.score for r in toxicity.toxicity(df, told.limit(0)).collect()} == {0.0} and toxicity.toxicity(empty(spark), told).count() == 0


def plain_toxicity(model, text, threshold):
    """Score and offending spans of a text, word by word."""
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))

    def hashed(piece):
        raw = np.frombuffer(piece, np.uint8)
        return kernel.hashes(raw, np.array([0]), np.array([len(raw)]))[:1]

    sentences, held = [], None
    for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+|[.!?\n]", text):
        if m[0] in ".!?\n":
            held = None
            continue
        if held is None:
            held = [m.start(), m.end(), set()]
            sentences.append(held)
        held[1] = m.end()
        word = m[0].translate(LOWER).encode()
        held[2].add(int(kernel.mix(hashed(word) + np.uint64(1))[0]))
        held[2] |= {int(hashed(word[:k])[0]) for k in toxicity.PREFIXES if len(word) > k}
    clean, spans = 1.0, []
    for start, end, features in sentences:
        p = 1 / (1 + np.exp(-min(30, max(-30, model.bias + sum(weight.get(f, 0.0) for f in features)))))
        clean *= 1 - min(p, 1 - 1e-12)
        if p >= threshold:
            spans.append((start, end))
    return 1 - clean, spans


def test_scores_are_those_of_a_plain_scorer(spark):
    rng = random.Random(21)
    vocabulary = [f"{rng.choice(['gr', 'uné', 'interp', 'wordstem'])}{rng.choice(['im', 'olate', 'ification', 'x'])}{rng.randrange(12)}" for _ in range(200)]
    some = ["".join([rng.choice(vocabulary), rng.choice([" ", ". ", "!? ", "\n", " ... ", "-", ", "])]) for _ in range(4000)]
    texts = ["".join(some[i : i + rng.randrange(1, 60)]) for i in range(0, 4000, 40)]
    words = sorted({w.lower() for t in texts for w in re.findall(r"\w+", t)})
    pieces = [w.encode() for w in rng.sample(words, 60)]
    keys = [int(kernel.mix(kernel.hashes(r, np.array([0]), np.array([len(r)])) + np.uint64(1))[0]) for r in map(lambda x: np.frombuffer(x, np.uint8), pieces)]
    keys += [int(kernel.hashes(r, np.array([0]), np.array([len(r)]))[0]) for r in (np.frombuffer(p[:k], np.uint8) for p in pieces[:30] for k in toxicity.PREFIXES if len(p) > k)]
    keys = np.unique(np.array(keys, np.uint64))
    model = toxicity.Model(keys, np.array([rng.uniform(-2, 2) for _ in keys]), -2.0)
    texts += [" ", "...", "a" * 70_000, "GRIM. " * 5000, "\n\n!", texts[3]]
    df = documents(spark, texts)
    # Rows that repeat, ties and extra columns: each row has its own score.
    got = collections.defaultdict(list)
    for r in toxicity.score(df.unionByName(df), model).collect():
        got[r.doc_id].append(r)
    for i, t in enumerate([None, "", *texts]):
        want, spans = plain_toxicity(model, t or "", 0.5)
        assert len(got[i]) == 2
        for r in got[i]:
            assert r.score == pytest.approx(want, abs=1e-9) and [(s.start, s.end) for s in r.sentences] == spans
    assert sum(len(r[0].sentences) for r in got.values()) > 50


def test_fit_is_the_same_in_any_order(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(30)) + (" vileword." if i % 5 == 0 else "."), i % 5 == 0) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(t)) for i, _, t in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, t, "x", True, 1.0) for i, t, _ in rows] + [(0, "another text of one id", "x", True, 1.0)], "doc_id long, text string, rejected string, _rejected boolean, Sentences double")
    a, b = (toxicity.fit(d, labels) for d in (docs.repartition(7, "text"), docs.orderBy(F.rand(3)).repartition(2)))
    assert (a.keys == b.keys).all() and a.weights.tolist() == b.weights.tolist() and a.bias == b.bias
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect() if r.text.endswith("vileword.")} == set() and kept.count() == 321


def test_noisy_or_gradient():
    rng = np.random.default_rng(2)
    label, n = np.array([1, 0, 1]), np.array([2, 3, 1])
    sentence, number = np.array([0, 1, 2, 3, 4, 5, 5]), np.array([0, 1, 1, 2, 2, 0, 2])
    w, b = toxicity._descend(label, n, sentence, number, 3, 300, 0.1, 0.0)
    p = 1 / (1 + np.exp(-(np.bincount(sentence, w[number], 6) + b)))
    doc = np.array([1 - np.prod(1 - p[:2]), 1 - np.prod(1 - p[2:5]), p[5]])
    assert doc[0] > 0.9 and doc[1] < 0.1 and doc[2] > 0.9 and rng is not None


# -- 10 --------------------------------------------------------------------------------------------------


def plain_phrases(data):
    seen, at = set(), 0
    while at < len(data):
        end = at + 3
        while end <= len(data) and data[at:end] in seen:
            end += 1
        seen.add(data[at : min(end, len(data))])
        at = end
    return seen


def plain_sketch(text):
    h = [int(kernel.mix(np.array([zlib.crc32(p) * 0x9E3779B97F4A7C15 + 1 & (2**64 - 1)], np.uint64))[0] >> np.uint64(32)) for p in plain_phrases(text.encode())]
    return sorted(set(h))[: lz_fingerprint.SIZE]


def alike(a, b):
    if not a or not b:
        return float(not a and not b)
    both = sorted(set(a) | set(b))[: lz_fingerprint.SIZE]
    return sum(x in a and x in b for x in both) / len(both)


def test_fingerprints_against_plain_parse(spark):
    rng = random.Random(13)
    texts = ["a", "aaaa" * 50, "é日", prose(rng, 30), prose(rng, 30), prose(rng, 900), "", "x" * 20_000] + [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    texts[9] = texts[8]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in lz_fingerprint.fingerprints(df).collect()}
    every = ["", "", *texts]
    assert len(got) == len(every)
    for i, t in enumerate(every):
        following = every[i - 1]  # descending ids; after the first row the last
        third = len(t) // 3
        changed = t[: len(t) - third] + following[:third]
        a, b, c = plain_sketch(t), plain_sketch(changed), plain_sketch(following)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].fingerprint == "".join(f"{x:08x}" for x in a) and got[i].edited_fingerprint == "".join(f"{x:08x}" for x in b)
        assert got[i].near_edited == pytest.approx(alike(a, b)) and got[i].near_next == pytest.approx(alike(a, c))
    assert got[10].fingerprint == got[11].fingerprint
    assert lz_fingerprint.fingerprints(empty(spark)).count() == 0


def test_fingerprints_of_odd_rows(spark):
    rows = [(5, "one text of some length"), (5, "another text"), (None, "no place in the order"), (-3, None), (2**60, "big id")]
    got = lz_fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and [r.near_next for r in got if r.doc_id is None] == [0.0]
    one = lz_fingerprint.fingerprints(spark.createDataFrame([(1, "alone with itself")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_small_dictionaries_are_emptied(monkeypatch):
    monkeypatch.setattr(lz_fingerprint, "DICTIONARY", 50)
    text = prose(random.Random(2), 400).encode()
    a, b = lz_fingerprint.sketch_both(text, text[:900] + b"xyz" * 50, 900)
    assert (a == lz_fingerprint.sketch(text)).all() and (b == lz_fingerprint.sketch(text[:900] + b"xyz" * 50)).all() and len(a) == lz_fingerprint.SIZE


def test_archives_and_url_judgements_of_empty_tables_and_with_other_columns(spark, tmp_path):
    kinds = "page_id long, url string, html string, payload_digest string, verdict string, rule int"
    none = spark.createDataFrame([], kinds)
    assert warc.archived(none, f"file://{tmp_path}/none").collect() == []
    rows = [(1, "http://a.org/x", "same", "d", "v", 1), (2, None, "same", "d", "v", 2), (3, "http://b.net/es/1", None, None, None, None)]
    pages = spark.createDataFrame(rows, kinds)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.archived(pages, f"file://{tmp_path}/some").collect()}
    assert got == {1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("response", None, 0)}
    listed = spark.createDataFrame([("http://a.org/x",)], "url string")
    assert url_filter.filtered(none, listed).collect() == []
    judged = lambda some: {r.page_id: r.verdict for r in url_filter.filtered(pages, some).collect()}
    assert judged(listed) == {1: "block", 2: "allow", 3: "block"} and judged(listed.limit(0)) == {1: "allow", 2: "allow", 3: "block"}
