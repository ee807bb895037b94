"""Spelling variants against plain loops over all pairs, and the cases that the table has not."""

import collections
import random
import re
import string
import zlib

from siltstone.llm import spelling_variants as S

SCHEMA = "doc_id long, text string, word string, n long, form string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_words(rows):
    seen = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            seen[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def edit_distance_is_one(a, b):
    """By the whole table of distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1] == 1


def plain(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and edit_distance_is_one(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(tuple(r) for r in S.spelling_variants(df).collect())


def mistyped(rng, word, letters):
    at, c = rng.randrange(len(word) + 1), rng.choice(letters)
    return rng.choice([word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]])


def corpus(rng):
    letters = "abeéÀÿ×"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(40)] + ["aaaaaa", "ababababab"]
    for _ in range(3):
        words += [mistyped(rng, w, letters) for w in rng.sample(words, 40)]
    weighed = [w for w in words for _ in range(rng.choice([1, 4, 6, 30, 160]))]
    rng.shuffle(weighed)
    texts = [rng.choice([" ", "-", "\n", "1"]).join(rng.choice([w, w.upper().replace("É", "é").replace("À", "À")]) for w in weighed[i::12]) for i in range(12)]
    return list(enumerate(texts))


def test_variants_are_those_of_all_pairs(spark):
    for seed in range(2):
        rows = corpus(random.Random(seed))
        # Repeated rows count each; a null id, null and empty texts, one run without an end.
        rows += [rows[0], (None, rows[1][1]), (50, None), (51, ""), (53, "chainend " * 150 + "chainenx " * 30 + "chainexx " * 6), (52, ("longrun" * 60 + " ") * 5 + ("longrun" * 60 + "x ") * 30)]
        want = plain(rows)
        assert got(made(spark, rows)) == want
        assert any(r[1] for r in want) and any(r[2] != (r[1] or r[0]) for r in want), "no chain of forms"


def test_ties_go_to_the_smallest_form_in_code_point_order(spark):
    rows = [(1, "barées " * 5 + "baréeß " * 25 + "baréez " * 25 + "baréeé " * 25)]
    assert {r[0]: r[1] for r in got(made(spark, rows))}["barées"] == "baréez"
    assert got(made(spark, rows)) == plain(rows)


def test_empty_tables(spark):
    assert got(made(spark, [])) == [] and got(made(spark, [(1, "no long word"), (2, None)])) == []


def test_words_one_edit_apart_meet_and_pass_the_count_filter():
    rng = random.Random(3)
    for _ in range(4000):
        letters = rng.choice(["ab", "abc", string.ascii_lowercase])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 12)))
        b = mistyped(rng, a, letters)
        if len(b) < 5 or a == b:
            continue
        assert S.one_edit(a, b) and edit_distance_is_one(a, b)
        every = sorted({g for w in (a, b) for g in S.grams(w)})
        rng.shuffle(every)
        rank = {g: i for i, g in enumerate(every)}
        short, long = sorted([a, b], key=len)
        (held, asked), (there, _) = S.keys(short, rank), S.keys(long, rank)
        assert set(held if len(a) == len(b) else asked) & set(there), (a, b)
        assert list(S.near_in_part([a, b], [])) == [(0, 1)] if len(a) == len(b) else list(S.near_in_part([long], [short])) == [(1, 0)]
