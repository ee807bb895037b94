"""Grouping of spelling variants: the words of a corpus, those one edit apart, and the form that each is a variant of.

Words are counted in the JVM.  Near words are found with a positional q-gram inverted index (q is 2).  One edit
leaves all but two of a word's q-grams as they are, at their place or, after an inserted code point, one further.
Of a pair's grams that are left, the two that come first (rarest gram of the vocabulary first) are among the first
few of both words; they and their places are the key under which words meet, so that parts of the index are small,
spread evenly, and no pair is missed.  Within a part, every word's postings are merged by a heap under the length and
position limits, pairs that share as many grams as one edit must leave are verified, and those exactly one edit
apart are kept.  Keys of other parts than these can meet by chance only; verification removes what they bring.

A word's form is its near word with the most occurrences, ties to the smallest in code-point order, if these are
at least `ratio` times its own.  Occurrences grow by that ratio along forms, so that roots are found in a few
doublings of the step.

Null and empty texts have no words, an empty table gives an empty result, and texts and words of any length are
read whole.  Rows that repeat count each; a null doc_id counts as an empty one.  Only doc_id and text are read,
whatever other columns there are.
"""

from __future__ import annotations

from collections import Counter
from heapq import merge
from itertools import combinations, count, groupby
from operator import add, ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import Scratch, batched

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters, once A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
SLIPS = 199
RATIO = 5


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, less one code point where the hash of document and run says so."""
    hashed = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (hashed % F.char_length(run)).cast("int")
    return F.when(hashed % SLIPS == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def words(documents: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """Distinct words of the texts (word, n), n their occurrences overall."""
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), 0)).alias("run"))
    found = runs.select(slipped(F.col("doc_id"), F.col("run")).alias("word")).filter(F.char_length("word") >= min_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) != 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905  (b is one longer)
    return a[at:] == b[at + 1 :]


def grams(word: str) -> list[str]:
    return list(map(add, word, word[1:]))


def _key(length: int, first: tuple[int, int], second: tuple[int, int]) -> int:
    """A word length and two grams at their places as a number; places beyond 1,024 wrap, which only lets more words meet."""
    (g, p), (h, q) = first, second
    return (length & 1023) << 46 | g << 33 | (p & 1023) << 23 | h << 10 | (q & 1023)


def keys(word: str, rank: dict[str, int]) -> tuple[list[int], list[int]]:
    """Under which keys a word lies in the index, and under which it asks for words that are one code point longer.

    A replaced code point leaves n - 2 of n grams, an inserted one all but 1 of the shorter word's: the first two
    that are left are among the first 4 of words of one length and of the longer word, and among the first 3 of the shorter.
    """
    order = sorted((rank[g], i) for i, g in enumerate(grams(word)))[:4]
    held = [_key(len(word), a, b) for a, b in combinations(order, 2)]
    asked = set()
    for (g, p), (h, q) in combinations(order[:3], 2):
        for one, two in ((0, 0), (0, 1), (1, 1)) if p < q else ((0, 0), (1, 0), (1, 1)):
            asked.add(_key(len(word) + 1, (g, p + one), (h, q + two)))
    return held, sorted(asked)


def _keyed(rank: dict[str, int]):
    def walk(batches):
        for batch in batches:
            both = [keys(w, rank) for w in batch.column("word").to_pylist()]
            columns = [pa.array([x[i] for x in both], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *columns], names=["word", "n", "held", "asked"])

    return walk


def _alike(lists: dict, size: int, mine: list[str], shifts: tuple[int, ...], bound: int):
    """Numbers of the `size` indexed words that share at least `bound` grams with a query at the places that the shifts allow.

    Lists that hold every word, as those of the grams that brought the words together do, are not merged but counted.
    """
    found = [x for p, g in enumerate(mine) for shift in shifts if (x := lists.get((g, p + shift)))]
    some = [x for x in found if len(x) < size]
    bound -= len(found) - len(some)
    if bound <= 0:
        yield from range(size)
        return
    for j, run in groupby(some[0] if len(some) == 1 else merge(*some)):
        if bound == 1 or sum(1 for _ in run) >= bound:
            yield j


def near_in_part(held: list[str], asking: list[str]):
    """Pairs (i, j) of words one edit apart, by their places in `held` and, after these, in `asking`; j is in `held`.

    Words of one length ask for those indexed before them, shorter ones for all.
    """
    lists: dict[tuple[str, int], list[int]] = {}
    for j, word in enumerate(held):
        mine = grams(word)
        for i in _alike(lists, j, mine, (0,), len(mine) - 2) if j else ():
            if one_edit(held[i], word):
                yield i, j
        for key in zip(mine, count()):  # noqa: B905
            if key in lists:
                lists[key].append(j)
            else:
                lists[key] = [j]
    for i, word in enumerate(asking, len(held)):
        mine = grams(word)
        for j in _alike(lists, len(held), mine, (0, 1), len(mine) - 1):
            if one_edit(word, held[j]):
                yield i, j


def _pairs(batches):
    """Rows come by key, those of the index first; near words of each key, both ways round."""
    open_: list[tuple[int, bool, str, int]] = []

    def part(rows):
        held, asking = [r for r in rows if not r[1]], [r for r in rows if r[1]]
        both = held + asking
        for i, j in near_in_part([r[2] for r in held], [r[2] for r in asking]):
            yield both[i][2], both[i][3], both[j][2], both[j][3]

    def flushed(found):
        a, n, b, m = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a + b), pa.array(b + a), pa.array(m + n)], names=["word", "near", "near_n"])

    found: list[tuple] = []
    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
            same = bool(open_) and open_[0][0] == int(key[a])
            if not same:
                if len(open_) > 1:
                    found.extend(part(open_))
                open_ = []
            # A part of one row that is over has no pairs: it need not be read.
            if same or b == len(key) or b - a > 1:
                cut = batch.slice(a, b - a)
                open_ += zip(*[cut.column(c).to_pylist() for c in ("key", "asks", "word", "n")], strict=True)
            if len(found) >= 4096:
                yield flushed(found)
                found = []
    if len(open_) > 1:
        found.extend(part(open_))
    if found:
        yield flushed(found)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Every pair of near words, both ways round: word, near, near_n; `vocabulary` has word and n, words of at least five code points."""

    def tally(batches):
        seen: Counter = Counter()
        for batch in batches:
            for w in batch.column("word").to_pylist():
                seen.update(grams(w))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "seen"])

    # Letters are 90 at most, so grams are 8,100 at most, whatever the corpus.
    counted = batched(vocabulary.select("word")).mapInArrow(tally, "gram string, seen long").groupBy("gram").agg(F.sum("seen").alias("seen")).collect()
    rank = {r.gram: i for i, r in enumerate(sorted(counted, key=lambda r: (r.seen, r.gram)))}
    keyed = batched(vocabulary.select("word", "n")).mapInArrow(_keyed(rank), "word string, n long, held array<long>, asked array<long>")
    held = F.transform("held", lambda k: F.struct(k.alias("key"), F.lit(False).alias("asks")))
    asked = F.transform("asked", lambda k: F.struct(k.alias("key"), F.lit(True).alias("asks")))
    rows = keyed.select("word", "n", F.explode(F.concat(held, asked)).alias("at"))
    dealt = rows.select("at.key", "at.asks", "word", "n").repartition("key").sortWithinPartitions("key", "asks", "word")
    return batched(dealt).mapInArrow(_pairs, "word string, near string, near_n long").distinct()


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words that have a form; steps along forms double until none gets any further."""
    roots, step = scratch.written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots0"), 0
    while not roots.filter("moved").isEmpty():
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = roots.drop("moved").join(after, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        step += 1
        roots = scratch.written(further, f"roots{step}")
        scratch.drop(f"roots{step - 1}")
    return roots.select("word", "root")


def spelling_variants(documents: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    if min_length < 5:
        raise ValueError("words need five code points for two of their grams to outlive any edit")
    scratch = Scratch(documents.sparkSession, "spelling")
    vocabulary = scratch.written(words(documents, min_length, min_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, "word", "left").withColumn("taken", -F.col("best.less") >= ratio * F.col("n"))
    form, form_n = F.when(F.col("taken"), F.col("best.form")), F.when(F.col("taken"), -F.col("best.less"))
    stats = scratch.written(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), form_n.alias("form_n")), "forms")
    roots = _roots(stats.filter("form IS NOT NULL"), scratch)
    return stats.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
