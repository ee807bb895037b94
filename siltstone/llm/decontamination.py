"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Roles are turned round: the items are the indexed documents, and every passage of every training text is a
query.  An item's term weights are BM25 impacts divided by their sum over the item, so that a score is the
share of the item's weight that a passage covers and one threshold serves all items.  Items are put into bands
by their number of words (32 at most, 64, 128, ...); for a band, passages are two consecutive runs of as many
words as its longest item may have, so an item lies whole in some passage, and its passages do not depend on
what other items there are.

Retrieval is block-max WAND.  The items of an index are cut into blocks of eight, a term's postings are its
blocks in order, each with its greatest weight there, and a passage has one cursor per term.  The pivot is the
first block at which the list maxima of the cursors up to it add up to the threshold: no block before it can
hold a hit.  Cursors behind jump to the pivot; only if the maxima of that very block reach the threshold are
its items scored.  Passages advance side by side, a step of all of them being a few numpy passes.  All items
above the threshold come back; nothing is capped.

A hit is then verified on the words' order: of the item's question (all but its last sentence) and of its
answer (the last one), the passage must hold at least half of the n-grams each (n = 5, or the whole of a
shorter part).  A part without words asks for nothing.

Items are dealt by band, id and text to shards of about `MAX_ITEMS`, each with its own index.  What the weights
depend on (number of items, mean length, items that have a term) is counted over all items, so results do not
depend on the shards.  A shard's index is built in a task and lies in the shared folder; a scoring task holds
one shard's index at a time.

Words are runs of letters and digits (any byte above ASCII is a letter), A-Z lower-cased.  Null or empty
texts hold nothing; null or wordless items match nothing; items of equal text are each reported, equal rows
once.  Documents that repeat a doc_id are searched each, and `contamination` reports their ids once an item.
An
empty table of either kind gives an empty result; columns of documents other than doc_id and text, and of items other
than item_id and text, are not read.  Very long texts are so many passages.  Of a pair's passages the one that scores best is reported, ties going to
the greater overlaps.
"""

from __future__ import annotations

import pickle
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import kernel as K
from siltstone.llm.shared import batched, new_path, written
from siltstone.llm.toxicity import _GAP
from siltstone.llm.warc import _store

NGRAM = 5
THRESHOLD = 0.5
OVERLAP = 0.5
BLOCK_ITEMS = 8
MAX_ITEMS = 20_000
SHARED_BYTES = 4_000_000  # of texts that go over the shards together
_K1, _B = 1.2, 0.75


def _word_hashes(buf: np.ndarray, offs: np.ndarray):
    starts, ends = K.tokens(buf, offs, _GAP)
    return K.hashes(buf, starts, ends, lower=True), K.owners(starts, offs)


def _of_text(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode(), np.uint8)
    return _word_hashes(buf, np.array([0, len(buf)]))[0]


def _ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, K.U)
    total = np.zeros(m, K.U)
    for j in range(n):
        total += words[j : j + m] * K._LANES[j]
    return K.mix(total)


def split_item(text: str) -> tuple[str, str]:
    """An item's question and answer: all but the last sentence, and the last; one sentence is halved."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if re.search(r"\w", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


_LOW = K.U((1 << 18) - 1)


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers of many ranges, and the range of each."""
    size = end - start
    return np.repeat(np.arange(len(size)), size), np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


@dataclass
class Counts:
    """What the weights take from all items: those with words, their total length, and items per term."""

    items: int
    words: int
    terms: np.ndarray  # word hashes, ascending
    df: np.ndarray


#: The fewest words of a passage's run.
_SHORTEST = 32


def band(n: np.ndarray | int):
    """The band of items of so many words: they have at most 2 ** band."""
    return np.ceil(np.log2(np.maximum(n, _SHORTEST))).astype(np.int64)


#: A cursor at its list's end.
_END = 1 << 30
#: Cursors that advance side by side.
_CURSORS = 200_000
_EPS = 1e-9


@dataclass
class Index:
    ids: np.ndarray
    half: int  # words of a run; a passage is two
    terms: np.ndarray  # word hashes, ascending
    list_max: np.ndarray
    entry_at: np.ndarray  # CSR by term: blocks in which it occurs, and its maximum there
    entry_block: np.ndarray
    entry_max: np.ndarray
    posting_at: np.ndarray  # CSR by entry: the items of the block that have the term, and their weights
    posting_item: np.ndarray
    posting_weight: np.ndarray
    blocks: int
    seen: np.ndarray  # bitmap of the low bits of the terms
    questions: list[tuple[int, np.ndarray]]
    answers: list[tuple[int, np.ndarray]]
    threshold: float

    @classmethod
    def build(cls, items: list[tuple[int, str]], threshold: float, counts: Counts | None = None, half: int | None = None) -> Index:
        """The index of some items; without counts over all items, these are all, and without a length, the longest of them fits."""
        items = sorted((i, t) for i, t in items if i is not None)
        words = [_of_text(t or "") for _, t in items]
        items, words = [x for x, w in zip(items, words, strict=True) if len(w)], [w for w in words if len(w)]
        n = len(items)
        length = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(n), length)
        terms, term = np.unique(np.concatenate([*words, np.zeros(0, K.U)]), return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * max(n, 1) + owner, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        if counts is None:
            counts = Counts(n, int(length.sum()), terms, np.bincount(term, minlength=len(terms)))
        df = counts.df[np.searchsorted(counts.terms, terms)]
        idf = np.log1p((counts.items - df + 0.5) / (df + 0.5))
        norm = _K1 * (1 - _B + _B * length / max(1, counts.words / max(1, counts.items)))
        w = idf[term] * tf * (_K1 + 1) / (tf + norm[item])
        w /= np.bincount(item, w, n)[item]
        list_max = np.zeros(len(terms))
        np.maximum.at(list_max, term, w)
        blocks = -(-n // BLOCK_ITEMS)
        key, at = np.unique(term * max(blocks, 1) + item // BLOCK_ITEMS, return_inverse=True)
        top = np.zeros(len(key))
        np.maximum.at(top, at, w)
        order = np.argsort(at, kind="stable")
        seen = np.zeros(1 << 18, bool)
        seen[(terms & _LOW).astype(np.int64)] = True
        parts = [[], []]
        for _, text in items:
            for out, part in zip(parts, split_item(text), strict=True):
                h = _of_text(part)
                size = max(1, min(NGRAM, len(h)))
                out.append((size, np.unique(_ngrams(h, size))))
        half = half or 1 << int(band(int(length.max()) if n else 1))
        return cls(
            np.array([i for i, _ in items], np.int64), half, terms, list_max, np.searchsorted(key // max(blocks, 1), np.arange(len(terms) + 1)),
            key % max(blocks, 1), top, np.searchsorted(at[order], np.arange(len(key) + 1)), item[order], w[order], blocks, seen, parts[0], parts[1], threshold,
        )

    def hits(self, words: np.ndarray, doc: np.ndarray, n_docs: int) -> list[tuple[int, int, float, float, float]]:
        """(text, item id, score, question overlap, answer overlap) of a run of texts, once a pair."""
        if not len(self.terms) or not len(words):
            return []
        known = np.flatnonzero(self.seen[(words & _LOW).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.terms, words[known]), len(self.terms) - 1)
        true = self.terms[place] == words[known]
        known, place = known[true], place[true]
        # Runs of `half` words; a passage is a run and the next one of the same text.
        first = np.searchsorted(doc, np.arange(n_docs + 1))
        runs_of = -(-np.diff(first) // self.half)
        run_base = np.concatenate([[0], np.cumsum(runs_of)])
        run = run_base[doc[known]] + (known - first[doc[known]]) // self.half
        pair = np.unique(run * len(self.terms) + place)
        run, term = pair // len(self.terms), pair % len(self.terms)
        n_runs = int(run_base[-1])
        last = np.zeros(n_runs, bool)
        last[run_base[1:][runs_of > 0] - 1] = True
        bound = np.bincount(run, self.list_max[term], n_runs)
        bound[:-1] += np.where(last[:-1], 0, bound[1:])
        # Where all lists together do not reach the threshold, there is no first pivot.
        alive = np.flatnonzero(bound >= self.threshold - _EPS)
        at = np.searchsorted(run, np.arange(n_runs + 1))
        end = at[np.where(last[alive], alive + 1, alive + 2)]
        size = end - at[alive]
        order = np.argsort(size, kind="stable")
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        text_of = np.repeat(np.arange(n_docs), runs_of)
        a = 0
        while a < len(order):
            # The widest passage of a batch is its last one.
            b = a + max(1, int(np.searchsorted(size[order[a:]] * np.arange(1, len(order) - a + 1), _CURSORS)))
            some = order[a:b]
            who, take = _ranges(at[alive[some]], end[some])
            distinct = np.unique(who * len(self.terms) + term[take])
            for k, item, score in self._wand(distinct // len(self.terms), distinct % len(self.terms), len(some)):
                p = alive[some[k]]
                text = int(text_of[p])
                begin = first[text] + (p - run_base[text]) * self.half
                q, answer = self._overlaps(item, words[begin : min(begin + 2 * self.half, first[text + 1])])
                if min(q, answer) >= OVERLAP:
                    best[text, item] = max(best.get((text, item), (0, 0, 0)), (score, q, answer))
            a = b
        return [(text, int(self.ids[item]), *x) for (text, item), x in sorted(best.items())]

    def _wand(self, passage: np.ndarray, term: np.ndarray, n: int):
        """(passage, item, score) for all items at or above the threshold; passages and their distinct terms ascend."""
        first = np.searchsorted(passage, np.arange(n + 1))
        wide = max(1, int(np.diff(first).max()))
        none = len(self.terms)  # a term without postings fills the rows up
        terms = np.full((n, wide), none)
        terms[passage, np.arange(len(passage)) - first[passage]] = term
        starts, ends = np.append(self.entry_at[:-1], 0), np.append(self.entry_at[1:], 0)
        tops = np.append(self.list_max, 0.0)
        keys = np.repeat(np.arange(none), np.diff(self.entry_at)) * self.blocks + self.entry_block
        blocks = np.append(self.entry_block, _END)
        cursor = starts[terms]
        block = np.where(cursor < ends[terms], blocks[cursor], _END)
        rows = np.arange(n)
        while True:
            # Cursors by their block; the pivot is where the list maxima first add up to the threshold.
            ordered = np.sort((block << 32) | np.arange(wide), axis=1)
            reach = np.cumsum(np.take_along_axis(tops[terms], ordered & 0xFFFFFFFF, 1), axis=1) >= self.threshold - _EPS
            pivot = np.where(reach[:, -1], ordered[np.arange(len(rows)), reach.argmax(1)] >> 32, _END)
            on = pivot < _END
            if not on.all():
                rows, terms, cursor, block, pivot = rows[on], terms[on], cursor[on], block[on], pivot[on]
            if not len(rows):
                return
            row, slot = np.nonzero(block <= pivot[:, None])
            here, t, goal = cursor[row, slot], terms[row, slot], pivot[row]
            behind = block[row, slot] < goal
            here[behind] = np.searchsorted(keys, t[behind] * self.blocks + goal[behind])
            there = np.where(here < ends[t], blocks[here], _END)
            at = there == goal
            bounds = np.bincount(row[at], self.entry_max[here[at]], len(rows))
            score = at & (bounds[row] >= self.threshold - _EPS)
            if score.any():
                owner, posting = _ranges(self.posting_at[here[score]], self.posting_at[here[score] + 1])
                pair, number = np.unique(row[score][owner] * len(self.ids) + self.posting_item[posting], return_inverse=True)
                total = np.bincount(number, self.posting_weight[posting], len(pair))
                for k in np.flatnonzero(total >= self.threshold - _EPS):
                    yield int(rows[pair[k] // len(self.ids)]), int(pair[k] % len(self.ids)), float(total[k])
            # Every cursor now lies behind the pivot block.
            here += at
            cursor[row, slot] = here
            block[row, slot] = np.where(here < ends[t], blocks[here], _END)

    def _overlaps(self, item: int, span: np.ndarray) -> tuple[float, float]:
        """The shares of the question's and the answer's n-grams that the passage holds."""
        question, answer = (float(np.isin(grams, _ngrams(span, size)).mean()) if len(grams) else 1.0 for size, grams in (self.questions[item], self.answers[item]))
        return question, answer


def _measured(batches):
    """The items with their numbers of words."""
    for rows, buf, offs in K.blocks(batches):
        _, doc = _word_hashes(buf, offs)
        n = np.bincount(doc, minlength=len(offs) - 1)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n, pa.int64()), pa.array(band(n))], names=[*rows.schema.names, "n", "band"])


def _terms(batches):
    """(shard, term, copies) of each item's distinct words."""
    for rows, buf, offs in K.blocks(batches):
        words, doc = _word_hashes(buf, offs)
        order = np.lexsort((words, doc))
        words, doc = words[order], doc[order]
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
        who = pa.array(doc[new], pa.int64())
        shard, copies = (rows.column(rows.schema.get_field_index(x)).take(who) for x in ("shard", "copies"))
        yield pa.RecordBatch.from_arrays([shard, pa.array(words[new].view(np.int64)), copies], names=["shard", "term", "copies"])


def _build(folder: str, threshold: float, items: int, words: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        terms = right.column("term").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(terms)
        counts = Counts(items, words, terms[order].astype(K.U), right.column("df").to_numpy()[order])
        shard = key[0].as_py()
        index = Index.build(list(zip(left.column("item_id").to_pylist(), left.column("text").to_pylist(), strict=True)), threshold, counts, 1 << (shard >> 32))
        # A task that is run again writes a file of its own; which one counts is in its result.
        name = f"{folder}/{shard}-{uuid.uuid4().hex}"
        store, path = _store(name)
        store.create_dir(path.rpartition("/")[0])
        with store.open_output_stream(path) as out:
            out.write(pickle.dumps(index, protocol=5))
        return pa.table({"shard": pa.array([shard], pa.int64()), "path": [name]})

    return run


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD, max_items: int = MAX_ITEMS) -> list[str]:
    """Where the index of each shard of the items lies; the driver holds names only."""
    spark = benchmark.sparkSession
    distinct = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    items = written(distinct.mapInArrow(_measured, "item_id long, text string, copies long, n long, band long").filter("n > 0"), "items")
    # One row a band, of which there are no more than lengths have bits.
    bands = items.groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("items"), F.sum(F.col("copies") * F.col("n")).alias("words")).collect()
    if not bands:
        return []
    shards = F.coalesce(*[F.when(F.col("band") == r.band, F.lit(-(-r.rows // max_items))) for r in bands])
    dealt = items.select(F.expr("shiftleft(band, 32)").bitwiseOR(F.pmod(F.xxhash64("item_id", "text"), shards).cast("long")).alias("shard"), "item_id", "text", "copies")
    terms = dealt.select("shard", "copies", "text").mapInArrow(_terms, "shard long, term long, copies long").groupBy("shard", "term").agg(F.sum("copies").alias("copies"))
    terms = written(terms, "terms")
    found = terms.select("shard", "term").join(terms.groupBy("term").agg(F.sum("copies").alias("df")), "term")
    build = _build(new_path(spark, "indexes"), threshold, sum(r["items"] for r in bands), sum(r.words for r in bands))
    made = dealt.select("shard", "item_id", "text").groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(build, "shard long, path string").collect()
    return [r.path for r in sorted(made, key=lambda r: r.shard)]


#: Bytes of indexes that a worker keeps.
HELD_BYTES = 32 << 20
_held: dict[str, tuple[int, Index]] = {}


def _index(name: str) -> Index:
    """A shard's index; a worker keeps those that it read last, as far as they are small together."""
    if name not in _held:
        store, path = _store(name)
        with store.open_input_file(path) as f:
            raw = f.read()
        while _held and len(raw) + sum(n for n, _ in _held.values()) > HELD_BYTES:
            del _held[next(iter(_held))]
        _held[name] = len(raw), pickle.loads(raw)
    return _held[name][1]


def _hits(names: list[str], batches):
    """(rows, the hits in them by any shard's items) of runs of texts; with several shards, of many runs for each reading of an index."""
    held, size = [], 0

    def scored():
        hits = [[] for _ in held]
        for name in names:
            index = _index(name)
            for found, (_, words, doc, n) in zip(hits, held, strict=True):
                found += index.hits(words, doc, n)
        yield from ((rows, found) for (rows, *_), found in zip(held, hits, strict=True))

    for rows, buf, offs in K.blocks(batches):
        held.append((rows, *_word_hashes(buf, offs), len(offs) - 1))
        size += len(buf)
        if size >= SHARED_BYTES:
            yield from scored()
            held, size = [], 0
    yield from scored()


def _report(names: list[str]):
    def run(batches):
        for rows, hits in _hits(names, batches):
            text, item, *rest = zip(*hits, strict=True) if hits else ([], [], [], [], [])
            ids = rows.column(rows.schema.get_field_index("doc_id")).take(pa.array(text, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64()), *[pa.array(x, pa.float64()) for x in rest]], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def contamination(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for every verified leak."""
    names = indexes(benchmark, threshold, max_items)
    out = batched(documents.select("doc_id", "text")).mapInArrow(_report(names), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _without_leaks(names: list[str]):
    def run(batches):
        for rows, hits in _hits(names, batches):
            keep = np.ones(rows.num_rows, bool)
            keep[[h[0] for h in hits]] = False
            yield rows.filter(pa.array(keep))

    return run


def keep_uncontaminated(documents: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """The documents that hold no verified leak, all columns as they were."""
    return batched(documents).mapInArrow(_without_leaks(indexes(benchmark, max_items=max_items)), documents.schema)
