"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct five-word shingles.  Sets are dealt to bands by their size, each of sizes twice
those of the one below.  In a band the domain of shingle hashes is cut into parts and each part into three cells;
a signature is what a set holds in two of the three cells of a part.  Two sets of similarity 3/4 or more differ
in at most k shingles, a third of the smaller one's size, so of any k / 2 + 1 parts one holds at most one
difference, and two of its cells agree: the two sets share a signature.  A set signs so many parts, and some more
(`_spare`), in its own band, and where it may have partners in the band below, in that one too.  Sets below 64
shingles are cut as finely as can be: every shingle is a part.

Candidate pairs are formed on these signatures, and verified on whole shingle sets:

1. Signatures that occur once vanish, and so do sets that share fewer than linked sets must.  To see which occur
   again, a signature's rows meet in one task; those of signatures that very many sets have (`CROWD` or more of a
   sample of about `SAMPLE`) do not, as it is known of them.  What the sample shows changes the way, not the result.
2. Every set is compared with the least set of each of its groups (the sets that share a signature).
3. Groups that still hold several components are compared across them, pair by pair, where they have at most
   `GROUP` sets.
4. What lies in larger ones (a passage that very many documents share) goes another exact way: single shingles,
   rarest first, as many as linked sets cannot all miss (a prefix filter), and only where what follows in either
   order could still be enough.

A pair is first looked at by sketches: a set's is 2,048 bits, each the parity of the shingles that fall on it, and
two sets differ in at least as many shingles as their sketches in bits.  Whole sets travel for what passes only.
Pairs within a group are never all emitted, and components, not pairs, are the result.

Probability enters in two places: with 64-bit hashes two different shingles of one pair may collide, and the
cells that agree may all be empty, in every one of the spare parts that agree.

Null or empty texts have no shingles and link with nothing.  Exact copies count as one set.  Rows that repeat
a doc_id are one node, and whatever one of its texts is linked to, the node is linked to.  A null doc_id is its
own component (null).  Very long texts are sets like others.  An empty table gives an empty
result.  Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import kernel as K
from siltstone.llm.shared import Scratch, batched, bloom, connected_components, maybe_listed, without

WORDS = 5
#: A link needs 100 * shared >= PERCENT * union; the bands below are made for 75 and hold above it.
PERCENT = 75
#: Sets of a group that are compared pair by pair.
GROUP = 8
#: Sets of the sample in which crowded signatures are looked for, and how many of them make one.
SAMPLE, CROWD = 8192, 16
_SMALL = 64
#: Least sizes of the bands.
_EDGES = np.array([_SMALL << i for i in range(40)])
_CELLS = 3


def _band(n: np.ndarray) -> np.ndarray:
    """The band of sets of so many shingles; -1 for the smallest."""
    return np.searchsorted(_EDGES, n, "right") - 1


def _spare(n: np.ndarray) -> np.ndarray:
    return 3 + n // 128


def _signed(n: np.ndarray) -> np.ndarray:
    """Parts that a set signs: linked sets agree in one more than `_spare` of them."""
    return n // 3 // 2 + 1 + _spare(n)


#: Signatures that a set shares in a band with any set it is linked to: three quarters of its single shingles, else
#: half of the parts that agree for certain, as cells may be empty.
_LEAST = f"CASE WHEN n < {_SMALL} OR n < {_EDGES[1]} AND band = 1 THEN (3 * n + 3) div 4 ELSE (4 + n div 128) div 2 END"


def _profile(batches):
    for rows, buf, offs in K.blocks(batches):
        vals, at = K.shingles(buf, offs, WORDS)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(rows.schema.get_field_index("doc_id")),
                pa.array(np.diff(at)),
                K.longs(K.segment_sums(K.mix(vals), at)),
                K.longs(K.segment_sums(K.mix(vals ^ K.U(0xA5A5A5A5A5A5A5A5)), at)),
            ],
            names=["doc_id", "n_shingles", "k1", "k2"],
        )


def _single(vals, at, rows, band):
    """Every shingle of the texts as a signature, and its text."""
    n = at[rows + 1] - at[rows]
    pick = np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return K.mix(vals[pick] + K.U(1)), np.repeat(rows, n)


def _subsets(vals, at, rows, band):
    """Signatures of the texts, each in its band: two cells of every part signed; and the text of each."""
    n = at[rows + 1] - at[rows]
    pick = np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    v, text = vals[pick], np.repeat(np.arange(len(rows)), n)
    most = _EDGES[band + 1] - 1
    parts, signed = _signed(most), _signed(np.minimum(n, most))
    # Shingles ascend within a text, so the parts, ranges of their upper halves, do too.
    part = ((v >> K.U(32)) * parts[text].astype(K.U)) >> K.U(32)
    inside = part < signed[text].astype(K.U)
    v, text, part = v[inside], text[inside], part[inside]
    if not len(v):
        return np.zeros(0, K.U), np.zeros(0, np.int64)
    cell = ((v & K.U(0xFFFFFFFF)) * K.U(_CELLS)) >> K.U(32)
    new = np.ones(len(v), bool)
    new[1:] = (part[1:] != part[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    held = [np.add.reduceat(np.where(cell == K.U(c), K.mix(v), K.U(0)), start) for c in range(_CELLS)]
    salt = K.mix((band[text[start]] + 2).astype(K.U) * K.U(0x632BE59BD9B4E019) + part[start])
    found, owner = [], []
    for left in range(_CELLS):
        a, b = held[(left + 1) % _CELLS], held[(left + 2) % _CELLS]
        some = np.flatnonzero((a | b) != 0)
        found.append(K.mix(K.mix(a[some] + salt[some]) + K.mix(b[some] ^ K.U(left + 1)) * K.U(3)))
        owner.append(text[start[some]])
    return np.concatenate(found), rows[np.concatenate(owner)]


def _signatures(crowded: np.ndarray, wanted: bool, batches):
    """The texts' signatures that are among the crowded ones (ascending), or those that are not."""
    for rows, buf, offs in K.blocks(batches):
        vals, at = K.shingles(buf, offs, WORDS)
        n = np.diff(at)
        own, sets = _band(n), np.flatnonzero(n)
        ids = rows.column(rows.schema.get_field_index("doc_id"))
        # Partners in the band below have at least three quarters of a set's size.
        below = sets[(own[sets] >= 0) & ((3 * n[sets] + 3) // 4 < _EDGES[np.maximum(own[sets], 0)])]
        for low, texts in ((0, sets), (1, below)):
            band = own[texts] - low
            for made, some in ((_single, band < 0), (_subsets, band >= 0)):
                sig, text = made(vals, at, texts[some], band[some])
                # The lowest bit tells neighbouring bands apart.
                sig = (sig & ~K.U(1)) | ((own[text] - low) & 1).astype(K.U)
                place = np.minimum(np.searchsorted(crowded, sig), max(0, len(crowded) - 1))
                keep = (crowded[place] == sig) == wanted if len(crowded) else np.full(len(sig), not wanted)
                sig, text = sig[keep], text[keep]
                yield pa.RecordBatch.from_arrays([K.longs(sig), ids.take(pa.array(text))], names=["sig", "doc_id"])


_BITS = 2048


def _sketches(vals: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text the parities of its shingles, 64 bits to a number."""
    n = len(at) - 1
    out = np.empty((n, _BITS // 64), np.uint64)
    for i in range(0, n, 256):
        j = min(n, i + 256)
        text = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
        bit = (vals[at[i] : at[j]] % K.U(_BITS)).astype(np.int64)
        odd = np.bincount(text * _BITS + bit, minlength=(j - i) * _BITS).astype(np.uint8) & 1
        out[i:j] = np.packbits(odd).view(np.uint64).reshape(j - i, _BITS // 64)
    return out


def _sets(batches):
    for rows, buf, offs in K.blocks(batches):
        vals, at = K.shingles(buf, offs, WORDS)
        sketch = K.lists(K.longs(_sketches(vals, at).ravel()), np.arange(len(at)) * (_BITS // 64))
        yield pa.RecordBatch.from_arrays(
            [rows.column(rows.schema.get_field_index("doc_id")), pa.array(np.diff(at).astype(np.int32)), sketch, K.lists(K.longs(vals), at)], names=["doc_id", "n", "sketch", "shingles"]
        )


def _of(sets: DataFrame, side: str, *columns: str) -> DataFrame:
    return sets.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be linked, by size and sketch."""
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    both = pairs.join(_of(sets, "a", "n", "sketch"), "a").join(_of(sets, "b", "n", "sketch"), "b")
    return both.filter("3 * greatest(n_a, n_b) <= 4 * least(n_a, n_b)").filter(7 * apart <= F.col("n_a") + F.col("n_b")).select("a", "b").distinct()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose whole shingle sets reach the similarity."""
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    both = _near(pairs, sets).join(_of(sets, "a", "shingles"), "a").join(_of(sets, "b", "shingles"), "b")
    union = F.size("shingles_a") + F.size("shingles_b") - shared
    return both.filter(100 * shared >= PERCENT * union).select("a", "b").distinct()


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _placed(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """The signatures with the component that each set has so far."""
    return shared.join(parts, F.col("doc_id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "doc_id")).drop("node", "component")


def _across(placed: DataFrame, groups: DataFrame, able: str = "true") -> DataFrame:
    """Pairs of sets of different components that share a signature of these groups."""
    mine = placed.join(groups.select("sig"), "sig", "left_semi")
    other = mine.toDF(*["sig" if c == "sig" else f"other_{c}" for c in mine.columns])
    return mine.join(other, "sig").filter("doc_id < other_doc_id AND part <> other_part").filter(able).select(*_ordered("doc_id", "other_doc_id")).distinct()


#: Of two sets that share a shingle, each has `rest` shingles from it on, in the order from rare to common, that others
#: have too.  If it is the rarest that both have, they share no more than the lesser `rest`.
_ABLE = "7 * least(rest, other_rest) >= 3 * (n + other_n) AND 3 * greatest(n, other_n) <= 4 * least(n, other_n)"


def _rare(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Signatures of the sets left in large groups: their rarest single shingles, one more than a linked set may miss."""
    single = sets.select("doc_id", "n", F.explode("shingles").alias("sig"))
    often = single.groupBy("sig").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    mine = Window.partitionBy("doc_id", "n")
    ranked = single.join(often, "sig").withColumn("rank", F.row_number().over(mine.orderBy("often", "sig"))).withColumn("held", F.count(F.lit(1)).over(mine))
    kept = ranked.filter("rank <= held - (3 * n + 3) div 4 + 1").select("sig", "doc_id", "n", F.expr("held - rank + 1").alias("rest"))
    return _placed(kept, parts)


def _mixed(placed: DataFrame) -> DataFrame:
    return placed.groupBy("sig").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("many")).filter("lo < hi")


def _crowded(texts: DataFrame, n: int) -> np.ndarray:
    """Signatures, ascending, that many sets of a sample have; a set has some hundred, so they are bounded by the sample."""
    every = max(1, n // SAMPLE)
    some = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    signed = some.mapInArrow(partial(_signatures, np.zeros(0, K.U), False), "sig long, doc_id long")
    often = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CROWD).select("sig")
    return np.sort(often.toPandas().sig.to_numpy().astype(np.int64).view(K.U))


def ngram_components(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (least doc_id with the same set), component_id."""
    spark, docs = documents.sparkSession, batched(documents.select("doc_id", "text"))
    scratch, known = Scratch(spark, "join"), docs.filter(F.col("doc_id").isNotNull())
    profile = scratch.written(docs.mapInArrow(_profile, "doc_id long, n_shingles long, k1 long, k2 long"), "profile")
    key = ["n_shingles", "k1", "k2"]
    classes = scratch.written(profile.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("class_id")), "classes")

    # Equal rows are one, where ids repeat at all.
    repeated = scratch.written(profile.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        probed = maybe_listed(known, "doc_id", bloom(repeated, "doc_id"), "maybe")
        once = probed.filter("maybe").select("doc_id", "text").dropDuplicates()
        known = batched(scratch.written(probed.filter("NOT maybe").select("doc_id", "text").unionByName(once), "known"))

    # Signatures of one text of each class.
    heads = scratch.written(classes.select(F.col("class_id").alias("doc_id")).distinct(), "heads")
    copies = profile.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id").join(heads, "doc_id", "left_anti")
    texts = without(known, "doc_id", copies)
    crowded = _crowded(texts, heads.count())
    sign = lambda wanted: texts.mapInArrow(partial(_signatures, crowded, wanted), "sig long, doc_id long")
    dealt = sign(False).repartition("sig")
    met = dealt.groupBy("sig").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("sig")
    shared = dealt.join(met, "sig").select("sig", "doc_id")
    shared = scratch.written(shared.unionByName(sign(True)) if len(crowded) else shared, "shared")
    sizes = classes.groupBy(F.col("class_id").alias("doc_id")).agg(F.min("n_shingles").alias("n"))
    mine = shared.groupBy("doc_id", F.col("sig").bitwiseAND(F.lit(1)).alias("band")).agg(F.count(F.lit(1)).alias("mine"))
    alive = scratch.written(mine.join(sizes, "doc_id").filter(f"mine >= {_LEAST}").select("doc_id").distinct(), "alive")
    live = scratch.written(shared.join(alive, "doc_id", "left_semi"), "live")
    scratch.drop("shared")
    left = maybe_listed(known, "doc_id", bloom(alive, "doc_id"), "maybe").filter("maybe").join(alive, "doc_id", "left_semi")
    sets = scratch.written(left.mapInArrow(_sets, "doc_id long, n int, sketch array<long>, shingles array<long>"), "sets")

    # Every set against the least one of each of its groups.
    least = live.groupBy("sig").agg(F.min("doc_id").alias("least"))
    first = live.join(least, "sig").filter("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _linked(first, sets)
    # Texts of one id are one node, whichever classes they are in.
    of_id = profile.filter("doc_id IS NOT NULL").join(classes, key).select("doc_id", "class_id").distinct()
    several = of_id.groupBy("doc_id").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).filter("lo < hi").select("doc_id")
    links = scratch.written(links.unionByName(of_id.join(several, "doc_id", "left_semi").toDF("a", "b")), "links")
    parts = connected_components(links)

    # Groups that still hold several components, the large ones by single shingles.
    placed = scratch.written(_placed(live, parts), "placed")
    mixed = scratch.written(_mixed(placed), "mixed")
    more = _across(placed, mixed.filter(F.col("many") <= GROUP))
    large = scratch.written(placed.join(mixed.filter(F.col("many") > GROUP).select("sig"), "sig", "left_semi").select("doc_id").distinct(), "large")
    rare = scratch.written(_rare(sets.join(large, "doc_id", "left_semi"), parts), "rare")
    more = scratch.written(_linked(more.unionByName(_across(rare, _mixed(rare), _ABLE)).distinct(), sets), "more")
    scratch.drop("live", "sets", "placed", "mixed", "rare")

    member = classes.join(parts, F.col("class_id") == F.col("node"), "left").select(*key, "class_id", F.coalesce("component", "class_id").alias("component_id"))
    if not more.isEmpty():
        # The late links join components, each by its name.
        name = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        joined = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        wider = connected_components(joined).select(F.col("node").alias("component_id"), F.col("component").alias("wider"))
        member = member.join(wider, "component_id", "left").select(*key, "class_id", F.coalesce("wider", "component_id").alias("component_id"))
    return profile.join(member, key, "left").select(
        "doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("class_id")), F.col("doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents less all but the least doc_id of each component; documents without words or id stay."""
    found = ngram_components(documents)
    return without(documents, "doc_id", found.filter("component_id <> doc_id").select("doc_id"))
