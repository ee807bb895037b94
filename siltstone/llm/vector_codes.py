"""Vector code compression: product codes whose codebooks come from Lloyd rounds with filtering.

A vector's components become integers, floor(scale * x), and the vector is cut into equal parts.  Every partition
of the table builds, once, a kd-tree over each part of its vectors (in blocks of bounded size) with a bounding box
and the cached sum and count of every node, and the trees are written to the shared folder.  A round sends the
codebooks, some kilobytes, down the trees: an entry is dropped at a node when another one is nearer in its whole
box, and a node with one entry left gives its cached sum and count to it, so that whole subtrees are assigned at
once.  Only the leaves that keep several entries look at their points.  Sums and counts are merged per task and
by Spark; entries x dimensions numbers reach the driver.  All arithmetic is exact in integers.

Dropped are vectors that are null, empty, or hold a null or non-finite component.  The rest must have one
dimension, a multiple of the number of parts, and components whose squares can be summed in 64 bits; others are an
error, not a result.  Entries start as the vectors of the smallest distinct vec_ids, null last, of rows that
repeat one the least vector; with fewer ids there are fewer entries.  Ties go to the lower entry, unused entries stay.
Rows that repeat are coded each.  A null vec_id or label is kept, null labels count as one label.  Other columns are
not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from siltstone.llm.shared import Scratch, batched

#: Components of a block of vectors, and points of a leaf.
BLOCK_VALUES = 1 << 20
BLOCK_ROWS = 1 << 13
LEAF = 16
#: Up to so many sums of labels are broadcast (some tens of megabytes); beyond, rows and sums meet by a shuffle.
BROADCAST_LABELS = 1 << 20


@dataclass(frozen=True)
class Shape:
    parts: int
    dim: int

    @property
    def width(self) -> int:
        return self.dim // self.parts


def bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin among n points in the tree's order, and where the last one ends."""
    return (np.arange((1 << level) + 1) * n) >> level


def depth(n: int) -> int:
    """Levels below the root: leaves hold LEAF points at most, and no node is empty."""
    return max(0, int(-(-n // LEAF) - 1).bit_length())


@dataclass
class Tree:
    """Points in the tree's order, the rows they come from, and by level every node's box and sum."""

    points: np.ndarray  # (n, width) int32
    order: np.ndarray  # (n,) int32
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def grow(points: np.ndarray) -> Tree:
    """A kd-tree over at least one point: nodes are halved by number, across the longest side of their box."""
    n, order = len(points), np.arange(len(points))
    low, high, sums = [], [], []
    for level in range(depth(n) + 1):
        at = bounds(n, level)
        low.append(np.minimum.reduceat(points, at[:-1]))
        high.append(np.maximum.reduceat(points, at[:-1]))
        sums.append(np.add.reduceat(points.astype(np.int64), at[:-1]))
        if level < depth(n):
            node = np.repeat(np.arange(1 << level), np.diff(at))
            side = (high[-1].astype(np.int64) - low[-1]).argmax(1)
            turn = np.lexsort((points[np.arange(n), side[node]], node))
            points, order = points[turn], order[turn]
    return Tree(points, order.astype(np.int32), low, high, sums)


def packed(trees: list[Tree]) -> tuple[bytes, bytes, bytes, bytes]:
    """Points, orders, boxes and sums of the trees over the parts of one block."""
    boxes = [x for t in trees for pair in zip(t.low, t.high, strict=True) for x in pair]
    return (
        b"".join(np.ascontiguousarray(t.points, np.int32).tobytes() for t in trees), b"".join(t.order.tobytes() for t in trees),
        b"".join(np.ascontiguousarray(x, np.int32).tobytes() for x in boxes), b"".join(x.tobytes() for t in trees for x in t.sums),
    )


def unpacked(n: int, shape: Shape, points: bytes, order: bytes, boxes: bytes, sums: bytes) -> list[Tree]:
    levels = 1 << np.arange(depth(n) + 1)
    nodes, first = int(levels.sum()), np.concatenate([[0], np.cumsum(levels)])
    pts = np.frombuffer(points, np.int32).reshape(shape.parts, n, shape.width)
    turn = np.frombuffer(order, np.int32).reshape(shape.parts, n)
    box = np.frombuffer(boxes, np.int32).reshape(shape.parts, 2 * nodes, shape.width)
    total = np.frombuffer(sums, np.int64).reshape(shape.parts, nodes, shape.width)
    out = []
    for p in range(shape.parts):
        cut = [box[p, 2 * a : 2 * b].reshape(2, b - a, shape.width) for a, b in zip(first[:-1], first[1:], strict=True)]
        out.append(Tree(pts[p], turn[p], [c[0] for c in cut], [c[1] for c in cut], [total[p, a:b] for a, b in zip(first[:-1], first[1:], strict=True)]))
    return out


def exact_kind(limit: int, width: int):
    """The fastest type in which squared distances of doubled coordinates of at most this size are exact."""
    most = 16 * limit * limit * max(width, 1)
    if most >= 1 << 62:
        raise ValueError("components are too large for exact squared distances in 64 bits")
    return np.float64 if most < 1 << 53 else np.int64


def descend(tree: Tree, book: np.ndarray):
    """Yield what is assigned: (first point, end point, entry, sum) of whole subtrees, and (places, entries) of points one by one.

    The former come as four arrays under the key "nodes", the latter as two under "points".
    """
    n, k = len(tree.points), len(book)
    limit = max(int(np.abs(tree.low[0].astype(np.int64)).max()), int(np.abs(tree.high[0].astype(np.int64)).max()), int(np.abs(book).max()))
    kind = exact_kind(limit, book.shape[1])
    far = np.inf if kind is np.float64 else np.iinfo(np.int64).max
    entries, number = book.astype(kind), np.arange(k)
    size = (entries * entries).sum(1)
    node, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(depth(n) + 1):
        at = bounds(n, level)
        low, high = tree.low[level][node].astype(kind), tree.high[level][node].astype(kind)
        twice = low + high
        # |2c - (low + high)|^2 without the part that all entries share.
        near = np.where(alive, 4 * size - 4 * (twice @ entries.T), far).argmin(1)
        best = entries[near]
        # The corner of the box that lies farthest towards an entry, seen from the best: if even that is no nearer to it, no point is.
        corner = np.where(entries[None] > best[:, None], high[:, None], low[:, None])
        ahead = ((entries[None] - corner) ** 2).sum(2) - ((best[:, None] - corner) ** 2).sum(2)
        alive &= (ahead < 0) | (ahead == 0) & (number <= near[:, None])
        alive[np.arange(len(node)), near] = True
        one = alive.sum(1) == 1
        done = node[one]
        yield "nodes", (at[done], at[done + 1], near[one], tree.sums[level][done])
        node, alive = node[~one], alive[~one]
        if not len(node):
            return
        if level == depth(n):
            count = at[node + 1] - at[node]
            place = np.repeat(at[node] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            x = tree.points[place].astype(kind)
            yield "points", (place, np.where(np.repeat(alive, count, 0), size - 2 * (x @ entries.T), far).argmin(1))
        else:
            node, alive = np.repeat(2 * node, 2) + np.tile([0, 1], len(node)), np.repeat(alive, 2, 0)


def gathered(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points of each entry."""
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    for kind, found in descend(tree, book):
        if kind == "nodes":
            start, end, entry, total = found
            np.add.at(sums, entry, total)
            np.add.at(counts, entry, end - start)
        else:
            place, entry = found
            np.add.at(sums, entry, tree.points[place].astype(np.int64))
            np.add.at(counts, entry, 1)
    return sums, counts


def assigned(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every point, in the order of the block's rows."""
    entry = np.empty(len(tree.points), np.int64)
    for kind, found in descend(tree, book):
        if kind == "nodes":
            start, end, which, _ = found
            length = end - start
            entry[np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64), length) + np.arange(length.sum())] = np.repeat(which, length)
        else:
            entry[found[0]] = found[1]
    apart = ((tree.points.astype(np.int64) - book[entry]) ** 2).sum(1)
    out, far = np.empty_like(entry), np.empty_like(entry)
    out[tree.order], far[tree.order] = entry, apart
    return out, far


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); an error where that does not fit 32 bits."""
    got = np.floor(values.astype(np.float64) * scale)
    if len(got) and np.abs(got).max() >= 1 << 31:
        raise ValueError("components are too large for exact squared distances in 64 bits")
    return got.astype(np.int32)


def kept(embeddings: DataFrame) -> DataFrame:
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.select("vec_id", "embedding", "label").filter("embedding IS NOT NULL AND size(embedding) > 0").filter(finite)


@dataclass
class Coded:
    """Codebooks (parts, entries, width), and the table of trees that they were fitted on."""

    books: np.ndarray
    trees: DataFrame | None
    shape: Shape

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def table(self) -> DataFrame:
        """vec_id, label, code and error of every vector of the trees."""
        books, shape = self.books, self.shape

        def walk(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    ids, labels, n, *trees = (batch.column(i)[row] for i in range(batch.num_columns))
                    found = [assigned(t, book) for t, book in zip(unpacked(n.as_py(), shape, *[t.as_py() for t in trees]), books, strict=True)]
                    digits = np.frombuffer(b"".join(b"%02x" % e for e in range(books.shape[1])), "S2")
                    code = np.stack([digits[e] for e, _ in found], 1)
                    text = pa.array(np.ascontiguousarray(code).view(f"S{2 * shape.parts}").ravel().astype(str), pa.string())
                    yield pa.RecordBatch.from_arrays([ids.values, labels.values, text, pa.array(sum(far for _, far in found))], names=["vec_id", "label", "code", "error"])

        ids, labels = (self.trees.schema[x].dataType.elementType for x in ("vec_ids", "labels"))
        schema = StructType([StructField("vec_id", ids), StructField("label", labels), StructField("code", StringType()), StructField("error", LongType())])
        return batched(self.trees).mapInArrow(walk, schema)


def _planted(rows: DataFrame, shape: Shape, scale: int) -> DataFrame:
    """One row per block of vectors: ids, labels, and the trees over its parts."""
    size = max(1, min(BLOCK_ROWS, BLOCK_VALUES // shape.dim))

    def plant(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                block = batch.slice(start, size)
                vectors, n = block.column(1), block.num_rows
                values = vectors.flatten().to_numpy(zero_copy_only=False)
                if len(values) != n * shape.dim or set(np.diff(vectors.offsets.to_numpy())) != {shape.dim}:
                    raise ValueError(f"vectors are not all of dimension {shape.dim}")
                points = whole(values, scale).reshape(n, shape.parts, shape.width)
                trees = packed([grow(np.ascontiguousarray(points[:, p])) for p in range(shape.parts)])
                offs = pa.array([0, n], pa.int32())
                lists = [pa.ListArray.from_arrays(offs, pa.concat_arrays([block.column(i)])) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([n], pa.int32()), *[pa.array([t], pa.binary()) for t in trees]], names=[f.name for f in schema.fields])

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    columns = [("vec_ids", ArrayType(kinds["vec_id"])), ("labels", ArrayType(kinds["label"])), ("n", IntegerType()), *[(x, BinaryType()) for x in ("points", "turns", "boxes", "sums")]]
    schema = StructType([StructField(*c) for c in columns])
    return batched(rows).mapInArrow(plant, schema)


def fitted(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Coded | None:
    """Codebooks after the rounds, over all kept vectors; None where there are none."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows = kept(embeddings)
    ids = [r.vec_id for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    seeds = rows.filter(F.col("vec_id").isin([x for x in ids if x is not None]) | (F.col("vec_id").isNull() if None in ids else F.lit(False)))
    first = seeds.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.col("vec_id").asc_nulls_last()).collect()
    if not first:
        return None
    shape = Shape(parts, len(first[0].embedding))
    if shape.dim % parts or len({len(r.embedding) for r in first}) > 1:
        raise ValueError(f"vectors must have one dimension, a multiple of {parts}")
    books = whole(np.array([r.embedding for r in first]).ravel(), scale).astype(np.int64).reshape(len(first), parts, shape.width).transpose(1, 0, 2)
    scratch = Scratch(embeddings.sparkSession, "codes")
    trees = scratch.written(_planted(rows, shape, scale), "trees")
    for _ in range(rounds):
        books = _round(trees, shape, books)
    return Coded(books, trees, shape)


def _round(trees: DataFrame, shape: Shape, books: np.ndarray) -> np.ndarray:
    """The codebooks of the means of what each entry is nearest to."""

    def gather(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                n, *data = (batch.column(i)[row].as_py() for i in range(batch.num_columns))
                for p, tree in enumerate(unpacked(n, shape, data[0], np.zeros(n * shape.parts, np.int32).tobytes(), *data[1:])):
                    got, many = gathered(tree, books[p])
                    sums[p] += got
                    counts[p] += many
        both = np.concatenate([sums.ravel(), counts.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both), dtype=np.int32)), pa.array(both)], names=["place", "total"])

    found = batched(trees.select("n", "points", "boxes", "sums")).mapInArrow(gather, "place int, total long").groupBy("place").agg(F.sum("total").alias("total"))
    both = np.zeros(books.size + books.shape[0] * books.shape[1], np.int64)
    for r in found.collect():  # entries x dimensions sums and the counts, whatever the table
        both[r.place] = r.total
    sums, counts = both[: books.size].reshape(books.shape), both[books.size :].reshape(books.shape[:2])
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def vector_codes(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row per kept vector: vec_id, its code, its error, the errors of its label together, and the codebooks' digest."""
    spark = embeddings.sparkSession
    coded = fitted(embeddings, parts, entries, rounds, scale)
    if coded is None:
        return spark.createDataFrame([], StructType([embeddings.schema["vec_id"], *StructType.fromDDL("code string, error long, label_error long, codebooks_sha256 string").fields]))
    scratch = Scratch(spark, "codes")
    rows = scratch.written(coded.table(), "coded")
    sums = scratch.written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "label_of")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("label_of")), "left").select("vec_id", "code", "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))
