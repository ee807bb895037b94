"""Product codes by filtering Lloyd rounds against plain loops, and the cases that the table has not."""

import hashlib
import math
import random

import numpy as np
import pytest

from siltstone.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, label_error long"


def plain(rows, parts, entries, rounds, scale):
    """code, error and label_error by row, and the codebooks' digest, by loops over everything."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(scale * x) for x in r[1]] for r in kept]
    ids = sorted({r[0] for r in kept if r[0] is not None}) + [None] * any(r[0] is None for r in kept)
    first = [min((r[1], v) for r, v in zip(kept, ints) if r[0] == i)[1] for i in ids[:entries]]
    width = len(first[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for v in first] for p in range(parts)]
    near = lambda v, p: min(range(len(first)), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        which = [[near(v, p) for p in range(parts)] for v in ints]
        for p in range(parts):
            for e in range(len(first)):
                mine = [cut(v, p) for v, w in zip(ints, which) if w[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    which = [[near(v, p) for p in range(parts)] for v in ints]
    errors = [sum(far(cut(v, p), books[p][w[p]]) for p in range(parts)) for v, w in zip(ints, which)]
    by_label = {r[2]: sum(e for s, e in zip(kept, errors) if s[2] == r[2]) for r in kept}
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for e in w), err, by_label[r[2]], digest) for r, w, err in zip(kept, which, errors)), key=repr)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)


def got(df, **kw):
    return sorted((tuple(r) for r in V.vector_codes(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("kind", ["normal", "lattice", "same", "large"])
def test_codes_are_those_of_plain_rounds(spark, monkeypatch, kind):
    rng = random.Random(kind)
    draw = {"normal": lambda: rng.gauss(0, 0.2), "lattice": lambda: rng.randrange(-2, 3) / 4096, "same": lambda: 0.25, "large": lambda: rng.choice([-1, 1]) * rng.uniform(1e4, 4e4)}[kind]
    rows = [(rng.randrange(400), [draw() for _ in range(16)], rng.choice([None, 1, 2])) for _ in range(700)]
    rows = [(i, np.array(v, np.float32).astype(float).tolist(), c) for i, v, c in rows]
    rows += [rows[5]] * 3 + [(None, rows[0][1], None), (3, None, 1), (4, [], 1), (-1, [float("nan")] * 16, 2), (-2, [float("inf")] + [0.0] * 15, 2), (-3, [None] + [0.0] * 15, 2)]
    assert got(made(spark, rows)) == plain(rows, 8, 16, 6, 4096)
    assert got(made(spark, rows), parts=2, entries=5, rounds=2, scale=64) == plain(rows, 2, 5, 2, 64)
    monkeypatch.setattr(V, "BROADCAST_LABELS", 0)
    assert got(made(spark, rows), rounds=1) == plain(rows, 8, 16, 1, 4096)


def test_few_vectors_empty_tables_and_wrong_ones(spark):
    rows = [(7, [0.5] * 8, 1), (2, [-0.5] * 8, None)]
    assert got(made(spark, rows)) == plain(rows, 8, 16, 6, 4096)
    assert got(made(spark, [])) == [] and got(made(spark, [(1, None, 2)])) == []
    assert V.vector_codes(made(spark, [])).columns == V.vector_codes(made(spark, rows)).columns
    with pytest.raises(Exception, match="dimension"):
        got(made(spark, [*rows, (9, [0.0] * 16, 1)]))
    with pytest.raises(Exception, match="too large"):
        got(made(spark, [(1, [3e38] * 8, 1)]))


def test_subtrees_are_assigned_without_their_points(spark):
    """Far groups of points are given away as a few nodes; every point is given to one entry."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-50, 50, (512, 4)) + c for c in (0, 10_000, -10_000, 70_000)]).astype(np.int32)
    book = np.array([[0] * 4, [10_000] * 4, [-10_000] * 4, [70_000] * 4])
    tree = V.grow(points)
    found = list(V.descend(tree, book))
    assert sum(len(x[0]) for k, x in found if k == "nodes") <= 8 and not [x for k, x in found if k == "points"]
    entry, apart = V.assigned(tree, book)
    want = ((points[:, None].astype(np.int64) - book) ** 2).sum(2)
    assert (entry == want.argmin(1)).all() and (apart == want.min(1)).all()
