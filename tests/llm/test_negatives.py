"""Hard negatives against brute force: odd rows, ties, hot vectors, large numbers, many cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowrelay.llm import covertree, negatives
from rowrelay.llm.covertree import NONE, CoverTree

SCHEMA = "vec_id bigint, label int, embedding array<double>, cell int, vec string, block int, anchor_id string, score double, v int"


def brute(rows, is_anchor, label):
    points = {}
    for i, own, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None), key=lambda r: r[:2]):
        if all(x is not None and math.isfinite(x) for x in v):
            if i not in points or (own, v) < points[i][0]:
                points[i] = ((own, v), label(i, own), [math.floor(256 * x) for x in v])
    out = []
    for a, (_, la, va) in points.items():
        if is_anchor(a):
            scores = sorted((-sum(x * y for x, y in zip(va, vb)), b, lb == la) for b, (_, lb, vb) in points.items() if b != a)  # noqa: B905
            for ps, p, _ in [x for x in scores if x[2]][:5]:
                fits = [(s, b) for s, b, same in scores if not same and 80 * -ps <= 100 * -s <= 100 * -ps]
                out += [(a, p, n + 1, b, -ps, -s) for n, (s, b) in enumerate(fits[:5])]
    return sorted(out)


def found(spark, rows, every=10):
    frame = spark.createDataFrame([(*r, *[1, "x", 2, None, None, 3]) for r in rows], SCHEMA)
    vec_id, label = F.col("vec_id"), F.col("label")
    got = negatives.hard_negatives(frame, vec_id % every == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def expected(rows, every=10):
    return brute(rows, lambda i: i % every == 0, lambda i, own: (own + 1) % 10 if i % 7 == 0 else own)


@pytest.mark.parametrize("kind", ["odd", "ties", "large", "none"])
def test_equals_brute_force(spark, kind):
    rnd = random.Random(kind)
    rows = []
    for i in range(260):
        v = [rnd.gauss(0.3, 1) for _ in range(6)]
        if kind == "ties":
            v = [rnd.choice([0.0, 1.0, 0.5]) for _ in range(3)] if i % 3 else [1.0, 1.0, 1.0]
        if kind == "large":
            v = [x * 2.0 ** rnd.choice([0, 5, 16]) for x in v]
        rows.append((i, rnd.randrange(3), v))
    if kind == "odd":
        rows += [(None, 1, [1.0]), (300, None, [1.0]), (310, 1, None), (320, 1, [None, 1.0]), (330, 1, [float("nan")]), (340, 1, [float("inf")])]
        rows += [(350, 1, []), (351, 1, [0.0] * 6), (360, 2, [1.0, 2.0]), (361, 2, [1.0] * 9), (370, 1, [2.0] * 6), (370, 1, [1.0] * 6), (370, 2, [0.5] * 6), (371, 0, [1.0]), (371, 0, [1.0])]
        rows += [(-20, 1, [-1.0] * 6)]
    if kind == "none":
        rows = []
    got = found(spark, rows)
    assert got == expected(rows) and (got or kind == "none")


def test_many_cells_and_blocks(spark, monkeypatch):
    """A third of the rows is one vector; every cell has several blocks."""
    monkeypatch.setattr(negatives, "PER_CELL", 50)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 0)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(0, 4)), (centres[0] if i % 3 == 0 else centres[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(900)]
    assert found(spark, rows, 30) == expected(rows, 30)


def test_numbers_beyond_doubles(spark):
    """Products past 2^53 are exact; past 64 bits they fail the job."""
    rows = [(i, i % 2, [2.0**20 + i / 256, float(i), 1.0]) for i in range(60)]
    assert found(spark, rows) == expected(rows)
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(i, i % 2, [2.0**40 + i, 2.0**40]) for i in range(20)])


def test_tree_covers_and_leaves_out():
    rng = np.random.default_rng(1)
    centres = 400 * rng.normal(size=(40, 16))
    x = np.floor(centres[rng.integers(0, 40, 12000)] + 20 * rng.normal(size=(12000, 16)))
    ids, labels = rng.permutation(12000), rng.integers(0, 5, 12000)
    tree = CoverTree(x, ids, labels, float((x**2).sum(axis=1).max()) * 1.001)
    assert sorted(np.concatenate([rows for _, rows in tree.leaves]).tolist()) == list(range(12000))
    for level, parents in zip(tree.levels[1:], tree.parents[1:], strict=True):
        for node, parent in zip(level, parents, strict=True):
            assert np.linalg.norm(tree.centres[node] - tree.centres[parent]) <= tree.radii[parent] * (1 + 1e-9)
    for node, rows in tree.leaves:
        full = covertree.augmented(tree.x[rows], tree.longest2)
        assert np.linalg.norm(full - tree.centres[node], axis=1).max() <= tree.radii[node] * (1 + 1e-9)
    asked, seen = np.argsort(ids)[:50], []
    products = covertree.products

    def counted(q, rows):
        seen.append(len(q) * len(rows))
        return products(q, rows)

    covertree.products = counted
    try:
        everything = np.full(50, NONE + 1), np.full(50, 2**62)
        scores, got = tree.best(x[asked], ids[asked], labels[asked], True, *everything, 5)
    finally:
        covertree.products = products
    assert sum(seen) < 0.4 * 50 * 12000  # most points are never scored
    for row, i in enumerate(asked):
        want = sorted((-int(x[i] @ x[j]), int(ids[j])) for j in range(12000) if j != i and labels[j] == labels[i])[:5]
        assert [(-int(s), int(n)) for s, n in zip(scores[row], got[row], strict=True)] == want
