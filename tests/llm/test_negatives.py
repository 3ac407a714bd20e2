"""Hard negatives against all pairs, and on odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.llm import hard_negatives
from gavel.llm.hard_negatives import Index, codebook, mine_hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, every=5):
    kept = []
    for i, vec, label in rows:
        if i is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        kept.append((i, [math.floor(256 * x) for x in vec], label))
    out = []
    for k, (i, a, label) in enumerate(kept):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), j, n == label) for m, (j, b, n) in enumerate(kept) if m != k]  # noqa: B905
        for p, j, _ in sorted(x for x in scored if x[2])[:5]:
            inside = sorted((s, n) for s, n, same in scored if not same and -50 * p <= -100 * s <= -95 * p)[:3]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **given):
    table = spark.createDataFrame(rows, given.pop("schema", SCHEMA)).repartition(3)
    return sorted(tuple(r) for r in mine_hard_negatives(table, F.col("vec_id") % 5 == 0, **given).collect())


def clustered(rng, n, dims=6, labels=3):
    heads = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    return [(k, [x + rng.gauss(0, 0.1) for x in rng.choice(heads)], rng.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("first_rows", [4096, 20])
def test_mining_matches_all_pairs(spark, first_rows, monkeypatch):
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", first_rows)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 4)
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "LANES", 5 if first_rows == 20 else 64)
    monkeypatch.setattr(hard_negatives, "REQUEST_BYTES", 2000)
    rng = random.Random(4)
    rows = clustered(rng, 300)
    rows += [(1000 + k, rows[3][1], 1) for k in range(90)]  # one vector that a fifth of the rows share
    rows += [(2000, rows[5][1], 7), (2005, rows[6][1], 8), (2010, [0.0] * 6, 0), (2015, [-1.0] * 6, 9), (2016, [1.0] * 6, 9)]  # lonely labels, zero and negative scores
    got = mined(spark, rows)
    assert got == brute(rows)
    assert len(got) > 500


def test_odd_rows(spark):
    good = clustered(random.Random(8), 40, 3)
    nan, inf = float("nan"), float("inf")
    rows = [*good, (50, None, 1), (55, [1.0, None, 2.0], 1), (60, [nan, 1.0, 1.0], 1), (65, [inf, 1.0, 1.0], 2), (70, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(75, [], 1), (80, [1.0], 1), (85, [0.5, 0.25, 0.125, 4.0], 2), (10, good[10][1], good[10][2]), (10, good[10][1], good[10][2]), (11, good[11][1], good[11][2])]
    assert mined(spark, rows) == brute(rows)
    clash = [(*r, "clash", 1, "c") for r in rows]
    assert mined(spark, clash, schema=SCHEMA + ", uid string, cell int, score string") == brute(rows)
    assert mined(spark, rows[:0]) == [] and mined(spark, [(3, [1.0], 1)]) == [] and mined(spark, [(5, [], 1), (6, [], 2), (7, [], 1)]) == [(5, 7, 1, 6, 0, 0)]
    with pytest.raises(ValueError):
        mined(spark, [(5, [1e300], 1), (6, [1e300], 2)])
    wide = [(k, [1e4 * x for x in v], n) for k, v, n in good]
    assert mined(spark, wide) == brute(wide)


def test_walk_gives_cells_by_falling_bound():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(500, 4))
    books = codebook(points[:, :2], 6), codebook(points[:, 2:], 5)
    own = [hard_negatives.nearest(p, b)[0] for p, b in zip((points[:, :2], points[:, 2:]), books, strict=True)]
    radii = tuple(np.array([np.linalg.norm(p[o == k] - b[k], axis=1).max(initial=0) for k in range(len(b))]) for p, b, o in zip((points[:, :2], points[:, 2:]), books, own, strict=True))
    cells = own[0] * 5 + own[1]
    index = Index(books, radii, np.bincount(cells, minlength=30), np.ones(30, int), 64)
    first, second = index.half_bounds(points[:3])
    for k in range(3):
        walk = list(index.cells(first[k], second[k], -np.inf))
        assert sorted(c for c, _ in walk) == np.unique(cells).tolist()
        assert all(a >= b for (_, a), (_, b) in zip(walk, walk[1:], strict=False))
        for cell, bound in walk:
            assert (points[cells == cell] @ points[k]).max() <= bound
