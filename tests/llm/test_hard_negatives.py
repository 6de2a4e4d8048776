"""Hard negatives next to all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every: int, positives: int = 5, negatives: int = 5, percent: int = 80):
    kept = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, tuple(math.floor(256 * x) for x in v), label))
    out = []
    for i, v, label in kept:
        if i % every:
            continue
        score = lambda w: max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True))))  # noqa: B023, E731
        same = sorted((-score(w), j) for j, w, m in kept if m == label and (j, w, m) != (i, v, label))[:positives]
        other = sorted((-score(w), j) for j, w, m in kept if m != label)
        for p, j in same:
            fits = [(-n, x) for n, x in other if percent * -p <= 100 * -n <= 100 * -p][:negatives]
            out += [(i, j, r + 1, x, -p, n) for r, (n, x) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, every: int, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in H.mine(df, F.col("id") % every == 0, **more).collect())


def vectors(n: int, dim: int, labels: int, seed: int, spread: float = 1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(8, size=n)] + spread * rng.normal(size=(n, dim))
    return [(i, [float(a) for a in v / np.linalg.norm(v)], int(m)) for i, (v, m) in enumerate(zip(x, rng.integers(labels, size=n), strict=True))]


@pytest.mark.parametrize("spread", [0.1, 2.0])
def test_like_all_pairs(spark, spread):
    rows = vectors(600, 12, 3, 1, spread)
    expected = brute(rows, 10)
    assert expected
    assert mined(spark, rows, 10, clusters=5, part_rows=60, anchor_block=16) == expected


def test_ties_copies_nulls_and_zeros(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) / 16 for x in rng.integers(-2, 3, size=3)], int(i % 2)) for i in range(200)]
    rows += [(1000 + i, [0.5, 0.25, 0.125], int(i % 3)) for i in range(150)]
    rows += [(2000 + i, [0.0, 0.0, 0.0], 1) for i in range(20)]
    rows += [(0, [1.0, 1.0, 1.0], 0), (0, [0.5, 0.25, 0.125], 0), (10, [0.5, 0.25, 0.125], 0), (10, [0.5, 0.25, 0.125], 0)]
    bad = [(None, [1.0, 1.0, 1.0], 0), (20, None, 0), (30, [1.0, 1.0, 1.0], None), (40, [float("nan"), 1.0, 1.0], 0), (50, [float("inf"), 1.0, 1.0], 1), (60, [None, 1.0, 1.0], 1)]
    short = [(70, [1.0], 0), (80, [], 1)]
    assert mined(spark, rows + bad + short, 10, part_rows=50, anchor_block=8) == brute(rows + bad, 10)


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-(2**24), 2**24, size=4)], int(i % 2)) for i in range(60)]
    rows += [(100 + i, [1e30, float(i), 1.0, 2.0], int(i % 2)) for i in range(4)] + [(200 + i, [1e-200, 0.25, -1e-9, 0.1], int(i % 2)) for i in range(10)]
    assert mined(spark, rows, 5) == brute(rows, 5)


def test_empty_and_lonely(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, [1.0], 0)], 10) == []
    assert mined(spark, [(10, [1.0], 0)], 10) == []
    rows = [(10, [1.0, 0.5], 0), (11, [1.0, 0.5], 0), (12, [0.9, 0.5], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "vector", "gid", "part", "ids", "tops", "v")})
    assert sorted(tuple(r) for r in H.mine(df, F.col("id") % 10 == 0).collect()) == brute(rows, 10)


def test_lists_are_left_early():
    """Where directions are close together, members stop long before their lists end."""
    import pandas as pd

    rows = vectors(4000, 16, 2, 4, 0.05)
    items = pd.DataFrame({"label": [r[2] for r in rows], "vector": [np.floor(256 * np.array(r[1])) for r in rows], "ids": [[r[0]] for r in rows]})
    anchors = items.iloc[::100].assign(gid=range(40), floor=H.LOW, wanted=None)
    anchors["cluster"] = 0
    seen = []
    whole, step = H.products, H.STEP

    def counting(a, b, reach):
        seen.append(len(a))
        return whole(a, b, reach)

    H.products, H.STEP = counting, 64
    try:
        for gid in range(40):
            centre = H.directions(np.vstack(anchors["vector"][anchors["gid"] == gid].to_numpy()))
            list(H.walk(items, anchors[anchors["gid"] == gid], centre, 6, 80))
    finally:
        H.products, H.STEP = whole, step
    assert sum(seen) < 0.25 * 40 * len(items)
