"""Operator 13 against all scores."""

import math

import numpy as np
from pyspark.sql import functions as F

from notedrift.llm import negatives as N

SHAPE = "vec_id long, embedding array<double>, label int, unit int, node int, score int, part int, lows int"


def brute(rows, positives=5, negatives=10, low=30, high=90, scale=256):
    own = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in rows
           if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v, g) in enumerate(own):
        if i % 100:
            continue
        met = sorted((-sum(a * b for a, b in zip(v, w)), j, m, h) for m, (j, w, h) in enumerate(own) if m != n and len(w) == len(v))
        for s, j, _, _ in [x for x in met if x[3] == g][:positives]:
            fits = [x for x in met if x[3] != g and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, g, 1, 1, 1, 1, 1) for i, v, g in rows], SHAPE).repartition(3)
    return sorted(tuple(r) for r in N.mine(df, F.col("vec_id") % 100 == 0, **options).collect())


def table(rng, n, d, groups=0):
    centres = rng.standard_normal((max(groups, 1), d))
    rows = []
    for i in range(n):
        v = rng.standard_normal(d) if not groups else centres[rng.integers(groups)] + 0.4 * rng.standard_normal(d)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(4))))
    return rows


def test_negatives_equal_all_scores(spark, monkeypatch):
    monkeypatch.setattr(N, "SEGMENT", 8)
    rng = np.random.default_rng(3)
    for groups, d in ((0, 16), (6, 8)):
        rows = table(rng, 700, d, groups)
        # ties and repeats: equal vectors under other ids and labels, a repeated anchor, a long-lived tie
        rows += [(1000 + i, rows[5][1], i % 3) for i in range(30)] + [rows[0], rows[100]]
        rows += [(2000, [0.0] * d, 1), (2100, [0.0] * d, 2), (2001, [0.001] * d, 1), (2200, [-x for x in rows[7][1]], 0)]
        rows += [(None, rows[1][1], 1), (3000, None, 1), (3100, rows[1][1], None), (3200, [None] + rows[1][1][1:], 1), (3300, [float("nan")] * d, 1),
                 (3400, [float("inf")] * d, 1), (3500, [1.0, 2.0, 3.0], 1), (3501, [1.0, 2.0, 2.0], 1), (3502, [1.0, 1.0, 1.0], 2), (3600, [], 0), (3601, [], 1)]
        want = brute(rows)
        assert len(want) > 100
        assert run(spark, rows) == want


def test_negatives_of_parts_and_blocks(spark, monkeypatch):
    """A hot vector over many parts, anchors in several blocks, other limits."""
    monkeypatch.setattr(N, "PART", 50)
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "HELD", 100)
    rng = np.random.default_rng(4)
    rows = table(rng, 600, 6, 4) + [(10_000 + i, [0.5, 0.5, 0.5, 0.5, 0.0, 0.0], i % 3) for i in range(300)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, positives=2, negatives=4, low=0, high=100, scale=1000) == brute(rows, 2, 4, 0, 100, 1000)


def test_large_components_are_exact(spark):
    """Products beyond 53 bits are summed as whole numbers."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(5) * 200_000).tolist(), i % 2) for i in range(0, 400, 4)]
    assert run(spark, rows) == brute(rows)
    # a norm of 2**28 or more takes no part
    assert run(spark, [*rows, (4000, [1e9, 1.0, 0.0, 0.0, 0.0], 0), (4001, [1e300] * 5, 1)]) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0, 0.0], 1), (100, None, 1)]) == []
    assert run(spark, [(100, [1.0, 0.0], 1), (101, [1.0, 0.0], 1)]) == []


def test_bounds_hold_the_scores():
    rng = np.random.default_rng(6)
    a, x, r = (np.floor(256 * rng.standard_normal((n, 5))) for n in (40, 50, 3))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    stored = lambda m: np.rint(np.arccos(np.clip(unit(m) @ unit(r).T, -1, 1)) / N.STEP) * N.STEP
    ta, tx = stored(a)[:, None], stored(x)[None]
    low, high = np.abs(ta - tx).max(axis=2), np.minimum(ta + tx, 2 * np.pi - ta - tx).min(axis=2)
    norms = np.linalg.norm(x, axis=1)
    under, over = N.score_bounds(low, high, np.linalg.norm(a, axis=1)[:, None], norms, norms)
    assert (under <= a @ x.T).all() and (a @ x.T <= over).all()
