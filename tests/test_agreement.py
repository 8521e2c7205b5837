"""Kendall's agreement against all pairs."""

import math
import random

import numpy as np
import pytest

from quern.operators import agreement


def brute(rows):
    rows = [(x, y) for x, y in rows if x is not None and y is not None and not math.isnan(x) and not math.isnan(y)]
    c = d = tx = ty = tb = 0
    for i, (a, b) in enumerate(rows):
        for p, q in rows[:i]:
            s = (a > p) - (a < p), (b > q) - (b < q)
            c, d, tx, ty, tb = c + (s[0] * s[1] > 0), d + (s[0] * s[1] < 0), tx + (s[0] == 0), ty + (s[1] == 0), tb + (s == (0, 0))
    n0 = len(rows) * (len(rows) - 1) / 2
    bottom = math.sqrt((n0 - tx) * (n0 - ty))
    return len(rows), c, d, tx, ty, tb, (c - d) / bottom if bottom else None


@pytest.mark.parametrize("seed", range(30))
def test_inversions(seed):
    rng = random.Random(seed)
    n = rng.randint(0, 40)
    values, weights = np.array([rng.randint(0, rng.choice([1, 5, 100])) for _ in range(n)], np.int64), np.array([float(rng.randint(1, 4)) for _ in range(n)])
    assert agreement.inversions(values, weights) == sum(weights[i] * weights[j] for j in range(n) for i in range(j) if values[i] > values[j])


@pytest.mark.parametrize("kind", ["plain", "ties", "hot", "constant", "opposite", "empty"])
def test_against_all_pairs(spark, kind):
    rng = random.Random(kind)
    rows = {
        "plain": lambda: [(rng.random(), rng.random()) for _ in range(200)], "ties": lambda: [(float(rng.randint(0, 6)), float(rng.randint(0, 4))) for _ in range(250)],
        "hot": lambda: [(1.0 if k % 3 else rng.random(), rng.random()) for k in range(200)], "constant": lambda: [(2.0, rng.random()) for _ in range(30)],
        "opposite": lambda: [(float(k), float(-k)) for k in range(60)], "empty": lambda: [],
    }[kind]() + [(None, 1.0), (math.nan, 2.0)]
    frame = spark.createDataFrame(rows, "a double, b double").repartition(3)
    for parts in (1, 4, 9):
        got = agreement.kendall(frame, "a", "b", parts).first()
        want = brute(rows)
        assert tuple(got)[:6] == want[:6] and (got.tau_b == pytest.approx(want[6]) if want[6] is not None else got.tau_b is None)
