"""Ward's tree, assignment of clusters, and clusters over windows."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import segments
from quern.operators.ward import cut, merges, ward


def brute(points, k):
    groups = [[i] for i in range(len(points))]
    rise = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((points[a].mean(0) - points[b].mean(0)) ** 2).sum()
    while len(groups) > k:
        _, i, j = min((rise(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    out = np.empty(len(points), int)
    for c, g in enumerate(groups):
        out[g] = c
    return out


def same(a, b):
    return ((a[:, None] == a) == (b[:, None] == b)).all()


@pytest.mark.parametrize("seed", range(4))
def test_merges_against_least_rise(seed):
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal(c, 0.6, size=(15, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 4, 0))])
    for k in (1, 2, 3, 5, 9):
        assert same(cut(np.ones(len(points)), points, k), brute(points, k))
    assert sum(c for *_, c in merges(np.ones(len(points)), points)) == pytest.approx(((points - points.mean(0)) ** 2).sum())


def test_ward_of_points_and_of_cells(spark):
    rng = np.random.default_rng(7)
    centres = ((0.0, 0.0), (4.0, 0.0), (0.0, 5.0))
    rows = [(k, *map(float, rng.normal(centres[k % 3], 0.5))) for k in range(300)]
    frame = spark.createDataFrame(rows + rows[:5], "customer long, x_a double, x_b double")
    points = np.array([r[1:] for r in rows])
    exact = {r.customer: r.cluster for r in ward(frame, 4, ("a", "b")).collect()}
    weights = np.ones(300)
    weights[:5] = 2
    assert same(np.array([exact[k] for k in range(300)]), cut(weights, points, 4))
    few = ward(frame, 3, ("a", "b"), leaves=60)
    got = {r.customer: r.cluster for r in few.collect()}
    assert few.count() == 305 and same(np.array([got[k] for k in range(300)]), np.arange(300) % 3)
    assert ward(frame.limit(0), 3, ("a", "b")).count() == 0


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(3)
    for k in (1, 2, 5, 7):
        for _ in range(5):
            gain = rng.integers(0, 30, size=(k, k)).astype(float)
            best = max(sum(gain[i, p[i]] for i in range(k)) for p in permutations(range(k)))
            got = segments.assigned(gain)
            assert sorted(got) == list(range(k)) and gain[np.arange(k), got].sum() == best
    planted = rng.permutation(30)
    gain = rng.random((30, 30))
    gain[np.arange(30), planted] += 1
    assert (segments.assigned(gain) == planted).all()


def test_labels_are_named_after_the_window_before(spark):
    rows = [(1, c, "x" if c < 6 else "y") for c in range(10)] + [(2, c, "0" if c >= 6 else "1") for c in range(10)] + [(3, c, str(c % 3)) for c in range(10)]
    got = {(r.window, r.customer): r.label for r in segments.aligned(spark.createDataFrame(rows, "window int, customer long, label string")).collect()}
    assert all(got[2, c] == got[1, c] for c in range(10)) and {got[3, c] for c in range(10)} > {"x", "y"} and len({got[3, c] for c in range(10)}) == 3
    table = spark.createDataFrame([(f"a{k}", f"b{(k + 1) % 12}", 5) for k in range(12)], "a string, b string, n long")
    assert segments.matched(table) == {f"b{(k + 1) % 12}": f"a{k}" for k in range(12)}


def test_clusters_over_windows_and_against_bands(spark):
    rng = np.random.default_rng(1)
    rows = [(w, c, float(5 + 300 * (c % 3) + rng.normal()), float(1 + 10 ** (c % 3)), float(20.0 * 9 ** (c % 3) + rng.normal())) for w in (1, 2) for c in range(90)]
    snaps = spark.createDataFrame(rows, "window int, customer long, recency double, frequency double, monetary double")
    for algorithm in ("kmeans", "ward"):
        labels = segments.cluster_windows(snaps, 3, algorithm, starts=2)
        got = segments.stability(labels).first()
        assert got.adjusted_rand == pytest.approx(1.0) and got.retention == pytest.approx(1.0) and got.customers == 90
    bands = snaps.where("window = 1").select("customer", F.concat(F.lit("band "), (F.col("customer") % 3).cast("string")).alias("band"))
    wide = segments.against(labels.where("window = 1").select("customer", "label"), bands, ["band 0", "band 1", "band 2", "none"]).collect()
    assert len(wide) == 3 and all(r.largest_share == 1.0 and r[r.largest] == 30 and r["none"] == 0 for r in wide)
