"""Ward's tree is the same however few clusters a task takes."""

import numpy as np
import pytest

from quern.operators import ward
from quern.operators.ward import chains, cut, merges


def placed(frame, k, leaves, count):
    got = {r.customer: r.cluster for r in ward.ward(frame, k, ("a", "b"), leaves=leaves).collect()}
    return np.array([got[c] for c in range(count)])


def expected(points, k):
    """Clusters of points, from 0 by their least point, by one task."""
    different, where, n = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    return cut(n, different, k)[where.ravel()]


@pytest.mark.parametrize("leaves", [20, 60])
def test_blocks_give_the_tree_of_one_task(spark, leaves):
    rng = np.random.default_rng(leaves)
    points = np.concatenate([rng.random((250, 2)), rng.normal(3, 0.4, (60, 2)), [(40.0, 0.0), (40.0, 0.9), (-30.0, 7.0)]])
    points = np.concatenate([points, points[:20]])
    frame = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "customer long, x_a double, x_b double")
    for k in (2, 5):
        assert (placed(frame, k, leaves, len(points)) == expected(points, k)).all()


def test_windows_share_rounds_and_stay_apart(spark):
    rng = np.random.default_rng(5)
    each = {w: rng.random((size, 2)) for w, size in ((0, 2), (1, 150), (2, 90))}
    frames = {w: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "customer long, x_a double, x_b double") for w, points in each.items()}
    for w, one in ward.ward_each(frames, 3, ("a", "b"), leaves=40).items():
        got = {r.customer: r.cluster for r in one.collect()}
        assert [got[c] for c in range(len(each[w]))] == expected(each[w], 3).tolist()


def test_points_in_a_row_do_not_stop_the_rounds(spark):
    """Gaps that grow leave one pair of nearest neighbours at a time, and points hardly apart leave no place to cut."""
    points = np.array([[x, 0.0] for x in np.cumsum(1 + 0.01 * np.arange(70))] + [[-5.0, np.nextafter(0, 1) * i] for i in range(30)])
    frame = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "customer long, x_a double, x_b double")
    assert (placed(frame, 4, 20, len(points)) == expected(points, 4)).all()


def test_what_may_be_nearer_outside_stays():
    centre = np.array([[0.0], [1.0], [10.0], [11.5]])
    assert len(merges(np.ones(4), centre)) == 3
    assert chains(np.ones(4), centre, lambda n, x: np.where(x[:, 0] < 5, np.inf, 1.0)) == [(0, 1, 0.5)]
    assert chains(np.ones(4), centre, lambda n, x: np.full(len(n), 0.5)) == []
