import math

import pytest

from quern.operators import choice

NAMES = ("a", "b")


def blobs(spark):
    spots = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    rows = [(x + 0.1 * (i % 5), y + 0.1 * (i % 7), c) for c, (x, y) in enumerate(spots) for i in range(35)]
    return spark.createDataFrame(rows, "x_a double, x_b double, cluster long"), rows


def test_every_measure_but_the_knee_rule_finds_three_blobs(spark):
    points, _ = blobs(spark)
    found = {r.k: r for r in choice.compared(points, NAMES, 2, 5, references=3, starts=6).collect()}
    assert sorted(found) == [2, 3, 4, 5]
    assert {"calinski_harabasz", "davies_bouldin", "silhouette"} <= set(found[3].preferred_by)
    assert found[3].reading == "well separated" and found[3].smallest_share == pytest.approx(1 / 3)
    assert found[2].within > found[3].within > found[4].within
    assert choice.compared(points.limit(0), NAMES).count() == 0
    assert [r.k for r in choice.compared(points.limit(1).union(points.limit(3)), NAMES, 2, 5, references=2).collect()] == [2]


def test_least_cost_of_a_fit(spark):
    sets = spark.createDataFrame([(0, [0.0]), (0, [1.0]), (0, [10.0]), (0, [12.0]), (1, [5.0]), (1, [5.0]), (1, [7.0])], "set long, v array<double>")
    found = choice.fits(sets, [1, 2], 1, starts=5)
    assert found[0, 2][0] == pytest.approx(0.5 + 2.0) and sorted(found[0, 2][1]) == [[0.5], [11.0]]
    assert found[0, 1][0] == pytest.approx(sum((x - 5.75) ** 2 for x in (0, 1, 10, 12)))
    assert found[1, 2][0] == pytest.approx(0.0)


def test_squared_silhouette_against_all_pairs(spark):
    points, rows = blobs(spark)
    rows = rows + [(50.0, 50.0, 9)]
    points = points.union(spark.createDataFrame([rows[-1]], points.schema))
    far = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2
    values = []
    for i, p in enumerate(rows):
        by = {}
        for j, q in enumerate(rows):
            if i != j:
                by.setdefault(q[2], []).append(far(p, q))
        if p[2] not in by:
            values.append(0.0)
            continue
        a, b = sum(by[p[2]]) / len(by[p[2]]), min(sum(v) / len(v) for c, v in by.items() if c != p[2])
        values.append((b - a) / max(a, b))
    got = choice.silhouette_squared(points, NAMES).first()
    assert got.points == len(rows) and got.silhouette_squared == pytest.approx(sum(values) / len(values))


def test_gap_rule():
    costs = {(0, 2): 4.0, (0, 3): 1.0, (0, 4): 0.9, (1, 2): 8.0, (1, 3): 6.0, (1, 4): 5.0, (2, 2): 8.0, (2, 3): 6.0, (2, 4): 5.0}
    rows, k = choice.gaps(costs, [2, 3, 4], 2)
    assert rows[0] == (2, pytest.approx(math.log(2)), pytest.approx(0.0)) and k == 3
    assert choice.gaps({**costs, (0, 4): 0.1}, [2, 3, 4], 2)[1] is None
