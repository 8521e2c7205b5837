"""The pooled model: leakage, its trees, its panel, and the table of all models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import forecast, pooled


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{k}", i, float(100 * (k + 1) * (1 + 0.4 * np.sin(2 * np.pi * i / 52)) + rng.normal() * 5)) for k in range(5) for i in range(190) if not (k == 3 and i % 9 == 0)]
    frame = spark.createDataFrame(rows, "series_id string, i int, value double")
    return frame.select("series_id", F.expr("date_add(date '2015-01-05', 7 * i)").alias("period"), "value").cache()


def split_of(rows):
    return forecast.folds(forecast.placed(rows.where(F.col("series_id") == pooled.TOTAL)), 12, 2)


def test_panel(values):
    got = {(r.series_id, r.period): r.value for r in pooled.panel(values, 3).collect()}
    want = {(r.series_id, r.period): r.value for r in values.collect()}
    periods = {p for _, p in want}
    assert {s for s, _ in got} == {"s4", "s3", "s2", pooled.TOTAL} and len(got) == 4 * len(periods) == 4 * 190
    for s, p in got:
        assert got[s, p] == pytest.approx(sum(v for (_, q), v in want.items() if q == p) if s == pooled.TOTAL else want.get((s, p), 0.0))


def test_no_value_after_the_training_changes_a_forecast(spark, values):
    """A planted value in a fold's test periods leaves that fold's forecasts as they are, and moves those of the folds that train on it."""
    rows = pooled.panel(values, 5)
    split = split_of(rows)
    ends = {r.fold: r.end for r in split.where("role = 'train'").groupBy("fold").agg(F.max("period").alias("end")).collect()}
    planted = rows.withColumn("value", F.when((F.col("period") > F.lit(ends[1])) & (F.col("period") <= F.date_add(F.lit(ends[1]), 21)), 1e6).otherwise(F.col("value")))
    one, two = ({(r.fold, r.series_id, r.step): r.forecast for r in pooled.pooled(pooled.histories(x, split), 12, rounds=20).collect()} for x in (rows, planted))
    assert len(one) == 3 * 6 * 12 and set(one) == set(two)
    assert all(one[k] == two[k] for k in one if k[0] == 1) and any(one[k] != two[k] for k in one if k[0] == 2) and any(one[k] != two[k] for k in one if k[0] == 0)


def test_features_know_only_the_past(values):
    rows = pooled.panel(values, 2)
    got = pooled.features(pooled.histories(rows, split_of(rows)), 12).where("fold = 1 and series_id = 's4'").orderBy("period").collect()
    x = [(r.value - r.centre) / r.width for r in got]
    for k, r in enumerate(got):
        assert r.lag_1 == (x[k - 1] if k else None) and r.lag_52 == (x[k - 52] if k >= 52 else None)
        assert r.targets == [x[k + h] if k + h < len(x) else None for h in range(1, 13)] and r.last == (k == len(x) - 1)
        assert r.mean_4 == (pytest.approx(np.mean(x[max(0, k - 4) : k])) if k >= 2 else None) and r.sd_12 == (pytest.approx(np.std(x[max(0, k - 12) : k], ddof=1)) if k >= 6 else None)


def test_trees_split_where_all_splits_say():
    """One tree of one level against every cut of every feature; many trees against what they approach."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, size=(300, 3)).astype(float)
    y = np.where(x[:, 1] > 6, 3.0, -1.0) + rng.normal(size=300) * 0.1
    tree = pooled.BoostedTrees(rounds=1, rate=1.0, depth=1, least=5, ridge=0.0).fit(x, y)
    best = max((((y[x[:, f] <= c] - y.mean()).sum() ** 2) * (1 / n + 1 / (300 - n)), f, c) for f in range(3) for c in range(11) if 5 <= (n := int((x[:, f] <= c).sum())) <= 295)
    left = x[:, best[1]] <= best[2]
    assert np.allclose(tree.predict(x), np.where(left, y[left].mean(), y[~left].mean()))
    z = rng.normal(size=(3000, 4))
    target = np.sin(2 * z[:, 0]) + z[:, 1] * (z[:, 2] > 0)
    fresh = rng.normal(size=(500, 4))
    error = pooled.BoostedTrees().fit(z, target).predict(fresh) - (np.sin(2 * fresh[:, 0]) + fresh[:, 1] * (fresh[:, 2] > 0))
    assert np.mean(error**2) < 0.1 * target.var()
    flat = pooled.BoostedTrees(rounds=3).fit(np.ones((50, 2)), np.full(50, 7.0))
    assert np.allclose(flat.predict(np.zeros((2, 2))), 7.0)
    few = pooled.BoostedTrees(rounds=3, least=60).fit(z[:50], target[:50])
    assert np.allclose(few.predict(z[:50]), target[:50].mean(), atol=1e-9)


def test_filled_goes_forward_then_back(spark):
    rows = [(0, "a", 1, None), (0, "a", 2, 5.0), (0, "a", 3, None), (0, "b", 1, None)]
    got = pooled.filled(spark.createDataFrame(rows, "fold long, series_id string, step long, forecast double")).collect()
    assert sorted((r.series_id, r.step, r.forecast) for r in got) == [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 1, 0.0)]


def test_experiment(values):
    rows = pooled.panel(values, 5)
    split = split_of(rows)
    found = pooled.experiment(split, pooled.histories(rows, split), 12, 52, rounds=40)
    got = found.collect()
    models = {r.model for r in got}
    assert models == {"naive", "seasonal_naive", "seasonal_naive_drift", "moving_average", "drift", "fourier", "ets", "pooled_trees", "combination_median"}
    for m in models:
        assert sorted((r.fold, r.step) for r in got if r.model == m) == [(f, s) for f in range(3) for s in range(1, 13)]
    assert {r.model for r in got if r.pooled} == {"pooled_trees", "combination_median"}
    for fold, step in ((0, 1), (2, 12)):
        each = [r.forecast for r in got if (r.fold, r.step) == (fold, step) and r.family != "combination"]
        assert next(r.forecast for r in got if (r.fold, r.step, r.family) == (fold, step, "combination")) == pytest.approx(np.median(each))
    table = pooled.results_table(found).collect()
    assert [r.place for r in sorted(table, key=lambda r: r["mean"])] == list(range(1, 10)) and all(set(r.folds) == {1, 2} for r in table)
    wide = {r.model: r for r in pooled.by_fold(found, 2).collect()}
    assert all(wide[r.model].holdout == pytest.approx(r.holdout) and wide[r.model].fold_1 == pytest.approx(r.folds[1]) for r in table)


def test_short_series_and_empty_panels(spark, values):
    short = pooled.panel(values.where("period < date '2015-06-01'"), 5)
    split = split_of(short).where("fold = 0")
    got = pooled.pooled(pooled.histories(short, split), 12, rounds=2).collect()
    assert got and {r.forecast for r in got} == {0.0} and {r.training_rows for r in got} == {0}
    assert pooled.panel(values.limit(0)).count() == 0
