"""Mixtures of several sets in joint rounds against Spark's own fits, and the view by order against lines."""

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quern.operators import mixture, segments
from quern.sources.sales import order_sales, sales

NAMES = ("x_a", "x_b")


def test_joint_rounds_equal_sparks_fits(spark, monkeypatch):
    rng = np.random.default_rng(2)
    frames = {}
    for s in (4, 7):
        points = np.concatenate([rng.normal(at, wide, (60, 2)) for at, wide in (((0, 0), 1.0), ((s, 2), 0.5), ((1, s), 2.0))])
        frames[s] = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "customer long, x_a double, x_b double").coalesce(1)
    jobs, passed = [], mixture.fits
    monkeypatch.setattr(mixture, "fits", lambda *given: jobs.append(given) or passed(*given))
    got = segments.clustered_each(frames, 3, "mixture", ("a", "b"), starts=3)
    assert len(jobs) == 1 and len(jobs[0][1]) == 6
    best = passed(*jobs[0])
    for s, points in frames.items():
        rows = VectorAssembler(inputCols=NAMES, outputCol="_v").transform(points)
        models = [GaussianMixture(k=3, seed=17 + t, featuresCol="_v", predictionCol="other").fit(rows) for t in range(3)]
        model = max(models, key=lambda m: m.summary.logLikelihood)
        assert best[s][0] == pytest.approx(model.summary.logLikelihood, abs=1e-6)
        both = got[s].join(model.transform(rows).select("customer", "other"), "customer")
        assert got[s].columns == ["customer", *NAMES, "cluster"] and both.where("cluster = other").count() == 180


def test_a_component_without_spread_in_one_direction(spark):
    flat = mixture.Mixture(np.array([0.5, 0.5]), np.array([[0.0, 0.0], [1.0, 0.0]]), np.array([[[1.0, 0.0], [0.0, 0.0]]] * 2))
    points = spark.createDataFrame([(-1.0, 0.0), (2.0, 0.0)], "x_a double, x_b double")
    assert [r.cluster for r in mixture.labelled(points, flat, NAMES).orderBy("x_a").collect()] == [0, 1]
    with pytest.raises(ValueError):
        mixture.Mixture(np.ones(1), np.zeros((1, 2)), np.zeros((1, 2, 2))).densities()


def test_sums_by_order_equal_the_lines(spark, sf_dir):
    keys = ["invoice_id", "occurred_at", "customer_id", "is_return"]
    expected = sales(spark, sf_dir, *keys, "quantity", "revenue").groupBy(*keys).agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"), F.count("*").alias("lines"))
    got = order_sales(spark, sf_dir).select(expected.columns)
    assert got.count() == expected.count() and got.exceptAll(expected).count() == 0


def test_windows_share_their_rounds(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(w, c, float(5 + 300 * (c % 3) + rng.normal()), float(1 + 10 ** (c % 3) + rng.random()), float(20.0 * 9 ** (c % 3) + rng.normal())) for w in (1, 2) for c in range(90)]
    snaps = spark.createDataFrame(rows, "window int, customer long, recency double, frequency double, monetary double")
    given, passed = [], mixture.fits
    monkeypatch.setattr(mixture, "fits", lambda *args: given.append(set(args[1])) or passed(*args))
    got = segments.cluster_windows(snaps, 3, "mixture", starts=2).collect()
    assert given == [{(1, 0), (1, 1), (2, 0), (2, 1)}]
    assert {(r.window, r.customer) for r in got} == {(w, c) for w in (1, 2) for c in range(90)} and {r.label for r in got} <= {"0", "1", "2", "02", "12", "22"}
