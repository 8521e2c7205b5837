"""Profiles against exact counts."""

import random
from collections import Counter

import numpy as np
import pytest

from quern.operators import insight, profile


def test_profiled(spark):
    rng = random.Random(6)
    rows = [(k, rng.gauss(0, 5) if k % 7 else None, rng.choice(["a", "b", None]), [k]) for k in range(5000)] + [(0, 0.0, "a", None)]
    frame = spark.createDataFrame(rows, "id long, x double, s string, nested array<int>").repartition(4)
    got = {r.column: r for r in profile.profiled(frame).collect()}
    assert all(r.rows == 5001 for r in got.values()) and got["x"].nulls == 715 and got["nested"].nulls == 1 and got["nested"].distinct is None
    assert abs(got["id"].distinct - 5000) < 5 * 0.02 * 5000 and got["s"].distinct == 2 and (got["id"].lowest, got["id"].highest, got["s"].lowest) == ("0", "4999", "a")
    x = np.array([r[1] for r in rows if r[1] is not None])
    assert got["x"].mean == pytest.approx(x.mean()) and got["x"].sd == pytest.approx(x.std(ddof=1)) and (got["x"].negative, got["x"].zero) == (int((x < 0).sum()), 1)
    for share, q in zip(profile.SHARES, got["x"].quantiles):
        assert abs((x <= q).mean() - share) < 2e-3
    none = {r.column: r for r in profile.profiled(frame.limit(0), ["x"]).collect()}
    assert set(none) == {"x"} and (none["x"].rows, none["x"].nulls, none["x"].mean, none["x"].quantiles) == (0, 0, None, None)


def test_frequent(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aaabbc"), rng.randint(0, 30) if rng.random() < 0.9 else None) for _ in range(500)]
    got = profile.frequent(spark.createDataFrame(rows, "s string, n int").repartition(3), ["s", "n"], 5).collect()
    for k, c in enumerate(("s", "n")):
        counts = Counter(None if r[k] is None else str(r[k]) for r in rows)
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:5]
        assert [(r.value, r.rows) for r in sorted((r for r in got if r.column == c), key=lambda r: r.place)] == want


def test_weights_are_explained():
    told = insight.explain_weights({"revenue_at_stake": 1, "evidence_weight": 1, "corroboration": 2})
    assert told["corroboration"].startswith("0.50: ") and set(told) == set(insight.WEIGHTS)
    with pytest.raises(ValueError):
        insight.explain_weights({"revenue_at_stake": 1})


def test_reliability_summary_and_drivers(spark):
    rows = [("forecast", 0.2, "weak"), ("association", 0.0, "unknown"), ("segmentation", 0.9, "strong")]
    got = insight.reliability_summary(spark.createDataFrame(rows, "source string, score double, band string")).first()
    assert (got.weak, got.unavailable, got.caveat) == (["forecast"], ["association"], "evidence of forecast is weak")
    listed = spark.createDataFrame([("k1", 1, {"lift": "2.5", "odd": "x", "items": None}), ("k2", 2, {})], "key string, place long, evidence map<string,string>")
    assert [(r.key, r.feature, r.label, r.value) for r in insight.drivers(listed).collect()] == [("k1", "lift", insight.DRIVERS["lift"], "2.5")]
