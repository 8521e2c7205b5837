"""Forecasting: folds, baselines, regression and smoothing models, metrics, combination, intervals, comparison."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import special

# Folds


def placed(series: DataFrame, key: str = "series_id", time: str = "period") -> DataFrame:
    """series with place (from 1) and length, by series."""
    whole = Window.partitionBy(key)
    return series.withColumn("place", F.row_number().over(whole.orderBy(time)).cast("long")).withColumn("length", F.count("*").over(whole))


def folds(series: DataFrame, horizon: int, count: int = 4, least: int = 8, sliding: int | None = None) -> DataFrame:
    """Rows of a placed series by fold and role (train, test).

    Fold 0 is the locked hold-out of the last `horizon` periods; folds 1 to count end before it, one
    horizon apart, the last of them next to it.  Training is all that lies before the test, or the
    last `sliding` periods of it.  A fold with fewer than `least` training periods does not exist.
    """
    grid = series.sparkSession.createDataFrame([(k, (0 if k == 0 else count - k + 1) * horizon) for k in range(count + 1)], "fold long, back long")
    rows = series.join(F.broadcast(grid))
    end = F.col("length") - F.col("back")
    start = end - horizon
    inside = (F.col("place") <= end) & (start >= least)
    if sliding:
        inside = inside & (F.col("place") > start - sliding)
    return rows.where(inside).withColumn("role", F.when(F.col("place") > start, "test").otherwise("train")).withColumn("step", F.when(F.col("place") > start, F.col("place") - start)).drop("back")


def leaks(split: DataFrame, key: str = "series_id", time: str = "period") -> DataFrame:
    """Folds whose training reaches their test, or any training fold's that reaches the hold-out: empty if all is well."""
    spans = split.groupBy(key, "fold").agg(F.max(F.when(F.col("role") == "train", F.col(time))).alias("last_train"), F.min(F.when(F.col("role") == "test", F.col(time))).alias("first_test"))
    held = spans.where("fold = 0").select(F.col(key).alias("_k"), F.col("first_test").alias("held_from"))
    return spans.join(held, F.col(key) == F.col("_k")).where((F.col("last_train") >= F.col("first_test")) | ((F.col("fold") > 0) & (F.col("last_train") >= F.col("held_from")))).drop("_k")


# Models as DataFrame expressions


def _training(split: DataFrame) -> DataFrame:
    return split.where("role = 'train'")


def _tests(split: DataFrame, key: str) -> DataFrame:
    return split.where("role = 'test'").select(key, "fold", "step", "period", F.col("value").alias("actual"))


def naive(split: DataFrame, key: str = "series_id") -> DataFrame:
    """The last known value."""
    last = _training(split).where("value is not null").groupBy(key, "fold").agg(F.max_by("value", "place").alias("forecast"))
    return _tests(split, key).join(last, [key, "fold"])


def moving_average(split: DataFrame, window: int = 4, key: str = "series_id") -> DataFrame:
    ends = _training(split).groupBy(key, "fold").agg(F.max("place").alias("end"))
    mean = _training(split).join(ends, [key, "fold"]).where(F.col("place") > F.col("end") - window).groupBy(key, "fold").agg(F.avg("value").alias("forecast"))
    return _tests(split, key).join(mean, [key, "fold"])


def drift(split: DataFrame, key: str = "series_id") -> DataFrame:
    """The line through the first and last value."""
    line = _training(split).groupBy(key, "fold").agg(F.min_by("value", "place").alias("a"), F.max_by("value", "place").alias("b"), F.count("*").alias("n"))
    return _tests(split, key).join(line, [key, "fold"]).select(key, "fold", "step", "period", "actual", (F.col("b") + F.col("step") * F.try_divide(F.col("b") - F.col("a"), F.col("n") - 1)).alias("forecast"))


def seasonal_naive(split: DataFrame, season: int = 52, with_drift: bool = False, key: str = "series_id") -> DataFrame:
    """The value a season ago, repeated; with_drift adds the mean change from the season before last to the last one.

    A history shorter than a season gives the last value; one shorter than two seasons, which has
    no such change, the line through its first and last value.
    """
    train = _training(split)
    ends = train.groupBy(key, "fold").agg(F.max("place").alias("end"), F.min("place").alias("start"), F.max_by("value", "place").alias("last"), F.min_by("value", "place").alias("head"), F.count("*").alias("n"))
    past = train.select(key, "fold", F.col("place").alias("from"), F.col("value").alias("seasonal"))
    rows = _tests(split, key).join(ends, [key, "fold"])
    source = F.col("end") - season + ((F.col("step") - 1) % season) + 1
    rows = rows.withColumn("from", source).join(past, [key, "fold", "from"], "left")
    short = F.col("last") + (F.col("step") * (F.col("last") - F.col("head")) / F.greatest(F.col("n") - 1, F.lit(1)) if with_drift else F.lit(0.0))
    value = F.col("seasonal")
    if with_drift:
        later = train.join(ends.select(key, "fold", "end"), [key, "fold"]).where(F.col("place") > F.col("end") - season).select(key, "fold", (F.col("place") - season).alias("from"), F.col("value").alias("later"))
        change = past.join(later, [key, "fold", "from"]).groupBy(key, "fold").agg(F.avg(F.col("later") - F.col("seasonal")).alias("change"))
        rows = rows.join(change, [key, "fold"], "left")
        value = value + F.col("change")
    return rows.select(key, "fold", "step", "period", "actual", F.when(F.col("n") >= (2 * season if with_drift else season), value).otherwise(short).alias("forecast"))


# Models with state, run for each series and fold as a group


class Forecaster(ABC):
    """fit on a history without gaps at its ends, then predict so many steps."""

    name = ""

    @abstractmethod
    def fit(self, y: np.ndarray) -> Forecaster: ...

    @abstractmethod
    def predict(self, steps: int) -> np.ndarray: ...


REGISTRY: dict[str, Callable[[], Forecaster]] = {}


def register(name: str):
    def add(make: Callable[[], Forecaster]):
        REGISTRY[name] = make
        return make

    return add


class Fourier(Forecaster):
    """Least squares on trend, sines and cosines, with a small ridge on the waves."""

    def __init__(self, season: int = 52, harmonics: int = 4, ridge: float = 1e-6):
        self.season, self.harmonics, self.ridge = season, harmonics, ridge

    def basis(self, t: np.ndarray, k: int) -> np.ndarray:
        angles = 2 * math.pi * np.outer(t, np.arange(1, k + 1)) / self.season
        return np.column_stack([np.ones(len(t)), t, np.sin(angles), np.cos(angles)])

    def fit(self, y: np.ndarray) -> Fourier:
        t = np.arange(len(y), dtype=float)
        known = ~np.isnan(y)
        self.k = max(0, min(self.harmonics, max(1, self.season // 2), (int(known.sum()) - 3) // 2))
        x = self.basis(t, self.k)[known]
        penalty = np.diag([0.0, 0.0] + [self.ridge] * (2 * self.k))
        self.weights = np.linalg.lstsq(x.T @ x + penalty, x.T @ y[known], rcond=None)[0]
        self.n = len(y)
        return self

    def predict(self, steps: int) -> np.ndarray:
        return self.basis(self.n + np.arange(steps, dtype=float), self.k) @ self.weights


class DampedSmoothing(Forecaster):
    """Level and damped trend, with an additive season if asked; a missing value is its own forecast.

    Parameters come from a search that halves its step around the best point, from three starts.
    """

    STARTS = ((0.3, 0.1, 0.9, 0.1), (0.1, 0.05, 0.95, 0.3), (0.7, 0.2, 0.85, 0.05))
    BOUNDS = ((0.01, 0.99), (0.001, 0.5), (0.8, 0.98), (0.001, 0.5))

    def __init__(self, season: int = 1, seasonal: bool = False):
        self.season, self.seasonal = season, seasonal

    def start(self, y: np.ndarray) -> tuple[float, float, np.ndarray]:
        m = self.season
        if self.seasonal and len(y) >= 2 * m:
            one, two = np.nanmean(y[:m]), np.nanmean(y[m : 2 * m])
            return float(one), float((two - one) / m), np.nan_to_num(y[:m] - one)
        head = y[: min(4, len(y))]
        slope = (head[-1] - head[0]) / (len(head) - 1) if len(head) > 1 else 0.0
        return float(head[0]), float(slope), np.zeros(max(1, m))

    def run(self, y: np.ndarray, p: Sequence[float]) -> tuple[float, float, float, np.ndarray]:
        alpha, beta, phi, gamma = p
        level, trend, season = self.start(y)
        season, error = season.copy(), 0.0
        for t, x in enumerate(y):
            s = season[t % len(season)]
            ahead = level + phi * trend
            if np.isnan(x):
                x = ahead + s
            else:
                error += (x - ahead - s) ** 2
            new = alpha * (x - s) + (1 - alpha) * ahead
            trend = beta * (new - level) + (1 - beta) * phi * trend
            if self.seasonal:
                season[t % len(season)] = gamma * (x - new) + (1 - gamma) * s
            level = new
        return error, level, trend, season

    def fit(self, y: np.ndarray) -> DampedSmoothing:
        best, best_error = None, math.inf
        free = range(4 if self.seasonal else 3)
        for start in self.STARTS:
            p, width = list(start), 0.25
            error = self.run(y, p)[0]
            while width > 0.005:
                moved = False
                for i in free:
                    for sign in (1, -1):
                        q = list(p)
                        lo, hi = self.BOUNDS[i]
                        q[i] = min(hi, max(lo, q[i] + sign * width * (hi - lo)))
                        e = self.run(y, q)[0]
                        if e < error - 1e-12:
                            p, error, moved = q, e, True
                if not moved:
                    width /= 2
            if error < best_error:
                best, best_error = p, error
        self.p = best
        _, self.level, self.trend, self.waves = self.run(y, best)
        self.n = len(y)
        return self

    def predict(self, steps: int) -> np.ndarray:
        phi, damp, out = self.p[2], 0.0, []
        for h in range(1, steps + 1):
            damp += phi**h
            out.append(self.level + damp * self.trend + self.waves[(self.n + h - 1) % len(self.waves)])
        return np.array(out)


register("fourier")(Fourier)
register("ets")(DampedSmoothing)


def run_models(split: DataFrame, names: Sequence[str], key: str = "series_id") -> DataFrame:
    """Forecasts of registered models: every series, fold and model is a task's group; a model that fails gives an error instead."""
    makers = {n: REGISTRY[n] for n in names}
    models = split.sparkSession.createDataFrame([(n,) for n in names], "model string")
    rows = split.select(key, "fold", "role", "step", "place", F.col("period").cast("string").alias("period"), F.col("value").cast("double").alias("value")).join(F.broadcast(models))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        train, test = pdf[pdf.role == "train"], pdf[pdf.role == "test"]
        out = pd.DataFrame({key: test[key], "model": test["model"], "fold": test["fold"], "step": test["step"].astype("int64"), "period": test["period"], "actual": test["value"]})
        try:
            known = train["value"].to_numpy()
            at = np.flatnonzero(~np.isnan(known))
            out["forecast"] = makers[pdf["model"].iloc[0]]().fit(known[at[0] : at[-1] + 1]).predict(len(test))
            out["error"] = None
        except (ValueError, IndexError, np.linalg.LinAlgError) as problem:
            out["forecast"], out["error"] = np.nan, str(problem)
        return out

    return rows.groupBy(key, "fold", "model").applyInPandas(run, f"{key} string, model string, fold long, step long, period string, actual double, forecast double, error string")


# Metrics


def metrics() -> dict[str, Column]:
    """Aggregates over columns actual and forecast; pairs with a null are left out, mape leaves out zero actuals."""
    y, f = F.col("actual"), F.col("forecast")
    e = F.abs(y - f)
    return {
        "n": F.count(e), "mae": F.avg(e), "rmse": F.sqrt(F.avg(F.pow(y - f, 2))), "mape": 100 * F.avg(F.when(y != 0, e / F.abs(y))),
        "mape_excluded": F.count_if(e.isNotNull() & (y == 0)), "smape": 100 * F.avg(F.try_divide(e, (F.abs(y) + F.abs(f)) / 2)),
        "wape": 100 * F.try_divide(F.sum(e), F.sum(F.when(e.isNotNull(), F.abs(y)))), "bias": F.avg(y - f),
    }


def scores(forecasts: DataFrame, *by: str) -> DataFrame:
    return forecasts.groupBy(*by).agg(*[c.alias(k) for k, c in metrics().items()])


def weighted_mape(per_series: DataFrame) -> DataFrame:
    """One row from (mape, weight) by series: the mean MAPE by weight over the series that have both, and how many have not."""
    usable = F.col("mape").isNotNull() & (F.col("weight") > 0)
    kept = lambda c: F.sum(F.when(usable, c))
    return per_series.agg(F.try_divide(kept(F.col("mape") * F.col("weight")), kept(F.col("weight"))).alias("weighted_mape"), F.count_if(usable).alias("series"), F.count_if(~F.coalesce(usable, F.lit(False))).alias("excluded"))


def mase(forecasts: DataFrame, split: DataFrame, season: int = 1, key: str = "series_id") -> DataFrame:
    """MAE over the mean absolute seasonal change inside the training periods."""
    order = Window.partitionBy(key, "fold").orderBy("place")
    scale = _training(split).withColumn("d", F.abs(F.col("value") - F.lag("value", season).over(order))).groupBy(key, "fold").agg(F.avg("d").alias("scale"))
    errors = forecasts.groupBy(key, "fold").agg(F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae"))
    return errors.join(scale, [key, "fold"]).select(key, "fold", F.try_divide("mae", "scale").alias("mase"))


def summary(by_fold: DataFrame, metric: str = "wape") -> DataFrame:
    return by_fold.where("fold > 0").groupBy("model").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.max(metric).alias("worst"), F.count(metric).alias("folds"))


def best_model(summarised: DataFrame) -> DataFrame:
    return summarised.where("folds >= 1").orderBy("mean", "model").limit(1)


def combined(forecasts: DataFrame, rule: str = "median", trim: float = 0.2, key: str = "series_id") -> DataFrame:
    """Median, mean or trimmed mean of the members for each series, fold and step, and their spread."""
    keys = [key, "fold", "step"]
    if rule == "trimmed":
        by = Window.partitionBy(*keys)
        rows = forecasts.withColumn("_r", F.row_number().over(by.orderBy("forecast", "model"))).withColumn("_n", F.count("*").over(by))
        cut = F.floor(F.col("_n") * trim)
        forecasts = rows.where((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut))
    middle = F.median("forecast") if rule == "median" else F.avg("forecast")
    return forecasts.groupBy(*keys).agg(F.first("actual").alias("actual"), middle.alias("forecast"), (F.max("forecast") - F.min("forecast")).alias("spread"), F.count("*").alias("members"))


def intervals(history: DataFrame, point: DataFrame, level: float = 0.8, least: int = 5, floor_at_zero: bool = True) -> DataFrame:
    """point (step, forecast, actual) with bounds from quantiles of past errors: of the step if it has `least`, else pooled."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    errors = history.select("step", (F.col("actual") - F.col("forecast")).alias("e")).where("e is not null")
    q = F.percentile("e", [lo, hi])
    steps, pool = errors.groupBy("step").agg(F.count("*").alias("n"), q.alias("q")), errors.agg(q.alias("all_q"))
    rows = point.join(steps, "step", "left").join(F.broadcast(pool))
    use = F.when(F.col("n") >= least, F.col("q")).otherwise(F.col("all_q"))
    bound = lambda k: F.greatest(F.col("forecast") + F.element_at(use, k), F.lit(0.0)) if floor_at_zero else F.col("forecast") + F.element_at(use, k)
    return rows.select("step", "actual", "forecast", bound(1).alias("lower"), bound(2).alias("upper"), F.coalesce(F.col("n") < least, F.lit(True)).alias("pooled"))


def covered(bounds: DataFrame) -> DataFrame:
    return bounds.agg(F.count("actual").alias("n"), F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("int")).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width"))


def compare_models(errors: DataFrame, metric: str = "wape", alpha: float = 0.05) -> dict:
    """Friedman over folds, then signed ranks of each pair with Bonferroni; folds by models are few, so the driver holds them."""
    wide: dict[int, dict[str, float]] = {}
    for r in errors.where("fold > 0").select("fold", "model", metric).collect():
        wide.setdefault(r.fold, {})[r.model] = r[metric]
    names = sorted({m for row in wide.values() for m in row})
    blocks = [row for _, row in sorted(wide.items()) if len(row) == len(names)]
    if len(names) < 3 or len(blocks) < 2:
        return {"test": "none", "models": len(names), "folds": len(blocks)}
    ranks = []
    for row in blocks:
        ordered = sorted(row.values())
        ranks.append([ordered.index(row[m]) + (ordered.count(row[m]) + 1) / 2 for m in names])
    statistic, p = special.friedman_p(ranks)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    tested = [{"first": a, "second": b, "p": min(1.0, len(pairs) * special.signed_rank_p([row[a] - row[b] for row in blocks]))} for a, b in pairs]
    return {"test": "friedman", "statistic": statistic, "p": p, "mean_ranks": {m: sum(r[i] for r in ranks) / len(ranks) for i, m in enumerate(names)}, "pairs": tested, "different": p <= alpha}
