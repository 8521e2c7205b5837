"""One boosted-tree model over many series, fitted for each fold and step, and the table that sets it beside the other models.

Every fold cuts the panel at the end of its training periods before anything is computed from it:
scales, past values and targets come from that history alone.  A step has a model of its own that
forecasts so many periods ahead from the last known one, so no forecast feeds another.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import forecast
from quern.sources.stage import stored

#: Fixed value: the series of the whole business.
TOTAL = "__TOTAL__"

#: Series pooled beside the total, and the past values and windows that a model sees.
SERIES, LAGS, WINDOWS = 100, (1, 2, 3, 4, 8, 12, 52), (4, 12)
#: Boosting: rounds, rate, levels of a tree, rows a leaf needs, ridge on leaves, and intervals a feature is cut into.
ROUNDS, RATE, DEPTH, LEAST, RIDGE, BINS = 300, 0.05, 4, 20, 1.0, 64


def panel(values: DataFrame, top: int = SERIES, unit: str = "7 days") -> DataFrame:
    """(series_id, period, value): the total and its `top` largest series, on the total's calendar, absent periods as 0.

    values: series_id, period, value, one row each.  The total is over all series, those not in the
    panel included.  Ties of size go by series_id.
    """
    rows = stored(values.select("series_id", "period", F.col("value").cast("double").alias("value")), "values")
    sizes = rows.groupBy("series_id").agg(F.sum("value").alias("size")).orderBy(F.desc_nulls_last("size"), "series_id").limit(top)
    total = rows.groupBy("period").agg(F.sum("value").alias("value")).select(F.lit(TOTAL).alias("series_id"), "period", "value")
    chosen = total.unionByName(rows.join(F.broadcast(sizes.select("series_id")), "series_id"))
    span = rows.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).where("lo is not null")
    calendar = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {unit}"))).alias("period"))
    names = sizes.select("series_id").union(sizes.sparkSession.createDataFrame([(TOTAL,)], "series_id string"))
    grid = calendar.join(F.broadcast(names))
    return grid.join(chosen, ["series_id", "period"], "left").select("series_id", "period", F.coalesce("value", F.lit(0.0)).alias("value"))


def histories(panel_rows: DataFrame, split: DataFrame) -> DataFrame:
    """The panel by fold, up to the last training period that the target's split has there."""
    ends = split.where("role = 'train'").groupBy("fold").agg(F.max("period").alias("_end"))
    return panel_rows.join(F.broadcast(ends), F.col("period") <= F.col("_end")).drop("_end")


def feature_names(lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS) -> list[str]:
    return [*[f"lag_{n}" for n in lags], *[f"{kind}_{n}" for n in windows for kind in ("mean", "sd")], "week", "month", "quarter", "weekday", "month_end", "week_sin", "week_cos"]


def features(history: DataFrame, horizon: int, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """history (fold, series_id, period, value) with centre and width of its series, past-only features, and targets.

    Values are scaled by the median and the interquartile range of the series inside the fold (the
    standard deviation where that is 0, else 1).  A row knows the values before its own period;
    windows need half of their values, two at least.  `targets` holds the scaled values 1 to
    `horizon` periods ahead, null where the history ends before; `last` marks a series' last row.
    """
    keys = ["fold", "series_id"]
    scale = history.groupBy(*keys).agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("q"), F.stddev_samp("value").alias("sd"))
    range_ = F.element_at("q", 3) - F.element_at("q", 1)
    scale = scale.select(*keys, F.element_at("q", 2).alias("centre"), F.when(range_ > 0, range_).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("width"))
    order = Window.partitionBy(*keys).orderBy("period")
    rows = history.join(scale, keys).withColumn("_x", (F.col("value") - F.col("centre")) / F.col("width"))
    made: dict[str, Column] = {f"lag_{n}": F.lag("_x", n).over(order) for n in lags}
    for n in windows:
        past = order.rowsBetween(-n, -1)
        enough = F.count("_x").over(past) >= max(2, n // 2)
        made[f"mean_{n}"] = F.when(enough, F.avg("_x").over(past))
        made[f"sd_{n}"] = F.when(enough, F.stddev_samp("_x").over(past))
    week = F.weekofyear("period")
    made |= {
        "week": week.cast("double"), "month": F.month("period").cast("double"), "quarter": F.quarter("period").cast("double"), "weekday": F.weekday("period").cast("double"),
        "month_end": (F.last_day("period") == F.col("period").cast("date")).cast("double"), "week_sin": F.sin(2 * math.pi * week / 52), "week_cos": F.cos(2 * math.pi * week / 52),
    }
    return rows.withColumns(made).withColumn("targets", F.array(*[F.lead("_x", k).over(order) for k in range(1, horizon + 1)])).withColumn(
        "last", F.lead("period").over(order).isNull()).drop("_x")


class BoostedTrees:
    """Least-squares boosting of level-wise trees over features cut into intervals at quantiles."""

    def __init__(self, rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH, least: int = LEAST, ridge: float = RIDGE, bins: int = BINS):
        self.rounds, self.rate, self.depth, self.least, self.ridge, self.bins = rounds, rate, depth, least, ridge, bins

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(edge, x[:, f], "left") for f, edge in enumerate(self.edges)])

    def _split(self, flat: np.ndarray, node: np.ndarray, residual: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """The best feature and last left interval of each node; a node that gains nothing keeps all rows on the left."""
        width = flat.shape[1]
        at = (flat + node[:, None] * (width * self.bins)).ravel()
        size = nodes * width * self.bins
        g = np.bincount(at, np.repeat(residual, width), size).reshape(nodes, width, self.bins).cumsum(2)
        n = np.bincount(at, minlength=size).reshape(nodes, width, self.bins).cumsum(2)
        g_all, n_all = g[:, :, -1:], n[:, :, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):  # sides without rows, which the next line rules out
            gain = g**2 / (n + self.ridge) + (g_all - g) ** 2 / (n_all - n + self.ridge) - g_all**2 / (n_all + self.ridge)
        gain[(n < self.least) | (n_all - n < self.least)] = 0.0
        best = gain.reshape(nodes, -1).argmax(1)
        gained = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-12
        return np.where(gained, best // self.bins, 0), np.where(gained, best % self.bins, self.bins)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        shares = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], shares)) for f in range(x.shape[1])]
        self.base, self.trees = float(y.mean()), []
        codes = self._codes(x)
        flat = codes + np.arange(x.shape[1]) * self.bins
        residual, rows = y - self.base, np.arange(len(y))
        for _ in range(self.rounds):
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                feature, limit = self._split(flat, node, residual, 1 << level)
                splits.append((feature, limit))
                node = 2 * node + (codes[rows, feature[node]] > limit[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, residual, leaves) / (np.bincount(node, minlength=leaves) + self.ridge)
            residual = residual - value[node]
            self.trees.append((splits, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes, rows, out = self._codes(x), np.arange(len(x)), np.full(len(x), self.base)
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, limit in splits:
                node = 2 * node + (codes[rows, feature[node]] > limit[node])
            out += value[node]
        return out


def filled(forecasts: DataFrame, keys: Sequence[str] = ("fold", "series_id"), order: str = "step", value: str = "forecast") -> DataFrame:
    """Missing values as the last known one before, or else the first known one after; 0 where none is known."""
    way = Window.partitionBy(*keys).orderBy(order)
    before = F.last(value, ignorenulls=True).over(way.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(way.rowsBetween(0, Window.unboundedFollowing))
    return forecasts.withColumn(value, F.coalesce(before, after, F.lit(0.0)))


def pooled(history: DataFrame, horizon: int, rounds: int = ROUNDS, lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """(fold, series_id, step, forecast, training_rows): a model for each fold and step, from each series' last row of the history.

    A model and its rows are one task's: the panel's bound on series makes that a few tens of
    thousands.  Rows with a missing feature or target do not train; a step without a model, or a
    series whose last row misses a feature, is filled from its neighbours.
    """
    names = feature_names(lags, windows)
    rows = stored(features(history, horizon, lags, windows), "features")
    whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    each = rows.where(whole).select(
        "fold", "series_id", "centre", "width", "last", F.array(*[F.col(n).cast("float") for n in names]).alias("x"), F.posexplode("targets").alias("pos", "y")
    ).where("last or y is not null").withColumn("step", F.col("pos") + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["x"].tolist(), np.float32)
        train, ask = pdf["y"].notna().to_numpy(), pdf["last"].to_numpy()
        got = np.full(int(ask.sum()), np.nan)
        if train.any() and ask.any():
            got = BoostedTrees(rounds).fit(x[train], pdf["y"].to_numpy()[train]).predict(x[ask])
        out = pdf.loc[ask, ["fold", "series_id", "step"]].assign(forecast=got * pdf.loc[ask, "width"] + pdf.loc[ask, "centre"], training_rows=int(train.sum()))
        return out

    made = each.groupBy("fold", "step").applyInPandas(run, "fold long, series_id string, step long, forecast double, training_rows long")
    steps = rows.select("fold", "series_id").distinct().select("fold", "series_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))).alias("step"))
    return filled(steps.join(made, ["fold", "series_id", "step"], "left")).withColumn("training_rows", F.coalesce("training_rows", F.lit(0)))


def experiment(split: DataFrame, history: DataFrame, horizon: int, season: int = 52, rounds: int = ROUNDS, rule: str = "median", members: Sequence[str] | None = None) -> DataFrame:
    """(model, family, pooled, fold, step, actual, forecast) of every model on the target series' folds, fold 0 the hold-out.

    split: the target's folds; history: the panel's (see histories), which holds it as TOTAL.
    Baselines, regression, smoothing, the pooled trees and a combination of `members` (all by
    default) are scored on the same periods.  `pooled` says that a model has seen other series.
    """
    plain = {
        "naive": forecast.naive(split), "seasonal_naive": forecast.seasonal_naive(split, season), "seasonal_naive_drift": forecast.seasonal_naive(split, season, with_drift=True),
        "moving_average": forecast.moving_average(split), "drift": forecast.drift(split),
    }
    parts = [got.select(F.lit(n).alias("model"), F.lit("baseline").alias("family"), F.lit(False).alias("pooled"), "fold", "step", "actual", "forecast") for n, got in plain.items()]
    models = forecast.run_models(split, ["fourier", "ets"]).where("forecast is not null")
    parts.append(models.select("model", F.lit("statistical").alias("family"), F.lit(False).alias("pooled"), "fold", "step", "actual", "forecast"))
    actual = split.where("role = 'test'").select("fold", "step", F.col("value").alias("actual"))
    trees = pooled(history, horizon, rounds).where(F.col("series_id") == TOTAL).select("fold", "step", "forecast")
    parts.append(trees.join(actual, ["fold", "step"]).select(F.lit("pooled_trees").alias("model"), F.lit("tree").alias("family"), F.lit(True).alias("pooled"), "fold", "step", "actual", "forecast"))
    alone = stored(reduce(DataFrame.union, parts), "models")
    used = alone.where(F.col("model").isin(list(members))) if members else alone
    both = forecast.combined(used.withColumn("series_id", F.lit(TOTAL)), rule)
    return alone.union(both.select(F.lit(f"combination_{rule}"), F.lit("combination"), F.lit(not members or "pooled_trees" in members), "fold", "step", "actual", "forecast"))


def results_table(found: DataFrame) -> DataFrame:
    """One row a model: WAPE of each training fold, their mean and spread, the hold-out's, and the place by the mean.

    The place is by the training folds alone; the hold-out says afterwards how good the choice was.
    """
    by = stored(forecast.scores(found, "model", "family", "pooled", "fold").select("model", "family", "pooled", "fold", "wape", "mae"), "scores")
    order = Window.orderBy(F.col("mean").asc_nulls_last(), "model")
    wide = by.groupBy("model", "family", "pooled").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("fold") > 0, F.struct("fold", "wape"))))).alias("folds"), F.avg(F.when(F.col("fold") > 0, F.col("wape"))).alias("mean"),
        F.stddev_samp(F.when(F.col("fold") > 0, F.col("wape"))).alias("sd"), F.max(F.when(F.col("fold") == 0, F.col("wape"))).alias("holdout"))
    return wide.withColumn("place", F.row_number().over(order).cast("long"))


def by_fold(found: DataFrame, count: int, metric: str = "wape") -> DataFrame:
    """Folds against models: a row a model, a column fold_k for each training fold and one for the hold-out."""
    scores = forecast.scores(found, "model", "fold").select("model", "fold", metric)
    wide = scores.groupBy("model").pivot("fold", list(range(count + 1))).agg(F.first(metric))
    return wide.select("model", *[F.col(f"`{k}`").alias(f"fold_{k}" if k else "holdout") for k in [*range(1, count + 1), 0]])
