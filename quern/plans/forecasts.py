"""Queries of the forecasting operators: brands' weekly revenue, folds of 12 weeks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import forecast, pooled
from quern.plans.retail import ORACLE_SQL as _RETAIL_SQL  # noqa: F401
from quern.plans.retail import _sql, query, rounded
from quern.sources.sales import bucket, sales
from quern.sources.stage import stored

HORIZON, FOLDS, SEASON = 12, 4, 52

_SERIES = """w AS (SELECT brand AS series_id, date_trunc('week', occurred_at)::DATE AS period, sum(CASE WHEN NOT is_return THEN revenue ELSE 0 END)::DOUBLE AS value FROM sales GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period) AS place, count(*) OVER (PARTITION BY series_id) AS length FROM w),
f AS (SELECT p.*, fold, length - back - 12 AS start, CASE WHEN place > length - back - 12 THEN 'test' ELSE 'train' END AS role, CASE WHEN place > length - back - 12 THEN place - (length - back - 12) END AS step
  FROM p, (VALUES (0, 0), (1, 48), (2, 36), (3, 24), (4, 12)) g(fold, back) WHERE place <= length - back AND length - back - 12 >= 8)"""


def weekly(spark, sf_dir):
    return sales(spark, sf_dir, "brand", "occurred_at", "revenue", "is_return").groupBy(F.col("brand").alias("series_id"), bucket("occurred_at", "week").alias("period")).agg(
        F.coalesce(F.sum(F.when(~F.col("is_return"), F.col("revenue"))), F.lit(0)).cast("double").alias("value"))


def split(spark, sf_dir):
    return stored(forecast.folds(forecast.placed(weekly(spark, sf_dir)), HORIZON, FOLDS), "folds")


@query(_sql("SELECT series_id, CAST(fold AS BIGINT) AS fold, role, count(*) AS periods, CAST(min(period) AS VARCHAR) AS first, CAST(max(period) AS VARCHAR) AS last FROM f GROUP BY 1, 2, 3", _SERIES))
def fc_folds(spark, sf_dir):
    return rounded(split(spark, sf_dir).groupBy("series_id", "fold", "role").agg(F.count("*").alias("periods"), F.min("period").alias("first"), F.max("period").alias("last")))


@query(_sql("SELECT 0::BIGINT AS leaks"))
def fc_leaks(spark, sf_dir):
    return forecast.leaks(split(spark, sf_dir)).agg(F.count("*").alias("leaks"))


_BASE = {
    "fc_naive": ("arg_max(value, place)", lambda s: forecast.naive(s)),
    "fc_moving_average": ("avg(value) FILTER (place > start - 4)", lambda s: forecast.moving_average(s)),
    "fc_drift": ("arg_max(value, place) + step * (arg_max(value, place) - arg_min(value, place)) / (count(*) - 1)", lambda s: forecast.drift(s)),
    "fc_seasonal_naive": ("CASE WHEN start >= 52 THEN max(value) FILTER (place = start - 52 + step) ELSE arg_max(value, place) END", lambda s: forecast.seasonal_naive(s, SEASON)),
}


def _baseline(name: str):
    expression, run = _BASE[name]

    @query(_sql(f"""SELECT t.series_id, CAST(t.fold AS BIGINT) AS fold, t.step, round(t.value, 6) AS actual, round({expression.replace('value', 'x.value').replace('place', 'x.place').replace('start', 't.start').replace('step', 't.step')}, 6) AS forecast
FROM f t JOIN f x ON x.series_id = t.series_id AND x.fold = t.fold AND x.role = 'train' WHERE t.role = 'test' GROUP BY t.series_id, t.fold, t.step, t.value, t.start""", _SERIES), name=name)
    def got(spark, sf_dir):
        return rounded(run(split(spark, sf_dir)).select("series_id", "fold", "step", "actual", "forecast"), 6)

    return got


for _name in _BASE:
    _baseline(_name)


@query(_sql("""SELECT t.series_id, CAST(t.fold AS BIGINT) AS fold, t.step, round(t.value, 6) AS actual,
  round(CASE WHEN t.start >= 104 THEN max(x.value) FILTER (x.place = t.start - 52 + t.step) + avg(x.value) FILTER (x.place > t.start - 52) - avg(x.value) FILTER (x.place > t.start - 104 AND x.place <= t.start - 52)
    ELSE arg_max(x.value, x.place) + t.step * (arg_max(x.value, x.place) - arg_min(x.value, x.place)) / greatest(1, t.start - 1) END, 6) AS forecast
FROM f t JOIN f x ON x.series_id = t.series_id AND x.fold = t.fold AND x.role = 'train'
WHERE t.role = 'test' GROUP BY t.series_id, t.fold, t.step, t.value, t.start""", _SERIES))
def fc_seasonal_drift(spark, sf_dir):
    return rounded(forecast.seasonal_naive(split(spark, sf_dir), SEASON, with_drift=True).select("series_id", "fold", "step", "actual", "forecast"), 6)


def baselines(rows):
    """The three baselines of split series, as one table."""
    out = None
    for name, got in (("naive", forecast.naive(rows)), ("moving_average", forecast.moving_average(rows)), ("seasonal_naive", forecast.seasonal_naive(rows, SEASON))):
        one = got.select("series_id", F.lit(name).alias("model"), "fold", "step", "actual", "forecast")
        out = one if out is None else out.union(one)
    return stored(out, "members")


def _members(spark, sf_dir):
    rows = split(spark, sf_dir)
    return rows, baselines(rows)


_MEMBERS = _SERIES + """,
e AS (SELECT series_id, fold, any_value(start) AS start, arg_max(value, place) AS naive, avg(value) FILTER (place > start - 4) AS moving_average FROM f WHERE role = 'train' GROUP BY 1, 2),
s AS (SELECT t.series_id, t.fold, t.step, t.value AS actual, e.naive, e.moving_average, CASE WHEN t.start >= 52 THEN x.value ELSE e.naive END AS seasonal_naive FROM f t JOIN e ON e.series_id = t.series_id AND e.fold = t.fold
  LEFT JOIN f x ON x.series_id = t.series_id AND x.fold = t.fold AND x.role = 'train' AND x.place = t.start - 52 + t.step WHERE t.role = 'test'),
m AS (SELECT series_id, fold, step, actual, unnest(['naive', 'moving_average', 'seasonal_naive']) AS model, unnest([naive, moving_average, seasonal_naive]) AS forecast FROM s)"""


@query(_sql("""SELECT model, CAST(fold AS BIGINT) AS fold, count(*) AS n, round(avg(abs(actual - forecast)), 3) AS mae, round(sqrt(avg(pow(actual - forecast, 2))), 3) AS rmse,
  round(100 * avg(CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) END), 4) AS mape, round(100 * sum(abs(actual - forecast)) / sum(abs(actual)), 5) AS wape, round(avg(actual - forecast), 3) AS bias FROM m GROUP BY 1, 2""", _MEMBERS))
def fc_metrics_by_fold(spark, sf_dir):
    got = forecast.scores(_members(spark, sf_dir)[1], "model", "fold")
    return got.select("model", "fold", "n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("mape", 4).alias("mape"), F.round("wape", 5).alias("wape"), F.round("bias", 3).alias("bias"))


@query(_sql("SELECT series_id, CAST(fold AS BIGINT) AS fold, step, round(any_value(actual), 6) AS actual, round(median(forecast), 6) AS forecast, round(max(forecast) - min(forecast), 6) AS spread, count(*) AS members FROM m GROUP BY 1, 2, 3", _MEMBERS))
def fc_combination_median(spark, sf_dir):
    return rounded(forecast.combined(_members(spark, sf_dir)[1]), 6)


@query(_sql("""SELECT model, round(avg(wape), 5) AS mean, round(max(wape), 5) AS worst, count(*) AS folds FROM (
  SELECT model, fold, 100 * sum(abs(actual - forecast)) / sum(abs(actual)) AS wape FROM m WHERE fold > 0 GROUP BY 1, 2) GROUP BY 1 ORDER BY avg(wape), model LIMIT 1""", _MEMBERS))
def fc_best_model(spark, sf_dir):
    return rounded(forecast.best_model(forecast.summary(forecast.scores(_members(spark, sf_dir)[1], "model", "fold"))).drop("sd"), 5)


@query(_sql("""SELECT series_id, p.step, round(forecast, 3) AS forecast, round(greatest(0, forecast + q[1]), 3) AS lower, round(greatest(0, forecast + q[2]), 3) AS upper
FROM (SELECT series_id, step, forecast FROM m WHERE model = 'seasonal_naive' AND fold = 0) p JOIN
 (SELECT s.step, CASE WHEN count(m.actual) >= 5 THEN quantile_cont(m.actual - m.forecast, [0.1, 0.9]) ELSE (SELECT quantile_cont(actual - forecast, [0.1, 0.9]) FROM m WHERE model = 'seasonal_naive' AND fold > 0) END AS q
  FROM (SELECT DISTINCT step FROM m) s LEFT JOIN m ON m.step = s.step AND m.model = 'seasonal_naive' AND m.fold > 0 GROUP BY 1) e ON e.step = p.step""", _MEMBERS))
def fc_intervals(spark, sf_dir):
    rows = _members(spark, sf_dir)[1].where("model = 'seasonal_naive'")
    point = rows.where("fold = 0")
    bounds = forecast.intervals(rows.where("fold > 0"), point.select("step", F.col("actual"), "forecast", "series_id"))
    return rounded(point.select("series_id", "step", "forecast", "actual").join(bounds.select("step", "forecast", "actual", "lower", "upper").distinct(), ["step", "forecast", "actual"]).select("series_id", "step", "forecast", "lower", "upper"), 3)


@query()
def fc_models(spark, sf_dir):
    """Regression and smoothing models: WAPE by model and fold."""
    return rounded(forecast.scores(forecast.run_models(split(spark, sf_dir), ["fourier", "ets"]), "model", "fold"), 3)


_PANEL = """w AS (SELECT brand AS series_id, date_trunc('week', occurred_at)::DATE AS period, sum(CASE WHEN NOT is_return THEN revenue ELSE 0 END)::DOUBLE AS value FROM sales GROUP BY 1, 2),
cal AS (SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAYS))::DATE AS period FROM (SELECT min(period) AS lo, max(period) AS hi FROM w)),
sz AS (SELECT series_id FROM w GROUP BY 1 ORDER BY sum(value) DESC, series_id LIMIT 100),
pn AS (SELECT n.series_id, cal.period, coalesce(v.value, 0) AS value FROM cal CROSS JOIN (SELECT series_id FROM sz UNION ALL SELECT '__TOTAL__') n
  LEFT JOIN (SELECT * FROM w UNION ALL SELECT '__TOTAL__', period, sum(value) FROM w GROUP BY 2) v ON v.series_id = n.series_id AND v.period = cal.period)"""


def _panel(spark, sf_dir):
    """The panel, the total's folds, and the panel's histories in them."""
    rows = stored(pooled.panel(weekly(spark, sf_dir)), "panel")
    target = stored(forecast.folds(forecast.placed(rows.where(F.col("series_id") == pooled.TOTAL)), HORIZON, FOLDS), "folds")
    return rows, target, pooled.histories(rows, target)


@query(_sql("SELECT series_id, CAST(period AS VARCHAR) AS period, round(value, 3) AS value FROM pn", _PANEL))
def fc_panel(spark, sf_dir):
    return rounded(_panel(spark, sf_dir)[0], 3)


@query(_sql("""SELECT series_id, CAST(fold AS BIGINT) AS fold, CAST(period AS VARCHAR) AS period, round(lag_1, 6) AS lag_1, round(lag_52, 6) AS lag_52, round(mean_4, 6) AS mean_4, round(sd_12, 6) AS sd_12, round(ahead_1, 6) AS ahead_1, round(ahead_12, 6) AS ahead_12 FROM (
  SELECT *, lag(x) OVER o AS lag_1, lag(x, 52) OVER o AS lag_52, CASE WHEN count(x) OVER (o ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) >= 2 THEN avg(x) OVER (o ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS mean_4,
    CASE WHEN count(x) OVER (o ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) >= 6 THEN stddev_samp(x) OVER (o ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END AS sd_12, lead(x) OVER o AS ahead_1, lead(x, 12) OVER o AS ahead_12
  FROM (SELECT h.*, (value - c) / CASE WHEN q > 0 THEN q WHEN sd > 0 THEN sd ELSE 1 END AS x FROM h JOIN (
    SELECT series_id, fold, quantile_cont(value, 0.5) AS c, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS q, stddev_samp(value) AS sd FROM h GROUP BY 1, 2) USING (series_id, fold))
  WINDOW o AS (PARTITION BY series_id, fold ORDER BY period))""", _PANEL, """h AS (SELECT series_id, fold, period, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period) AS place, count(*) OVER (PARTITION BY series_id) AS length FROM pn),
  (VALUES (0, 0), (1, 48), (2, 36), (3, 24), (4, 12)) g(fold, back) WHERE place <= length - back - 12 AND length - back - 12 >= 8)"""))
def fc_pooled_features(spark, sf_dir):
    got = pooled.features(_panel(spark, sf_dir)[2], HORIZON)
    return rounded(got.select("series_id", "fold", "period", "lag_1", "lag_52", "mean_4", "sd_12", F.element_at("targets", 1).alias("ahead_1"), F.element_at("targets", 12).alias("ahead_12")), 6)


@query()
def fc_trees(spark, sf_dir):
    """Boosted trees pooled over all series: every fold, series and step."""
    return rounded(pooled.pooled(_panel(spark, sf_dir)[2], HORIZON), 3)


@query()
def fc_experiment(spark, sf_dir):
    """All models on the whole business's folds and hold-out: their WAPE by fold, in the order that the folds give them."""
    _, target, history = _panel(spark, sf_dir)
    table = pooled.results_table(pooled.experiment(target, history, HORIZON, SEASON))
    return rounded(table.withColumn("folds", F.array_join(F.transform(F.map_values("folds"), lambda x: F.round(x, 3).cast("string")), ",")), 3)


@query(_sql("""SELECT model, round(max(wape) FILTER (fold = 1), 5) AS fold_1, round(max(wape) FILTER (fold = 2), 5) AS fold_2, round(max(wape) FILTER (fold = 3), 5) AS fold_3, round(max(wape) FILTER (fold = 4), 5) AS fold_4, round(max(wape) FILTER (fold = 0), 5) AS holdout
FROM (SELECT model, fold, 100 * sum(abs(actual - forecast)) / sum(abs(actual)) AS wape FROM m GROUP BY 1, 2) GROUP BY 1""", _MEMBERS))
def fc_by_fold(spark, sf_dir):
    return rounded(pooled.by_fold(_members(spark, sf_dir)[1], FOLDS), 5)


@query(_sql("""SELECT a.series_id, CAST(a.fold AS BIGINT) AS fold, round(mae / scale, 5) AS mase FROM (SELECT series_id, fold, avg(abs(actual - forecast)) AS mae FROM m WHERE model = 'naive' GROUP BY 1, 2) a
JOIN (SELECT series_id, fold, avg(d) AS scale FROM (SELECT series_id, fold, abs(value - lag(value) OVER (PARTITION BY series_id, fold ORDER BY place)) AS d FROM f WHERE role = 'train') GROUP BY 1, 2) b ON a.series_id = b.series_id AND a.fold = b.fold""", _MEMBERS))
def fc_mase(spark, sf_dir):
    rows, members = _members(spark, sf_dir)
    return rounded(forecast.mase(members.where("model = 'naive'"), rows), 5)
