"""Queries of the readings in quern.operators.reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import aggregates, agreement, cleaning, forecast, profile, reports, rfm, rules, series, shape, statistics
from quern.plans import forecasts, segments
from quern.plans.retail import _BASKETS, _DECOMPOSED, _JUDGED, _MAPPING, _PP, _RFM, _RULES, _WEEKLY, ALL, _baskets, _brand_weeks, _mined, _net, _scored, _sql, query, raw_lines, rounded
from quern.sources.sales import read, sales
from quern.sources.stage import stored


@query(_sql("""SELECT count(*) FILTER (c = 0 AND k BETWEEN lo AND hi) AS interior_gaps, sum(c)::BIGINT AS rows, round(max(c) / sum(c)::DOUBLE, 6) AS dominant_share FROM (SELECT *, min(k) FILTER (c > 0) OVER () AS lo, max(k) FILTER (c > 0) OVER () AS hi
FROM (SELECT k, count(v.x) AS c FROM (SELECT unnest(generate_series(0, 19)) AS k) s CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM v) b LEFT JOIN v ON least(floor((v.x - lo) / ((hi - lo) / 20)), 19) = k GROUP BY k))""",
"v AS (SELECT sum(revenue)::DOUBLE AS x FROM sales WHERE NOT is_return GROUP BY invoice_id)"))
def histogram_shape(spark, sf_dir):
    bins = shape.histogram(aggregates.order_values(sales(spark, sf_dir, "invoice_id", "revenue", "is_return")), "value")
    return rounded(reports.histogram_shape(bins), 6)


@query("""SELECT event_type AS value, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS share FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1""")
def dominant_event(spark, sf_dir):
    return rounded(reports.dominant(read(spark, sf_dir, "events"), "event_type"), 6)


@query("SELECT quantile_disc(value, 0.9) AS p90 FROM events")
def percentile_nearest(spark, sf_dir):
    return read(spark, sf_dir, "events").agg(reports.nearest_rank("value", 0.9).alias("p90"))


@query(_sql("""SELECT count(*) AS n, round(1 - 6 * sum(pow(a - b, 2)) / (count(*) * (count(*) * count(*) - 1)), 6) AS rank_correlation FROM (SELECT row_number() OVER (ORDER BY c, model) AS a, row_number() OVER (ORDER BY h, model) AS b FROM (
  SELECT model, avg(w) FILTER (fold > 0) AS c, max(w) FILTER (fold = 0) AS h FROM (SELECT model, fold, 100 * sum(abs(actual - forecast)) / sum(abs(actual)) AS w FROM m GROUP BY 1, 2) GROUP BY 1))""", forecasts._MEMBERS))
def cv_against_holdout(spark, sf_dir):
    scores = forecast.scores(forecasts._members(spark, sf_dir)[1], "model", "fold")
    both = scores.groupBy("model").agg(F.avg(F.when(F.col("fold") > 0, F.col("wape"))).alias("c"), F.max(F.when(F.col("fold") == 0, F.col("wape"))).alias("h"))
    return rounded(reports.rank_correlation(both, "c", "h", "model"), 6)


@query(_sql("""SELECT a AS antecedent, c AS consequent, round(1 - (l + q - b) / n, 8) AS neither_share FROM v WHERE confidence >= 0.05 AND lift >= 1""", _RULES))
def lift_inflation(spark, sf_dir):
    return reports.lift_inflation(_mined(spark, sf_dir)).select(F.array_join("antecedent", ",").alias("antecedent"), "consequent", F.round("neither_share", 8).alias("neither_share"))


@query(_sql("""SELECT count(*) AS items, round(2 * sum(i * k) / (count(*) * sum(k)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini,
  (SELECT round(sum(k) FILTER (rn <= greatest(1, m // 10)) / sum(k), 6) FROM (SELECT k, count(*) OVER () AS m, row_number() OVER (ORDER BY k DESC, item) AS rn FROM e)) AS top_tenth_share
FROM (SELECT k, row_number() OVER (ORDER BY k) AS i FROM e)""", _RULES, "e AS (SELECT c AS item, count(*)::DOUBLE AS k FROM v WHERE confidence >= 0.05 AND lift >= 1 GROUP BY 1)"))
def rule_exposure(spark, sf_dir):
    return rounded(reports.exposure(_mined(spark, sf_dir)), 6)


@query(_sql("""SELECT count(x.a) AS rules_with_singletons, count(y.a) AS rules_without, count(CASE WHEN x.f = y.f AND y.f / y.n > x.f / x.n THEN 1 END) AS inflated
FROM (SELECT a, c, f, n FROM pr_all) x FULL JOIN (SELECT a, c, f, n FROM pr_some) y ON x.a = y.a AND x.c = y.c""", _BASKETS,
*[f"""kn_{p} AS (SELECT count(DISTINCT invoice_id)::DOUBLE AS n FROM {src}), k1_{p} AS (SELECT item, count(*)::DOUBLE AS f FROM {src} GROUP BY 1 HAVING count(*) >= (SELECT ceil(0.01::DOUBLE * n) FROM kn_{p})),
k2_{p} AS (SELECT x.item AS i, y.item AS j, count(*)::DOUBLE AS f FROM {src} x JOIN {src} y ON x.invoice_id = y.invoice_id AND x.item < y.item WHERE x.item IN (SELECT item FROM k1_{p}) AND y.item IN (SELECT item FROM k1_{p}) GROUP BY 1, 2 HAVING count(*) >= (SELECT ceil(0.01::DOUBLE * n) FROM kn_{p})),
pr_{p} AS (SELECT a, c, d.f, n FROM (SELECT i AS a, j AS c, f FROM k2_{p} UNION ALL SELECT j, i, f FROM k2_{p}) d JOIN k1_{p} x ON x.item = a, kn_{p} WHERE d.f / x.f >= 0.05)"""
  for p, src in (("all", "b"), ("some", "(SELECT * FROM b WHERE invoice_id IN (SELECT invoice_id FROM b GROUP BY 1 HAVING count(*) > 1))"))]))
def singleton_policies(spark, sf_dir):
    return reports.singleton_policies(_baskets(spark, sf_dir), 0.01, 0.05)


@query(f"""WITH {_JUDGED} SELECT reason, count(DISTINCT invoice_id) AS invoices FROM judged WHERE reason IS NOT NULL AND invoice_id NOT IN (SELECT invoice_id FROM judged WHERE reason IS NULL) GROUP BY 1""")
def lost_invoices(spark, sf_dir):
    return reports.lost_invoices(cleaning.judged(raw_lines(spark, sf_dir), _MAPPING))


@query()
def silhouette_kmeans(spark, sf_dir):
    from quern.operators.segments import FEATURES

    return rounded(reports.silhouette(segments._clusters(spark, sf_dir, "kmeans"), FEATURES))


@query(_sql("""SELECT unnest(['lag_1', 'mean_4', 'week']) AS "column", unnest([round(avg((NOT lag_1 BETWEEN l1 AND h1)::INT), 6), round(avg((NOT mean_4 BETWEEN l2 AND h2)::INT), 6), round(avg((NOT week BETWEEN l3 AND h3)::INT), 6)]) AS outside
FROM ft, (SELECT min(lag_1) AS l1, max(lag_1) AS h1, min(mean_4) AS l2, max(mean_4) AS h2, min(week) AS l3, max(week) AS h3 FROM ft WHERE period < DATE '2001-01-01') WHERE period >= DATE '2001-01-01'""", _WEEKLY,
"ft AS (SELECT * FROM (SELECT period, lag(units) OVER o AS lag_1, CASE WHEN count(units) OVER f >= 2 THEN avg(units) OVER f END AS mean_4, week(period) AS week FROM w WINDOW o AS (PARTITION BY brand ORDER BY period), f AS (PARTITION BY brand ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) WHERE lag_1 IS NOT NULL AND mean_4 IS NOT NULL)"))
def feature_ranges(spark, sf_dir):
    table = statistics.feature_table(_brand_weeks(spark, sf_dir), key="brand").dropna(subset=["lag_1", "mean_4"])
    cut = F.col("period") < F.lit("2001-01-01").cast("date")
    return rounded(reports.outside_training(table.where(cut), table.where(~cut), ["lag_1", "mean_4", "week"]), 6)


@query()
def permutation_importance(spark, sf_dir):
    table = statistics.feature_table(_brand_weeks(spark, sf_dir), key="brand").select("lag_1", "mean_4", "week", F.col("units").alias("target")).dropna()
    table = table.select(*[F.col(c).cast("double").alias(c) for c in table.columns])
    fit = table.agg(F.avg("target").alias("y"), F.avg("mean_4").alias("x"), F.regr_slope("target", "mean_4").alias("s")).first()
    return rounded(reports.permutation_importance(table, ["lag_1", "mean_4", "week"], lambda r: r.withColumn("prediction", fit.y + fit.s * (F.col("mean_4") - fit.x))))


@query(_sql("""SELECT class, count(*) AS series, round(median(adi), 4) AS median_adi, round(median(cv), 4) AS median_cv_squared, round(median(z), 4) AS median_zero_share FROM (
  SELECT n / active::DOUBLE AS adi, pow(sd / m, 2) AS cv, 1 - active / n::DOUBLE AS z, CASE WHEN sd IS NULL THEN 'unknown' WHEN n / active::DOUBLE < 1.32 THEN CASE WHEN pow(sd / m, 2) < 0.49 THEN 'smooth' ELSE 'erratic' END ELSE CASE WHEN pow(sd / m, 2) < 0.49 THEN 'intermittent' ELSE 'lumpy' END END AS class
  FROM (SELECT product_code, count(*) AS active, stddev_samp(units) AS sd, avg(units) AS m, date_diff('month', min(period), (SELECT max(period) FROM pp)) + 1 AS n FROM pp WHERE units <> 0 GROUP BY 1) WHERE n >= 26) GROUP BY 1""", _PP))
def class_table(spark, sf_dir):
    return rounded(series.class_table(series.series_profiles(aggregates.product_periods(sales(spark, sf_dir, *ALL), "month"), "month")))


@query(_sql("""SELECT CAST(occurred_at::DATE AS VARCHAR) AS day, CAST(hour(occurred_at) AS BIGINT) AS hour, round(coalesce(sum(CASE WHEN NOT is_return THEN revenue END), 0)::DOUBLE, 4) AS gross_revenue,
  count(DISTINCT CASE WHEN NOT is_return THEN invoice_id END) AS orders, round(coalesce(sum(CASE WHEN NOT is_return THEN quantity END), 0)::DOUBLE, 4) AS units FROM sales GROUP BY 1, 2"""))
def sales_day_hour(spark, sf_dir):
    return rounded(aggregates.daily_with_hour(sales(spark, sf_dir, "occurred_at", "invoice_id", "quantity", "revenue", "is_return")))


@query(_sql("SELECT invoice_id, count(*) AS lines FROM sales WHERE NOT is_return GROUP BY 1"))
def basket_lines(spark, sf_dir):
    rows = aggregates.basket_lines(sales(spark, sf_dir, "invoice_id", "product_code", "is_return"))
    return rows.groupBy("invoice_id").agg(F.count("*").alias("lines"))


_PAIRS = (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))


@query("WITH " + ", ".join(f"r{k} AS (SELECT {x} AS x, {y} AS y, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0::DOUBLE AS ry FROM lineitem)" for k, (x, y) in enumerate(_PAIRS))
       + " " + " UNION ALL ".join(f"SELECT '{x}' AS \"left\", '{y}' AS \"right\", count(*) AS n, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM r{k}" for k, (x, y) in enumerate(_PAIRS)))
def correlation_matrix(spark, sf_dir):
    return rounded(statistics.correlation_matrix(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 5)


@query("""SELECT n, round(m, 4) AS mean, round(q[1], 4) AS q1, round(q[2], 4) AS median, round(q[3], 4) AS q3, round(m3 / pow(m2, 1.5), 5) AS skewness, round(m4 / (m2 * m2) - 3, 5) AS kurtosis, round(m / q[2], 5) AS mean_over_median,
  CASE WHEN n < 8 THEN 'too few values' WHEN abs(m3 / pow(m2, 1.5)) < 0.5 THEN 'roughly symmetric' WHEN abs(m3 / pow(m2, 1.5)) < 1 THEN 'moderately skewed to the ' || CASE WHEN m3 > 0 THEN 'right' ELSE 'left' END ELSE 'strongly skewed to the ' || CASE WHEN m3 > 0 THEN 'right' ELSE 'left' END END AS reading
FROM (SELECT count(*) AS n, any_value(m) AS m, quantile_cont(x, [0.25, 0.5, 0.75]) AS q, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM (SELECT o_totalprice AS x, avg(o_totalprice) OVER () AS m FROM orders))""")
def moments_orders(spark, sf_dir):
    got = statistics.moments(read(spark, sf_dir, "orders"), "o_totalprice").withColumn("reading", statistics.normality(F.col("skewness"), F.col("n")))
    return got.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "q1", "median", "q3")], *[F.round(c, 5).alias(c) for c in ("skewness", "kurtosis", "mean_over_median")], "reading")


@query(_sql("""SELECT brand, CAST(a AS VARCHAR) AS after, CAST(d AS VARCHAR) AS until, date_diff('day', a, d) - 1 AS days FROM (SELECT brand, d, lag(d) OVER (PARTITION BY brand ORDER BY d) AS a FROM (SELECT DISTINCT brand, occurred_at::DATE AS d FROM sales)) WHERE date_diff('day', a, d) > 4"""))
def sales_gaps(spark, sf_dir):
    return rounded(cleaning.gaps(sales(spark, sf_dir, "occurred_at", "brand"), keys=("brand",)))


@query(_sql("SELECT i || ',' || j AS items, f AS freq FROM s2 ORDER BY f DESC, i, j LIMIT 20", _BASKETS))
def itemsets_top(spark, sf_dir):
    return rules.top_itemsets(rules.itemsets(_baskets(spark, sf_dir), 0.01, 2), 20, 2).select(F.array_join("items", ",").alias("items"), "freq")


@query(f"WITH {_JUDGED} SELECT round(avg((happened <> 'not a date')::INT), 6) AS rate FROM raw")
def date_rate(spark, sf_dir):
    return rounded(cleaning.parse_rate(raw_lines(spark, sf_dir), "happened", "iso"), 6)


@query(f"""WITH {_JUDGED}, kept AS (SELECT *, abs(quantity) AS q FROM judged WHERE reason IS NULL), names AS (SELECT product_code, count(product_name) AS k FROM kept GROUP BY 1),
centre AS (SELECT product_code, median(q) AS m, count(*) AS n FROM kept GROUP BY 1), dev AS (SELECT k.*, m, n, abs(q - m) AS d FROM kept k JOIN centre USING (product_code)),
scale AS (SELECT product_code, CASE WHEN median(d) > 0 THEN median(d) ELSE 1.2533::DOUBLE * avg(d) END AS s FROM dev GROUP BY 1)
SELECT coalesce(reason, 'kept') AS measure, count(*) AS value FROM judged GROUP BY 1 UNION ALL SELECT 'raw', count(*) FROM judged
UNION ALL SELECT 'returns', count(CASE WHEN quantity < 0 OR invoice_id LIKE 'C%' THEN 1 END) FROM kept UNION ALL SELECT 'guests', count(CASE WHEN customer_id IS NULL THEN 1 END) FROM kept
UNION ALL SELECT 'outliers', count(CASE WHEN n >= 10 AND s > 0 AND 0.6745 * d > 5 * s THEN 1 END) FROM dev JOIN scale USING (product_code)
UNION ALL SELECT 'unnamed', count(CASE WHEN product_name IS NULL AND k = 0 THEN 1 END) FROM kept JOIN names USING (product_code)""")
def clean_report(spark, sf_dir):
    """Read, judge, clean and report as one run."""
    rows = stored(cleaning.judged(raw_lines(spark, sf_dir), _MAPPING), "judged")
    return cleaning.quality_report(rows, cleaning.completed(rows))


@query(f"WITH {_JUDGED} SELECT unnest(['no date', 'no invoice', 'no price above 0', 'revenue against its sign']) AS problem, 0::BIGINT * count(*) AS rows FROM judged")
def clean_problems(spark, sf_dir):
    return cleaning.problems(cleaning.clean(raw_lines(spark, sf_dir), _MAPPING))


@query(_sql("""SELECT segment, row_number() OVER (ORDER BY count(*) DESC, segment) AS place_first, row_number() OVER (ORDER BY sum(monetary) DESC, segment) AS place_second FROM z GROUP BY 1
QUALIFY abs(row_number() OVER (ORDER BY count(*) DESC, segment) - row_number() OVER (ORDER BY sum(monetary) DESC, segment)) >= 1""", _RFM))
def segment_disagreements(spark, sf_dir):
    return reports.rank_disagreements(rfm.segment_summary(_scored(spark, sf_dir)), "customers", "monetary", "segment", 1)


@query(_sql("SELECT round(sum(n) FILTER (a = b) / sum(n)::DOUBLE, 6) AS retention FROM t", segments._SNAP))
def segment_retention(spark, sf_dir):
    from quern.operators.segments import retention

    return rounded(retention(segments._table(spark, sf_dir)), 6)


@query(_sql("""SELECT round(sum(mape * w) / sum(w), 5) AS weighted_mape, count(*) AS series, (SELECT count(DISTINCT series_id) FROM m) - count(*) AS excluded FROM (
  SELECT series_id, 100 * avg(CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) END) AS mape, sum(actual) AS w FROM m WHERE fold = 0 AND model = 'naive' GROUP BY 1) WHERE mape IS NOT NULL AND w > 0""", forecasts._MEMBERS))
def fc_weighted_mape(spark, sf_dir):
    held = forecasts._members(spark, sf_dir)[1].where("fold = 0 and model = 'naive'")
    per = forecast.scores(held, "series_id").select("series_id", "mape").join(held.groupBy("series_id").agg(F.sum("actual").alias("weight")), "series_id")
    return rounded(forecast.weighted_mape(per), 5)


@query(_sql("""SELECT series_id, CAST(fold AS BIGINT) AS fold, step, round(avg(forecast), 6) AS mean, round(100 * any_value(smape), 5) AS smape FROM m JOIN (
  SELECT model, avg(abs(actual - forecast) / nullif((abs(actual) + abs(forecast)) / 2, 0)) AS smape FROM m WHERE model = 'naive' GROUP BY 1) ON true GROUP BY 1, 2, 3""", forecasts._MEMBERS))
def fc_combination_mean(spark, sf_dir):
    members = forecasts._members(spark, sf_dir)[1]
    smape = forecast.scores(members.where("model = 'naive'"), "model").select(F.round("smape", 5).alias("smape"))
    return rounded(forecast.combined(members, "mean"), 6).select("series_id", "fold", "step", F.col("forecast").alias("mean")).join(F.broadcast(smape))


@query(_sql("""SELECT CAST(period AS VARCHAR) AS period, round(trend, 3) AS trend, round(season, 3) AS season, 52::BIGINT AS cycle FROM t JOIN g USING (phase)""",
            _DECOMPOSED.replace("'month'", "'week'").replace("% 12", "% 52").replace("= 12 AND count(*) OVER b = 12", "= 52 AND count(*) OVER b = 52").replace("6 PRECEDING AND 5 FOLLOWING", "26 PRECEDING AND 25 FOLLOWING").replace("5 PRECEDING AND 6 FOLLOWING", "25 PRECEDING AND 26 FOLLOWING")))
def decompose_week(spark, sf_dir):
    return rounded(series.weekly_seasonality(_net(spark, sf_dir, "week"), "gross_revenue").select("period", "trend", "season", "cycle"), 3)


@query(_sql("SELECT count(*) AS with_one FROM (SELECT invoice_id FROM b GROUP BY 1 HAVING count(*) = 1)", _BASKETS))
def singleton_baskets(spark, sf_dir):
    return _baskets(spark, sf_dir).groupBy("invoice_id").agg(F.count("*").alias("n")).where("n = 1").agg(F.count("*").alias("with_one"))


@query("""WITH p AS (SELECT c_custkey, any_value(c_acctbal) AS x, count(o_orderkey) AS y FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
q AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x = b.x AS tx, a.y = b.y AS ty FROM p a JOIN p b ON a.c_custkey < b.c_custkey)
SELECT (SELECT count(*) FROM p) AS n, count(*) FILTER (s > 0)::DOUBLE AS concordant, count(*) FILTER (s < 0)::DOUBLE AS discordant, count(*) FILTER (tx)::DOUBLE AS ties_x, count(*) FILTER (ty)::DOUBLE AS ties_y, count(*) FILTER (tx AND ty)::DOUBLE AS ties_both,
  round((count(*) FILTER (s > 0) - count(*) FILTER (s < 0)) / sqrt((count(*) - count(*) FILTER (tx))::DOUBLE * (count(*) - count(*) FILTER (ty))), 9) AS tau_b FROM q""")
def kendall_balance(spark, sf_dir):
    """Customers' balances against their numbers of orders."""
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("y"))
    both = read(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_acctbal").alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    return rounded(agreement.kendall(both, "x", "y"), 9)


@query("""WITH v AS (SELECT o_orderpriority AS label, o_totalprice AS x FROM orders), r AS (SELECT label, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM v),
g AS (SELECT label, count(*)::DOUBLE AS n, sum(r) AS s FROM r GROUP BY 1), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM v GROUP BY x)),
h AS (SELECT count(*) AS k, sum(n) AS n, (12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - any_value(t) / (pow(sum(n), 3) - sum(n))) AS h FROM g, t)
SELECT 'kruskal-wallis' AS test, round(exp(-h / 2) * (1 + h / 2), 7) AS p, round(greatest(0, (h - k + 1) / (n - k)), 6) AS effect,
  CASE WHEN greatest(0, (h - k + 1) / (n - k)) < 0.01 THEN 'negligible' WHEN greatest(0, (h - k + 1) / (n - k)) < 0.06 THEN 'small' WHEN greatest(0, (h - k + 1) / (n - k)) < 0.14 THEN 'medium' ELSE 'large' END AS size FROM h""")
def groups_compared(spark, sf_dir):
    """Five priorities' order values: the p of four degrees of freedom has a closed form, which the SQL uses."""
    got = statistics.compare_groups(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(spark.createDataFrame([(got["test"], got["p"], got["effect"], got["size"])], "test string, p double, effect double, size string"), 7).withColumn("effect", F.round("effect", 6))


@query(_sql("""SELECT model, round(avg(r), 6) AS mean_rank, round(any_value(stat), 6) AS statistic, round(exp(-any_value(stat) / 2), 7) AS p, exp(-any_value(stat) / 2) <= 0.05 AS different
FROM rk, (SELECT 12.0::DOUBLE / (n * 3 * 4) * sum(pow(s, 2)) - 3 * n * 4 AS stat FROM (SELECT sum(r)::DOUBLE AS s, count(*)::DOUBLE AS n FROM rk GROUP BY model) GROUP BY n) GROUP BY model""", forecasts._MEMBERS,
"rk AS (SELECT model, fold, rank() OVER (PARTITION BY fold ORDER BY wape) AS r FROM (SELECT model, fold, 100 * sum(abs(actual - forecast)) / sum(abs(actual)) AS wape FROM m WHERE fold > 0 GROUP BY 1, 2))"))
def fc_compared(spark, sf_dir):
    """Friedman's test of the three baselines over the folds: its two degrees of freedom have a closed p, which the SQL uses."""
    got = forecast.compare_models(forecast.scores(forecasts._members(spark, sf_dir)[1], "model", "fold"))
    return rounded(spark.createDataFrame([(m, r, got["statistic"], got["p"], got["different"]) for m, r in got["mean_ranks"].items()], "model string, mean_rank double, statistic double, p double, different boolean"), 7).withColumn("mean_rank", F.round("mean_rank", 6)).withColumn("statistic", F.round("statistic", 6))


_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, {'round(avg(' + c + '), 4)' if c != 'l_returnflag' else 'NULL::DOUBLE'} AS mean,
  {'round(stddev_samp(' + c + '), 4)' if c != 'l_returnflag' else 'NULL::DOUBLE'} AS sd, {'count(*) FILTER (' + c + ' = 0)' if c != 'l_returnflag' else 'NULL::BIGINT'} AS zero, {'min(' + c + ')' if c == 'l_returnflag' else 'NULL::VARCHAR'} AS lowest FROM lineitem""" for c in _PROFILED))
def table_profile(spark, sf_dir):
    """The exact parts of a profile; distinct counts and quantiles are sketches and have tests."""
    got = profile.profiled(read(spark, sf_dir, "lineitem"), _PROFILED)
    return rounded(got.select("column", "rows", "nulls", "mean", "sd", "zero", F.when(F.col("kind") == "string", F.col("lowest")).alias("lowest")))


@query(" UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, {c}) AS place FROM sales GROUP BY 2 ORDER BY place LIMIT 10)""" for c in ("brand", "region")).join([_sql(""), ""]))
def frequent_values(spark, sf_dir):
    return profile.frequent(sales(spark, sf_dir, "brand", "region"), ["brand", "region"])


@query(f"""WITH {_JUDGED}, kept AS (SELECT *, abs(quantity) AS q FROM judged WHERE reason IS NULL), names AS (SELECT product_code, count(product_name) AS k FROM kept GROUP BY 1),
centre AS (SELECT product_code, median(q) AS m, count(*) AS n FROM kept GROUP BY 1), dev AS (SELECT k.*, m, n, abs(q - m) AS d FROM kept k JOIN centre USING (product_code)),
scale AS (SELECT product_code, CASE WHEN median(d) > 0 THEN median(d) ELSE 1.2533::DOUBLE * avg(d) END AS s FROM dev GROUP BY 1),
ids AS (SELECT inv AS o, trim(regexp_replace(regexp_replace(inv, '\\s+', ' ', 'g'), '^(\\d+)\\.0$', '\\1')) AS v, code AS co, nullif(upper(regexp_replace(trim(regexp_replace(code, '\\s+', ' ', 'g')), '^(\\d+)\\.0$', '\\1')), '') AS cv,
  name AS no, nullif(trim(regexp_replace(name, '\\s+', ' ', 'g')), '') AS nv, cust AS uo, nullif(regexp_replace(trim(regexp_replace(cust, '\\s+', ' ', 'g')), '^(\\d+)\\.0$', '\\1'), '') AS uv FROM raw)
SELECT 'read' AS step, 'raw' AS measure, count(*) AS rows FROM raw UNION ALL SELECT 'text', 'invoice_id', count(*) FILTER (o IS DISTINCT FROM nullif(v, '')) FROM ids UNION ALL SELECT 'text', 'product_code', count(*) FILTER (co IS DISTINCT FROM cv) FROM ids
UNION ALL SELECT 'text', 'product_name', count(*) FILTER (no IS DISTINCT FROM nv) FROM ids UNION ALL SELECT 'text', 'customer_id', count(*) FILTER (uo IS DISTINCT FROM uv) FROM ids
UNION ALL SELECT 'excluded', r, count(CASE WHEN reason = r THEN 1 END) FROM judged, (VALUES ('invalid_value'), ('exact_duplicate'), ('non_product_code'), ('non_positive_price')) x(r) GROUP BY 2
UNION ALL SELECT 'marked', 'is_return', count(CASE WHEN quantity < 0 OR invoice_id LIKE 'C%' THEN 1 END) FROM kept UNION ALL SELECT 'marked', 'guest', count(CASE WHEN customer_id IS NULL THEN 1 END) FROM kept
UNION ALL SELECT 'marked', 'is_outlier', count(CASE WHEN n >= 10 AND s > 0 AND 0.6745 * d > 5 * s THEN 1 END) FROM dev JOIN scale USING (product_code)
UNION ALL SELECT 'marked', 'unnamed', count(CASE WHEN product_name IS NULL AND k = 0 THEN 1 END) FROM kept JOIN names USING (product_code)
UNION ALL SELECT 'kept', 'clean', count(*) FROM kept UNION ALL SELECT 'check', 'conserved', CASE WHEN (SELECT count(*) FROM raw) = (SELECT count(*) FROM judged) THEN 1 ELSE 0 END""")
def clean_steps(spark, sf_dir):
    """What each step of the cleaning touched, excluded or marked, counted while it writes."""
    return cleaning.logged(raw_lines(spark, sf_dir), _MAPPING)[1].drop("place")
