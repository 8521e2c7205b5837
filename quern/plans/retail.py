"""Queries over the driver's tables with their SQL: aggregates, shaping, cleaning, statistics, series, customers, rules."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import aggregates, cleaning, layout, rfm, rules, series, shape, statistics
from quern.plans.filters import Filters, within
from quern.sources.sales import SALES_SQL, bucket, read, sales
from quern.sources.stage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE_SQL[key] = sql
        return fn

    return add


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, dates and timestamps as text: what two engines can agree on to the digit."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "double" or kind.startswith("decimal"):
            out.append((F.round(F.col(f.name).cast("double"), places) + F.lit(0.0)).alias(f.name))
        elif kind in ("date", "timestamp_ntz", "timestamp"):
            out.append(F.col(f.name).cast("date").cast("string").alias(f.name))
        elif kind in ("int", "smallint"):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _sql(body: str, *more: str) -> str:
    return f"WITH {SALES_SQL.strip()}{''.join(f', {m}' for m in more)}\n{body}"


ALL = ("invoice_id", "occurred_at", "product_code", "customer_id", "region", "quantity", "unit_price", "revenue", "is_return")
_MEASURES = """
  coalesce(sum(CASE WHEN NOT is_return THEN revenue END), 0)::DOUBLE AS gross_revenue,
  abs(coalesce(sum(CASE WHEN is_return THEN revenue END), 0))::DOUBLE AS returns_value,
  coalesce(sum(CASE WHEN NOT is_return THEN quantity END), 0)::DOUBLE AS units,
  count(DISTINCT CASE WHEN NOT is_return THEN invoice_id END) AS orders"""
_TOTALS = f"""SELECT {_MEASURES}, count(DISTINCT customer_id) AS active_customers,
  coalesce(sum(CASE WHEN NOT is_return AND customer_id IS NULL THEN revenue END), 0)::DOUBLE AS guest_revenue, count(*) AS lines"""
_ROUND_TOTALS = """round(gross_revenue, 4) AS gross_revenue, round(returns_value, 4) AS returns_value, round(units, 4) AS units, orders, active_customers,
  round(guest_revenue, 4) AS guest_revenue, lines, round(gross_revenue - returns_value, 4) AS net_revenue"""


# Filters

@query(_sql("""SELECT count(*) AS lines, round(sum(revenue)::DOUBLE, 4) AS revenue FROM sales
WHERE occurred_at >= TIMESTAMP '1996-01-01' AND occurred_at <= TIMESTAMP '1998-12-31' AND customer_id IS NOT NULL AND NOT is_return
  AND region IN ('NATION_1', 'NATION_2', 'NATION_7')"""))
def sales_filtered(spark, sf_dir):
    kept = Filters(datetime(1996, 1, 1), datetime(1998, 12, 31), regions=("NATION_1", "NATION_2", "NATION_7"), customer_type="identified", include_returns=False)
    return rounded(kept.apply(sales(spark, sf_dir, *ALL)).agg(F.count("*").alias("lines"), F.sum("revenue").cast("double").alias("revenue")))


@query(_sql("""SELECT product_code, count(*) AS lines, round(sum(revenue)::DOUBLE, 4) AS revenue FROM sales
WHERE product_code IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <= 5) GROUP BY product_code"""))
def sales_semi_product(spark, sf_dir):
    small = read(spark, sf_dir, "part").where("p_size <= 5").select(F.col("p_partkey").cast("string").alias("product_code"))
    rows = within(sales(spark, sf_dir, "product_code", "revenue"), small, "product_code")
    return rounded(rows.groupBy("product_code").agg(F.count("*").alias("lines"), F.sum("revenue").cast("double").alias("revenue")))


@query(_sql("""SELECT category, count(*) AS lines FROM sales WHERE category IN (SELECT p_type FROM part GROUP BY p_type HAVING count(*) >= 2 AND min(p_size) <= 1) GROUP BY category"""))
def sales_semi_category(spark, sf_dir):
    chosen = read(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_size").alias("s")).where("n >= 2 and s <= 1").select(F.col("p_type").alias("category"))
    return within(sales(spark, sf_dir, "category"), chosen, "category").groupBy("category").agg(F.count("*").alias("lines"))


# Aggregates

@query(_sql(f"SELECT {_ROUND_TOTALS} FROM t", f"t AS ({_TOTALS} FROM sales)"))
def kpi_totals(spark, sf_dir):
    return rounded(aggregates.totals(sales(spark, sf_dir, "invoice_id", "customer_id", "quantity", "revenue", "is_return")))


@query(_sql("""SELECT round(c.gross_revenue, 4) AS gross_revenue, round(p.gross_revenue, 4) AS previous_gross_revenue, c.orders, p.orders AS previous_orders,
  round(c.gross_revenue / c.orders, 4) AS average_order_value, round(c.returns_value / c.gross_revenue, 6) AS return_rate, round(c.guest_revenue / c.gross_revenue, 6) AS guest_share,
  round((c.gross_revenue - p.gross_revenue) / abs(p.gross_revenue), 6) AS gross_revenue_growth FROM c, p""",
  f"c AS ({_TOTALS} FROM sales WHERE occurred_at >= TIMESTAMP '1998-01-01' AND occurred_at <= TIMESTAMP '1998-12-31')",
  f"p AS ({_TOTALS} FROM sales WHERE occurred_at >= TIMESTAMP '1997-01-02' AND occurred_at <= TIMESTAMP '1998-01-01')"))
def kpi_growth(spark, sf_dir):
    """A year against the window of equal length before it; the boundary instant is in both."""
    rows = sales(spark, sf_dir, "invoice_id", "occurred_at", "customer_id", "quantity", "revenue", "is_return")
    lo, hi = datetime(1998, 1, 1), datetime(1998, 12, 31)
    before = Filters(lo - (hi - lo), lo)
    old = aggregates.totals(before.apply(rows)).withColumn("comparable", F.lit(True))
    got = shape.kpis(aggregates.totals(Filters(lo, hi).apply(rows)), old)
    return got.select(
        F.round("gross_revenue", 4).alias("gross_revenue"), F.round("previous_gross_revenue", 4).alias("previous_gross_revenue"), "orders", "previous_orders",
        F.round("average_order_value", 4).alias("average_order_value"), F.round("return_rate", 6).alias("return_rate"), F.round("guest_share", 6).alias("guest_share"),
        F.round("gross_revenue_growth", 6).alias("gross_revenue_growth"))


def _trend_sql(unit: str) -> str:
    return f"SELECT CAST(date_trunc('{unit}', occurred_at)::DATE AS VARCHAR) AS period, {_MEASURES}, count(DISTINCT customer_id) AS active_customers FROM sales GROUP BY 1"


def _trend_query(unit: str):
    cols = "period, round(gross_revenue, 4) AS gross_revenue, round(returns_value, 4) AS returns_value, round(units, 4) AS units, orders, active_customers, round(gross_revenue - returns_value, 4) AS net_revenue"

    @query(_sql(f"SELECT {cols} FROM t", f"t AS ({_trend_sql(unit)})"), name=f"trend_{unit}")
    def run(spark, sf_dir):
        return rounded(aggregates.trend(sales(spark, sf_dir, "invoice_id", "occurred_at", "customer_id", "quantity", "revenue", "is_return"), unit))

    return run


for _unit in ("day", "week", "month", "year"):
    _trend_query(_unit)


def _breakdown_query(key: str):
    cols = f"{key}, round(gross_revenue, 4) AS gross_revenue, round(returns_value, 4) AS returns_value, round(units, 4) AS units, orders, lines"

    @query(_sql(f"SELECT {cols} FROM t", f"t AS (SELECT {key}, {_MEASURES}, count(*) AS lines FROM sales WHERE {key} IS NOT NULL GROUP BY {key})"), name=f"breakdown_{key.split('_')[0]}")
    def run(spark, sf_dir):
        return rounded(aggregates.breakdown(sales(spark, sf_dir, key, *({"invoice_id", "quantity", "revenue", "is_return"} - {key})), key))

    return run


for _key in ("product_code", "region", "category", "customer_id"):
    _breakdown_query(_key)


@query("""SELECT CAST(date_trunc('day', ts)::DATE AS VARCHAR) AS day, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS events, round(sum(value), 4) AS value
FROM events GROUP BY 1, 2""")
def daily_hour(spark, sf_dir):
    return rounded(read(spark, sf_dir, "events").groupBy(bucket("ts", "day").alias("day"), F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("events"), F.sum("value").alias("value")))


_PERIODS = """SELECT product_code, CAST(date_trunc('month', occurred_at)::DATE AS VARCHAR) AS period,
  round(coalesce(sum(CASE WHEN NOT is_return THEN quantity END), 0)::DOUBLE, 4) AS units, round(coalesce(sum(CASE WHEN NOT is_return THEN revenue END), 0)::DOUBLE, 4) AS gross_revenue,
  count(DISTINCT customer_id) AS customers, count(DISTINCT region) AS regions"""


@query(_sql(f"{_PERIODS}, sum(unit_price)::DOUBLE / count(unit_price) AS avg_unit_price FROM sales GROUP BY 1, 2"))
def product_periods(spark, sf_dir):
    """The average price is not rounded: it is one division of exact sums, where rounding would leave ties to the engine."""
    rows = aggregates.product_periods(sales(spark, sf_dir, *ALL), "month").withColumn("period", F.col("period").cast("string"))
    return rows.select("product_code", "period", F.round("units", 4).alias("units"), F.round("gross_revenue", 4).alias("gross_revenue"), "customers", "regions", "avg_unit_price")


@query(_sql(f"""{_PERIODS} FROM sales WHERE product_code IN (SELECT product_code FROM sales WHERE NOT is_return GROUP BY product_code ORDER BY sum(revenue) DESC, product_code LIMIT 50) GROUP BY 1, 2"""))
def product_periods_top(spark, sf_dir):
    return rounded(aggregates.product_periods(sales(spark, sf_dir, *ALL), "month", 50).drop("avg_unit_price"))


@query(_sql("""SELECT customer_id AS customer, CAST(min(occurred_at)::DATE AS VARCHAR) AS first_purchase, CAST(max(occurred_at)::DATE AS VARCHAR) AS last_purchase,
  count(DISTINCT CASE WHEN NOT is_return THEN invoice_id END) AS frequency, round(coalesce(sum(CASE WHEN NOT is_return THEN revenue END), 0)::DOUBLE, 4) AS monetary_gross,
  round(abs(coalesce(sum(CASE WHEN is_return THEN revenue END), 0))::DOUBLE, 4) AS returns_value, round(coalesce(sum(CASE WHEN NOT is_return THEN quantity END), 0)::DOUBLE, 4) AS units, count(*) AS lines
FROM sales WHERE customer_id IS NOT NULL GROUP BY customer_id"""))
def rfm_base(spark, sf_dir):
    return rounded(aggregates.customers(sales(spark, sf_dir, *ALL)))


@query(_sql("SELECT round(coalesce(sum(CASE WHEN NOT is_return THEN revenue END), 0)::DOUBLE, 4) AS gross_revenue, count(*) AS lines FROM sales WHERE customer_id IS NULL"))
def guest_summary(spark, sf_dir):
    return rounded(aggregates.guests(sales(spark, sf_dir, "customer_id", "revenue", "is_return")))


@query(_sql("SELECT invoice_id, count(DISTINCT product_code) AS products, round(sum(quantity)::DOUBLE, 4) AS units, round(sum(revenue)::DOUBLE, 4) AS revenue FROM sales WHERE NOT is_return GROUP BY invoice_id"))
def basket_sizes(spark, sf_dir):
    return rounded(aggregates.basket_sizes(sales(spark, sf_dir, "invoice_id", "product_code", "quantity", "revenue", "is_return")))


_LABELS = {"region": "region", "quarter": "'Q' || quarter(occurred_at)", "customer_type": "CASE WHEN customer_id IS NULL THEN 'guest' ELSE 'identified' END"}


def _group_query(group: str):
    @query(_sql("SELECT label, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 4) AS least, round(max(value), 4) AS most FROM v GROUP BY label",
                f"v AS (SELECT {_LABELS[group]} AS label, invoice_id, sum(revenue)::DOUBLE AS value FROM sales WHERE NOT is_return GROUP BY 1, 2)"), name=f"group_values_{group}")
    def run(spark, sf_dir):
        values = aggregates.group_values(sales(spark, sf_dir, *ALL), group)
        return rounded(values.groupBy("label").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most")))

    return run


for _group in _LABELS:
    _group_query(_group)


@query(_sql("""SELECT 'date_min' AS kind, CAST(min(occurred_at)::DATE AS VARCHAR) AS value, NULL::DOUBLE AS weight FROM sales
UNION ALL SELECT 'date_max', CAST(max(occurred_at)::DATE AS VARCHAR), NULL FROM sales
UNION ALL SELECT 'lines', CAST(count(*) AS VARCHAR), NULL FROM sales
UNION ALL SELECT 'region', region, round(coalesce(sum(CASE WHEN NOT is_return THEN revenue END), 0)::DOUBLE, 4) FROM sales GROUP BY region
UNION ALL SELECT * FROM (SELECT 'product', product_code, round(coalesce(sum(CASE WHEN NOT is_return THEN revenue END), 0)::DOUBLE, 4) AS w FROM sales GROUP BY product_code ORDER BY w DESC, product_code LIMIT 100)
UNION ALL SELECT DISTINCT 'category', category, NULL::DOUBLE FROM sales"""))
def filter_options(spark, sf_dir):
    return rounded(aggregates.filter_options(sales(spark, sf_dir, "occurred_at", "region", "product_code", "category", "revenue", "is_return")))


# Shaping

@query(_sql("""SELECT CAST(g.period AS VARCHAR) AS period, round(coalesce(net_revenue, 0), 4) AS net_revenue, w.period IS NULL AS filled, is_partial,
  round(CASE WHEN count(CASE WHEN NOT is_partial THEN 1 END) OVER f = 4 THEN avg(CASE WHEN NOT is_partial THEN coalesce(net_revenue, 0) END) OVER f END, 3) AS moving_average,
  round(CASE WHEN NOT is_partial AND NOT lag(is_partial) OVER o AND lag(coalesce(net_revenue, 0)) OVER o <> 0 THEN (coalesce(net_revenue, 0) - lag(coalesce(net_revenue, 0)) OVER o) / abs(lag(coalesce(net_revenue, 0)) OVER o) END, 5) AS growth
FROM (SELECT *, period + 6 > (SELECT max(occurred_at)::DATE FROM sales) AS is_partial FROM grid) g LEFT JOIN w ON w.period = g.period
WINDOW o AS (ORDER BY g.period), f AS (ORDER BY g.period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
"w AS (SELECT date_trunc('week', occurred_at)::DATE AS period, sum(CASE WHEN NOT is_return THEN revenue ELSE 0 END)::DOUBLE - abs(sum(CASE WHEN is_return THEN revenue ELSE 0 END))::DOUBLE AS net_revenue FROM sales GROUP BY 1)",
"grid AS (SELECT unnest(generate_series((SELECT min(period) FROM w)::TIMESTAMP, (SELECT max(period) FROM w)::TIMESTAMP, INTERVAL 7 DAYS))::DATE AS period)"))
def trend_points(spark, sf_dir):
    rows = sales(spark, sf_dir, "invoice_id", "occurred_at", "customer_id", "quantity", "revenue", "is_return")
    got = shape.trend_points(aggregates.trend(rows, "week"), "week", rows)
    return got.select(F.col("period").cast("string").alias("period"), F.round("net_revenue", 4).alias("net_revenue"), "filled", "is_partial", F.round("moving_average", 3).alias("moving_average"), F.round("growth", 5).alias("growth"))


@query(_sql("""SELECT place, product_code AS key, round(gross_revenue, 4) AS value, round(gross_revenue / t, 6) AS share, round(running / t, 6) AS cumulative_share FROM r WHERE place <= 20
UNION ALL SELECT 21, 'others', round(t - top, 4), round((t - top) / t, 6), NULL FROM (SELECT max(t) AS t, sum(gross_revenue) AS top FROM r WHERE place <= 20) WHERE (SELECT count(*) FROM r) > 20""",
"g AS (SELECT product_code, coalesce(sum(CASE WHEN NOT is_return THEN revenue END), 0)::DOUBLE AS gross_revenue FROM sales GROUP BY 1)",
"r AS (SELECT *, row_number() OVER (ORDER BY gross_revenue DESC, product_code) AS place, sum(gross_revenue) OVER () AS t, sum(gross_revenue) OVER (ORDER BY gross_revenue DESC, product_code) AS running FROM g)"))
def pareto_products(spark, sf_dir):
    got = shape.rank(aggregates.breakdown(sales(spark, sf_dir, "product_code", "invoice_id", "quantity", "revenue", "is_return"), "product_code"), "product_code")
    return got.select("place", "key", F.round("value", 4).alias("value"), F.round("share", 6).alias("share"), F.round("cumulative_share", 6).alias("cumulative_share"))


_PRODUCT_REVENUE = "g AS (SELECT product_code, coalesce(sum(CASE WHEN NOT is_return THEN revenue END), 0)::DOUBLE AS x FROM sales GROUP BY 1)"


@query(_sql("SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM (SELECT x, row_number() OVER (ORDER BY x) AS i FROM g WHERE x >= 0)", _PRODUCT_REVENUE))
def gini_products(spark, sf_dir):
    return rounded(shape.gini(aggregates.breakdown(sales(spark, sf_dir, "product_code", "invoice_id", "quantity", "revenue", "is_return"), "product_code"), "gross_revenue"), 6)


@query(_sql("""SELECT max(n) AS entities, greatest(1, ceil(max(n) * 0.2::DOUBLE))::BIGINT AS top_entities, round(sum(CASE WHEN rn <= greatest(1, ceil(n * 0.2::DOUBLE)) THEN x END) / sum(x), 6) AS top_share
FROM (SELECT x, count(*) OVER () AS n, row_number() OVER (ORDER BY x DESC, product_code) AS rn FROM g WHERE x > 0)""", _PRODUCT_REVENUE))
def concentration_products(spark, sf_dir):
    return rounded(shape.concentration(aggregates.breakdown(sales(spark, sf_dir, "product_code", "invoice_id", "quantity", "revenue", "is_return"), "product_code"), "product_code", "gross_revenue"), 6)


def _histogram_sql(x: str, back: str) -> str:
    return _sql(f"""SELECT k AS bin, round({back.format('lo + k * (hi - lo) / 20')}, 3) AS lower, round({back.format('lo + (k + 1) * (hi - lo) / 20')}, 3) AS upper, count(v.x) AS rows
FROM (SELECT unnest(generate_series(0, 19)) AS k) s CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM v) b
LEFT JOIN v ON least(floor((v.x - lo) / ((hi - lo) / 20)), 19) = k GROUP BY k, lo, hi""", f"v AS (SELECT {x} AS x FROM (SELECT sum(revenue)::DOUBLE AS r FROM sales WHERE NOT is_return GROUP BY invoice_id) WHERE r > 0)")


@query(_histogram_sql("r", "{}"))
def hist_revenue(spark, sf_dir):
    return rounded(shape.histogram(aggregates.order_values(sales(spark, sf_dir, "invoice_id", "revenue", "is_return")), "value"), 3)


@query(_histogram_sql("log10(r)", "pow(10.0::DOUBLE, {})"))
def hist_revenue_log(spark, sf_dir):
    return rounded(shape.histogram(aggregates.order_values(sales(spark, sf_dir, "invoice_id", "revenue", "is_return")), "value", log=True), 3)


@query(_sql("""SELECT count(*) AS n, round(avg(x), 4) AS mean, round(any_value(sd), 4) AS sd, round(any_value(q[5]), 4) AS p50, round(any_value(q[9]), 4) AS p99, round(any_value(q[6] - q[4]), 4) AS iqr,
  round(avg(pow((x - m) / sd, 3)), 5) AS skewness, round(avg(pow((x - m) / sd, 4)) - 3, 5) AS kurtosis,
  count(CASE WHEN x < q[4] - 1.5 * (q[6] - q[4]) OR x > q[6] + 1.5 * (q[6] - q[4]) THEN 1 END) AS outside_fences
FROM v, (SELECT avg(x) AS m, stddev_samp(x) AS sd, quantile_cont(x, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM v)""",
"v AS (SELECT sum(revenue)::DOUBLE AS x FROM sales WHERE NOT is_return GROUP BY invoice_id)"))
def describe_revenue(spark, sf_dir):
    got = shape.describe(aggregates.order_values(sales(spark, sf_dir, "invoice_id", "revenue", "is_return")), "value")
    return got.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "p50", "p99", "iqr")], F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"), "outside_fences")


@query("""WITH c AS (SELECT ts::DATE AS day, hour(ts) AS hour, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT CAST((isodow(day) - 1) AS BIGINT) AS bucket, round(avg(v) / (SELECT avg(v) FROM c), 6) AS index, round(sum(v), 4) AS total, count(*) AS observations, count(*) >= 20 AS reliable FROM c GROUP BY 1""")
def calendar_dow(spark, sf_dir):
    cells = read(spark, sf_dir, "events").groupBy(bucket("ts", "day").alias("day"), F.hour("ts").alias("hour")).agg(F.sum("value").alias("gross_revenue"))
    return series.calendar_index(cells, "weekday").select("bucket", F.round("index", 6).alias("index"), F.round("total", 4).alias("total"), "observations", "reliable")


@query("""WITH c AS (SELECT ts::DATE AS day, hour(ts) AS hour, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT CAST(hour AS BIGINT) AS bucket, round(avg(v) / (SELECT avg(v) FROM c), 6) AS index, round(sum(v), 4) AS total, count(*) AS observations, count(*) >= 20 AS reliable FROM c GROUP BY 1""")
def calendar_hour(spark, sf_dir):
    cells = read(spark, sf_dir, "events").groupBy(bucket("ts", "day").alias("day"), F.hour("ts").alias("hour")).agg(F.sum("value").alias("gross_revenue"))
    return series.calendar_index(cells, "hour").select("bucket", F.round("index", 6).alias("index"), F.round("total", 4).alias("total"), "observations", "reliable")


@query(_sql("""SELECT c.brand, CAST(d AS VARCHAR) AS period, round(coalesce(v, 0), 4) AS gross_revenue, v IS NULL AS filled
FROM (SELECT brand, unnest(generate_series(min(p)::TIMESTAMP, max(p)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM w GROUP BY 1) c LEFT JOIN w ON w.brand = c.brand AND p = d""",
"w AS (SELECT brand, occurred_at::DATE AS p, sum(revenue)::DOUBLE AS v FROM sales WHERE NOT is_return GROUP BY 1, 2)"))
def gap_fill_day(spark, sf_dir):
    days = sales(spark, sf_dir, "occurred_at", "brand", "revenue", "is_return").where("not is_return").groupBy("brand", bucket("occurred_at", "day").alias("period")).agg(F.sum("revenue").cast("double").alias("gross_revenue"))
    return rounded(shape.fill_gaps(stored(days, "days"), "day", ["gross_revenue"], keys=["brand"]))


# Cleaning: a rendering of the lines as text, with defects that their keys decide

_RAW = """
raw AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' || l_orderkey ELSE CAST(l_orderkey AS {S}) END AS inv,
         CASE WHEN (l_orderkey + l_partkey) % 97 = 0 THEN 'post' WHEN l_partkey % 5 = 0 THEN ' ' || CAST(l_partkey AS {S}) || '.0' ELSE CAST(l_partkey AS {S}) END AS code,
         CASE WHEN l_orderkey % 31 = 0 THEN '' WHEN l_orderkey % 7 = 0 THEN 'item  ' || CAST(l_partkey AS {S}) ELSE 'Item ' || CAST(l_partkey AS {S}) END AS name,
         CASE WHEN (l_orderkey * 3 + l_linenumber) % 89 = 0 THEN 'not a date' ELSE {DATE} END AS happened,
         CASE WHEN l_returnflag = 'R' THEN '-' ELSE '' END || CAST(CAST(l_quantity AS BIGINT) AS {S}) AS qty,
         CASE WHEN (l_orderkey + l_linenumber) % 83 = 0 THEN '0' ELSE '1,' || CAST(100 + l_partkey % 800 AS {S}) END AS price,
         CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE CAST(l_suppkey AS {S}) || '.0' END AS cust
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_MAPPING = {"invoice_id": "inv", "product_code": "code", "product_name": "name", "occurred_at": "happened", "quantity": "qty", "unit_price": "price", "customer_id": "cust"}


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _RAW.replace("{S}", "STRING").replace("{DATE}", "date_format(o_orderdate, 'yyyy-MM-dd')")
    for name in ("lineitem", "orders"):
        read(spark, sf_dir, name).createOrReplaceTempView(f"_raw_{name}")
    return spark.sql(f"WITH {text.replace('FROM lineitem JOIN orders', 'FROM _raw_lineitem JOIN _raw_orders')} SELECT * FROM raw")


_JUDGED = _RAW.replace("{S}", "VARCHAR").replace("{DATE}", "strftime(o_orderdate, '%Y-%m-%d')") + """,
norm AS (
  SELECT inv AS invoice_id, upper(regexp_replace(trim(code), '^(\\d+)\\.0$', '\\1')) AS product_code, nullif(trim(regexp_replace(name, '\\s+', ' ', 'g')), '') AS product_name,
         CASE WHEN happened = 'not a date' THEN NULL ELSE happened END AS day, CAST(qty AS DOUBLE) AS quantity, CAST(replace(price, ',', '') AS DOUBLE) AS unit_price,
         nullif(regexp_replace(cust, '^(\\d+)\\.0$', '\\1'), '') AS customer_id FROM raw),
judged AS (
  SELECT *, CASE WHEN day IS NULL THEN 'invalid_value' WHEN nth > 1 THEN 'exact_duplicate' WHEN product_code = 'POST' THEN 'non_product_code' WHEN unit_price <= 0 THEN 'non_positive_price' END AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id, product_code, product_name, day, quantity, unit_price, customer_id) AS nth FROM norm))"""


@query(f"WITH {_JUDGED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS rows FROM judged GROUP BY 1")
def clean_reasons(spark, sf_dir):
    return cleaning.reasons(cleaning.judged(raw_lines(spark, sf_dir), _MAPPING))


@query(f"""WITH {_JUDGED}, kept AS (SELECT * FROM judged WHERE reason IS NULL),
counts AS (SELECT product_code, product_name, count(*) AS n FROM kept GROUP BY 1, 2)
SELECT product_code, first(product_name ORDER BY n DESC, product_name) FILTER (product_name IS NOT NULL) AS canonical_name, count(product_name) AS variants FROM counts GROUP BY 1""")
def clean_names(spark, sf_dir):
    return cleaning.product_names(cleaning.judged(raw_lines(spark, sf_dir), _MAPPING).where("reason is null"))


@query(f"""WITH {_JUDGED}, kept AS (SELECT *, abs(quantity) AS q FROM judged WHERE reason IS NULL),
centre AS (SELECT product_code, median(q) AS m, count(*) AS n FROM kept GROUP BY 1), dev AS (SELECT k.*, m, n, abs(q - m) AS d FROM kept k JOIN centre USING (product_code)),
scale AS (SELECT product_code, CASE WHEN median(d) > 0 THEN median(d) ELSE 1.2533::DOUBLE * avg(d) END AS s FROM dev GROUP BY 1)
SELECT count(*) AS rows, count(CASE WHEN quantity < 0 OR invoice_id LIKE 'C%' THEN 1 END) AS returns, count(CASE WHEN customer_id IS NULL THEN 1 END) AS guests,
  round(sum(round(quantity * unit_price, 2)), 2) AS revenue, count(CASE WHEN n >= 10 AND s > 0 AND 0.6745 * d > 5 * s THEN 1 END) AS outliers FROM dev JOIN scale USING (product_code)""")
def clean_rows(spark, sf_dir):
    return cleaning.clean(raw_lines(spark, sf_dir), _MAPPING).agg(
        F.count("*").alias("rows"), F.count_if("is_return").alias("returns"), F.count_if(F.col("customer_id").isNull()).alias("guests"),
        F.round(F.sum("revenue").cast("double"), 2).alias("revenue"), F.count_if("is_outlier").alias("outliers"))


@query(_sql("""SELECT c.region, CAST(isodow(d) - 1 AS BIGINT) AS weekday, count(*) AS possible, count(o.day) AS traded,
  CASE WHEN count(o.day) = 0 THEN 'never' WHEN count(o.day) < 0.2 * count(*) THEN 'rarely' ELSE 'open' END AS verdict
FROM (SELECT region, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM o GROUP BY 1) c LEFT JOIN o ON o.region = c.region AND o.day = d GROUP BY 1, 2""",
"o AS (SELECT DISTINCT region, occurred_at::DATE AS day FROM sales)"))
def clean_calendar(spark, sf_dir):
    return cleaning.closure_calendar(stored(sales(spark, sf_dir, "occurred_at", "region").select("region", F.to_date("occurred_at").alias("occurred_at")).distinct(), "days"), ["region"])


@query(_sql("""SELECT CAST(min(occurred_at)::DATE AS VARCHAR) AS date_min, CAST(max(occurred_at)::DATE AS VARCHAR) AS date_max,
  CAST(CASE WHEN max(occurred_at)::DATE >= date_trunc('week', max(occurred_at))::DATE + 6 THEN date_trunc('week', max(occurred_at))::DATE ELSE date_trunc('week', max(occurred_at))::DATE - 7 END AS VARCHAR) AS last_week,
  CAST(CASE WHEN max(occurred_at)::DATE >= last_day(max(occurred_at)::DATE) THEN date_trunc('month', max(occurred_at))::DATE ELSE (date_trunc('month', max(occurred_at)) - INTERVAL 1 MONTH)::DATE END AS VARCHAR) AS last_month FROM sales"""))
def clean_periods(spark, sf_dir):
    return rounded(cleaning.periods(sales(spark, sf_dir, "occurred_at")))


@query()
def clean_fingerprint(spark, sf_dir):
    return cleaning.fingerprint(cleaning.clean(raw_lines(spark, sf_dir), _MAPPING))


# Statistics

@query(_sql("""SELECT round(-sum(p * log2(p)), 6) AS entropy, count(*) AS categories, round(log2(count(*)), 6) AS max_entropy, round(-sum(p * log2(p)) / log2(count(*)), 6) AS normalised
FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM sales GROUP BY region)"""))
def entropy_region(spark, sf_dir):
    return rounded(statistics.entropy(sales(spark, sf_dir, "region"), "region"), 6)


@query("""WITH c AS (SELECT event_type AS x, hour(ts) AS y, count(*)::DOUBLE AS c FROM events GROUP BY 1, 2), n AS (SELECT sum(c) AS n FROM c),
h AS (SELECT (SELECT -sum(c / n * log2(c / n)) FROM c, n) AS joint, (SELECT -sum(c / n * log2(c / n)) FROM (SELECT sum(c) AS c FROM c GROUP BY x), n) AS hx, (SELECT -sum(c / n * log2(c / n)) FROM (SELECT sum(c) AS c FROM c GROUP BY y), n) AS hy)
SELECT round(joint, 6) AS joint, round(hx, 6) AS h_left, round(hy, 6) AS h_right, round(joint - hy, 6) AS left_given_right, round(greatest(0, hx + hy - joint), 6) AS mutual_information,
  round(2 * greatest(0, hx + hy - joint) / (hx + hy), 6) AS symmetric_uncertainty FROM h""")
def mi_events(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("hour"))
    return rounded(statistics.information(rows, "event_type", "hour"), 6)


_BINNED = """e AS (SELECT quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS q FROM events),
b AS (SELECT event_type, len(list_filter(q, lambda x: x < value)) AS bin FROM events, e WHERE value IS NOT NULL)"""


@query(f"WITH {_BINNED} SELECT CAST(bin AS BIGINT) AS bin, count(*) AS rows FROM b GROUP BY 1")
def quantile_bins_events(spark, sf_dir):
    return statistics.quantile_bins(read(spark, sf_dir, "events").where("value is not null"), "value", 5).groupBy("bin").agg(F.count("*").alias("rows"))


_RANKED = "SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM p"


@query(f"""WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), r AS ({_RANKED})
SELECT count(*) AS n, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM r""")
def corr_quantity_price(spark, sf_dir):
    return rounded(statistics.correlation(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 5)


@query("""WITH v AS (SELECT o_orderpriority AS label, o_totalprice AS x FROM orders), r AS (SELECT label, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM v),
g AS (SELECT label, count(*)::DOUBLE AS n, sum(r) AS s FROM r GROUP BY 1), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM v GROUP BY x)),
h AS (SELECT count(*) AS k, sum(n) AS n, (12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - any_value(t) / (pow(sum(n), 3) - sum(n))) AS h FROM g, t)
SELECT k AS groups, n::BIGINT AS rows, round(h, 4) AS h, round(greatest(0, (h - k + 1) / (n - k)), 6) AS epsilon_squared FROM h""")
def kruskal_h(spark, sf_dir):
    got = statistics.kruskal(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return got.select("groups", "rows", F.round("h", 4).alias("h"), F.round("epsilon_squared", 6).alias("epsilon_squared"))


@query("""WITH v AS (SELECT l_linestatus AS label, l_quantity AS x FROM lineitem WHERE l_linestatus IN ('F', 'O')), r AS (SELECT label, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM v),
g AS (SELECT label, count(*)::DOUBLE AS n, sum(r) AS s FROM r GROUP BY 1), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM v GROUP BY x)),
u AS (SELECT a.label AS f, b.label AS s, a.n AS n1, b.n AS n2, a.s - a.n * (a.n + 1) / 2 AS u, t FROM g a JOIN g b ON a.label < b.label, t)
SELECT f AS first, s AS second, n1::BIGINT AS n_first, n2::BIGINT AS n_second, round(u, 1) AS u, round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial,
  round((abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))), 5) AS z FROM u""")
def mannwhitney_u(spark, sf_dir):
    got = statistics.mann_whitney(read(spark, sf_dir, "lineitem").where("l_linestatus in ('F', 'O')"), "l_linestatus", "l_quantity")
    return got.select("first", "second", "n_first", "n_second", F.round("u", 1).alias("u"), F.round("rank_biserial", 6).alias("rank_biserial"), F.round("z", 5).alias("z"))


_PP = """pp AS (SELECT product_code, date_trunc('month', occurred_at)::DATE AS period, coalesce(sum(CASE WHEN NOT is_return THEN quantity END), 0)::DOUBLE AS units,
  avg(unit_price::DOUBLE) AS price FROM sales GROUP BY 1, 2)"""


@query(_sql("SELECT count(*) AS n, round(regr_slope(y, x), 3) AS slope, round(regr_intercept(y, x), 3) AS intercept, round(regr_r2(y, x), 4) AS r2 FROM (SELECT ln(units) AS y, ln(price) AS x FROM pp WHERE units > 0 AND price > 0)", _PP))
def elasticity(spark, sf_dir):
    got = statistics.elasticity(aggregates.product_periods(sales(spark, sf_dir, *ALL), "month"))
    return got.select("n", F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 4).alias("r2"))


@query(_sql("""SELECT band, count(*) AS n, round(median(units), 4) AS median_units, round(avg(units), 4) AS mean_units, round(median(units) / (SELECT median(units) FROM r), 5) AS ratio_to_all
FROM (SELECT *, CASE WHEN q < 0.8 THEN 'deep discount' WHEN q < 0.95 THEN 'discount' WHEN q < 1.05 THEN 'usual' WHEN q < 1.2 THEN 'above' ELSE 'far above' END AS band FROM r) GROUP BY 1""",
_PP, "r AS (SELECT units, price / median(price) OVER (PARTITION BY product_code) AS q FROM pp WHERE price > 0)"))
def discount_bands(spark, sf_dir):
    got = statistics.discount_bands(aggregates.product_periods(sales(spark, sf_dir, *ALL), "month"))
    return got.select("band", "n", F.round("median_units", 4).alias("median_units"), F.round("mean_units", 4).alias("mean_units"), F.round("ratio_to_all", 5).alias("ratio_to_all"))


_WEEKLY = "w AS (SELECT brand, date_trunc('week', occurred_at)::DATE AS period, coalesce(sum(CASE WHEN NOT is_return THEN quantity END), 0)::DOUBLE AS units FROM sales GROUP BY 1, 2)"


def _brand_weeks(spark, sf_dir):
    return sales(spark, sf_dir, "brand", "occurred_at", "quantity", "is_return").groupBy("brand", bucket("occurred_at", "week").alias("period")).agg(
        F.coalesce(F.sum(F.when(~F.col("is_return"), F.col("quantity"))), F.lit(0)).cast("double").alias("units"))


@query(_sql("""SELECT brand, CAST(period AS VARCHAR) AS period, lag(units, 1) OVER o AS lag_1, lag(units, 8) OVER o AS lag_8,
  round(CASE WHEN count(units) OVER f >= 2 THEN avg(units) OVER f END, 4) AS mean_4, round(CASE WHEN count(units) OVER f >= 2 THEN stddev_samp(units) OVER f END, 4) AS sd_4,
  CAST(week(period) AS BIGINT) AS week,
  CAST(floor(date_diff('day', period, CASE WHEN period > make_date(year(period), 12, 25) THEN make_date(year(period) + 1, 12, 25) ELSE make_date(year(period), 12, 25) END) / 7) AS BIGINT) AS weeks_to_christmas,
  CAST(floor(date_diff('day', min(period) OVER (PARTITION BY brand), period) / 7) AS BIGINT) AS age_weeks
FROM w WINDOW o AS (PARTITION BY brand ORDER BY period), f AS (PARTITION BY brand ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""", _WEEKLY))
def feature_table(spark, sf_dir):
    got = statistics.feature_table(_brand_weeks(spark, sf_dir), key="brand")
    return got.select("brand", F.col("period").cast("string").alias("period"), "lag_1", "lag_8", F.round("mean_4", 4).alias("mean_4"), F.round("sd_4", 4).alias("sd_4"), "week", "weeks_to_christmas", "age_weeks")


@query()
def feature_scores(spark, sf_dir):
    table = statistics.feature_table(_brand_weeks(spark, sf_dir), key="brand")
    return rounded(statistics.feature_scores(table, ["lag_1", "lag_4", "mean_4", "mean_12", "week"]), 6)


# Series

@query(_sql("""SELECT product_code, CAST(n AS BIGINT) AS periods, active, round(1 - active / n::DOUBLE, 5) AS zero_share, round(n / active::DOUBLE, 5) AS adi, round(pow(sd / m, 2), 5) AS cv_squared,
  CASE WHEN sd IS NULL THEN 'unknown' WHEN n / active::DOUBLE < 1.32 THEN CASE WHEN pow(sd / m, 2) < 0.49 THEN 'smooth' ELSE 'erratic' END ELSE CASE WHEN pow(sd / m, 2) < 0.49 THEN 'intermittent' ELSE 'lumpy' END END AS class
FROM (SELECT product_code, count(*) AS active, stddev_samp(units) AS sd, avg(units) AS m, date_diff('month', min(period), (SELECT max(period) FROM pp)) + 1 AS n FROM pp WHERE units <> 0 GROUP BY 1) WHERE n >= 26""", _PP))
def series_profile(spark, sf_dir):
    got = series.series_profiles(aggregates.product_periods(sales(spark, sf_dir, *ALL), "month"), "month")
    return got.select("product_code", "periods", "active", *[F.round(c, 5).alias(c) for c in ("zero_share", "adi", "cv_squared")], "class")


@query()
def series_spectrum(spark, sf_dir):
    return rounded(series.spectra(_brand_weeks(spark, sf_dir), key="brand"), 6)


def _net(spark, sf_dir, unit):
    return aggregates.trend(sales(spark, sf_dir, "invoice_id", "occurred_at", "customer_id", "quantity", "revenue", "is_return"), unit).select("period", "gross_revenue")


_DECOMPOSED = """s AS (SELECT date_trunc('month', occurred_at)::DATE AS period, sum(CASE WHEN NOT is_return THEN revenue ELSE 0 END)::DOUBLE AS x FROM sales GROUP BY 1),
t AS (SELECT period, x, (row_number() OVER (ORDER BY period) - 1) % 12 AS phase, CASE WHEN count(*) OVER a = 12 AND count(*) OVER b = 12 THEN (avg(x) OVER a + avg(x) OVER b) / 2 END AS trend FROM s
  WINDOW a AS (ORDER BY period ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), b AS (ORDER BY period ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)),
f AS (SELECT phase, avg(x - trend) AS m FROM t GROUP BY 1), g AS (SELECT phase, m - (SELECT avg(m) FROM f) AS season FROM f)"""


@query(_sql("SELECT CAST(period AS VARCHAR) AS period, CAST(phase AS BIGINT) AS phase, round(trend, 3) AS trend, round(season, 3) AS season, round(x - trend - season, 3) AS remainder FROM t JOIN g USING (phase)", _DECOMPOSED))
def decompose_month(spark, sf_dir):
    return rounded(series.decompose(_net(spark, sf_dir, "month"), 12, "gross_revenue").drop("value"), 3)


@query(_sql("SELECT round(greatest(0, 1 - var_samp(x - trend - season) / var_samp(x - trend)), 5) AS strength FROM t JOIN g USING (phase) WHERE trend IS NOT NULL", _DECOMPOSED))
def seasonal_strength(spark, sf_dir):
    return rounded(series.seasonal_strength(series.decompose(_net(spark, sf_dir, "month"), 12, "gross_revenue")), 5)


def _anomaly_sql(unit: str, period: int, phase: str) -> str:
    """From 8 cycles on with phases, below with a median of up to 13 periods; values in millions."""
    return _sql("""SELECT CAST(period AS VARCHAR) AS period, round(baseline, 5) AS baseline, CASE WHEN ok THEN round(0.6745 * abs(miss - c) / s, 4) END AS score, coalesce(ok AND 0.6745 * abs(miss - c) / s > 3.5, false) AS flagged,
  CASE WHEN x - baseline > c THEN 'above' ELSE 'below' END AS direction
FROM (SELECT *, n >= 8 AND (SELECT count(miss) FROM d) >= 5 AND s > 1e-6 * greatest(1, abs((SELECT median(x) FROM s)), CASE WHEN positive THEN (SELECT median(abs(miss)) FROM d) ELSE (SELECT quantile_cont(x, 0.75) - quantile_cont(x, 0.25) FROM s) END) AS ok
FROM d, (SELECT CASE WHEN median(abs(miss - c)) > 0 THEN median(abs(miss - c)) ELSE 1.2533 * avg(abs(miss - c)) END AS s FROM d))""",
    f"s AS (SELECT date_trunc('{unit}', occurred_at)::DATE AS period, sum(CASE WHEN NOT is_return THEN revenue ELSE 0 END)::DOUBLE / 1e6 AS x FROM sales GROUP BY 1)",
    f"z AS (SELECT count(*) AS n, count(*) >= 8 * {period} AS seasonal, min(x) > 0 AS positive FROM s)",
    "o AS (SELECT period, x, row_number() OVER (ORDER BY period) AS i, n, seasonal, positive, greatest(3, least(13, n // 3 * 2 + 1)) // 2 AS half FROM s, z)",
    f"""l AS (SELECT o.period, o.x, o.n, o.seasonal, o.positive, {phase.format('o.period')} AS phase, CASE WHEN count(b.x) >= (CASE WHEN o.seasonal THEN {max(3, period // 2)} ELSE 1 END) THEN quantile_cont(b.x, 0.5) END AS level
  FROM o JOIN o b ON b.i BETWEEN o.i - (CASE WHEN o.seasonal THEN {(period + 1 - period % 2) // 2} ELSE o.half END) AND o.i + (CASE WHEN o.seasonal THEN {(period + 1 - period % 2) // 2} ELSE o.half END) GROUP BY o.period, o.x, o.n, o.seasonal, o.positive)""",
    "u AS (SELECT phase, median(CASE WHEN positive THEN x / level ELSE x - level END) AS usual FROM l GROUP BY 1)",
    "j AS (SELECT l.*, usual, (SELECT median(usual) FROM l JOIN u USING (phase)) AS middle FROM l JOIN u USING (phase))",
    "b AS (SELECT *, CASE WHEN NOT seasonal THEN level WHEN positive THEN level * usual / middle ELSE level + usual - middle END AS baseline FROM j)",
    "d AS (SELECT *, CASE WHEN positive THEN x / baseline - 1 ELSE x - baseline END AS miss, (SELECT median(CASE WHEN positive THEN x / baseline - 1 ELSE x - baseline END) FROM b) AS c FROM b)")


def _millions(spark, sf_dir, unit):
    return _net(spark, sf_dir, unit).select("period", (F.col("gross_revenue") / 1e6).alias("millions"))


def _anomaly_query(unit: str, period: int, phase: str):
    @query(_anomaly_sql(unit, period, phase), name=f"anomaly_{unit}")
    def run(spark, sf_dir):
        got = series.anomalies(_millions(spark, sf_dir, unit), "millions", period=period)
        return got.select(F.col("period").cast("string").alias("period"), F.round("baseline", 5).alias("baseline"), F.round("score", 4).alias("score"), "flagged", "direction")

    return run


for _unit, _period, _phase in (("week", 52, "least(week({}), 52)"), ("day", 7, "isodow({})"), ("month", 12, "month({})")):
    _anomaly_query(_unit, _period, _phase)


# Customers

_RFM = """c AS (SELECT customer_id AS customer, min(occurred_at)::DATE AS first_purchase, max(occurred_at)::DATE AS last_purchase, count(DISTINCT CASE WHEN NOT is_return THEN invoice_id END) AS frequency,
  coalesce(sum(CASE WHEN NOT is_return THEN revenue END), 0)::DOUBLE - abs(coalesce(sum(CASE WHEN is_return THEN revenue END), 0))::DOUBLE AS monetary FROM sales WHERE customer_id IS NOT NULL GROUP BY 1),
m AS (SELECT *, date_diff('day', last_purchase, (SELECT max(last_purchase) FROM c)) AS recency FROM c),
k AS (SELECT *, greatest(1, ceil((row_number() OVER (ORDER BY recency DESC, customer) - 1) * 5.0::DOUBLE / (count(*) OVER () - 1)))::BIGINT AS r,
  greatest(1, ceil((row_number() OVER (ORDER BY frequency, customer) - 1) * 5.0::DOUBLE / (count(*) OVER () - 1)))::BIGINT AS f,
  greatest(1, ceil((row_number() OVER (ORDER BY monetary, customer) - 1) * 5.0::DOUBLE / (count(*) OVER () - 1)))::BIGINT AS m FROM m),
z AS (SELECT *, CASE WHEN r >= 4 AND greatest(f, m) >= 4 THEN 'champions' WHEN greatest(f, m) >= 4 AND r >= 2 THEN 'loyal' WHEN r >= 4 AND f <= 2 THEN 'new'
  WHEN r >= 4 THEN 'potential_loyalist' WHEN greatest(f, m) >= 4 THEN 'at_risk' ELSE 'hibernating' END AS segment FROM k)"""


def _scored(spark, sf_dir):
    return rfm.scored(aggregates.customers(sales(spark, sf_dir, *ALL)))


@query(_sql("SELECT customer, CAST(recency AS BIGINT) AS recency, frequency, round(monetary, 4) AS monetary, r, f, m, r || '' || f || m AS cell, segment FROM z", _RFM))
def rfm_scores(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("customer", "recency", "frequency", "monetary", "r", "f", "m", "cell", "segment"))


@query(_sql("""SELECT segment, count(*) AS customers, round(sum(monetary), 3) AS monetary, round(count(*) / (SELECT count(*) FROM z)::DOUBLE, 6) AS customer_share,
  round(sum(monetary) / (SELECT sum(monetary) FROM z), 6) AS money_share, round(median(recency), 4) AS median_recency, round(median(frequency), 4) AS median_frequency, round(median(monetary), 3) AS median_monetary FROM z GROUP BY 1""", _RFM))
def rfm_summary(spark, sf_dir):
    got = rfm.segment_summary(_scored(spark, sf_dir))
    return got.select("segment", "customers", F.round("monetary", 3).alias("monetary"), F.round("customer_share", 6).alias("customer_share"), F.round("money_share", 6).alias("money_share"),
                      F.round("median_recency", 4).alias("median_recency"), F.round("median_frequency", 4).alias("median_frequency"), F.round("median_monetary", 3).alias("median_monetary"))


@query(_sql("""SELECT CAST(b AS BIGINT) AS band, u AS upper, count(customer) AS customers FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS b, unnest([7.0::DOUBLE, 30, 60, 90, 180, 365, 730, NULL]) AS u) g
LEFT JOIN m ON b = CASE WHEN recency <= 7 THEN 0 WHEN recency <= 30 THEN 1 WHEN recency <= 60 THEN 2 WHEN recency <= 90 THEN 3 WHEN recency <= 180 THEN 4 WHEN recency <= 365 THEN 5 WHEN recency <= 730 THEN 6 ELSE 7 END GROUP BY b, u""", _RFM))
def rfm_bands(spark, sf_dir):
    return rfm.bands(rfm.with_measures(aggregates.customers(sales(spark, sf_dir, *ALL))), "recency", rfm.RECENCY_BANDS)


@query(_sql("SELECT round(avg((recency <= 30)::INT), 6) AS recent_share, round(avg((recency > 365)::INT), 6) AS dormant_share FROM m", _RFM))
def recency_split(spark, sf_dir):
    return rounded(rfm.recency_split(rfm.with_measures(aggregates.customers(sales(spark, sf_dir, *ALL)))), 6)


@query(_sql("SELECT segment, row_number() OVER (ORDER BY count(*) DESC, segment) AS place_by_customers, row_number() OVER (ORDER BY sum(monetary) DESC, segment) AS place_by_money FROM z GROUP BY 1", _RFM))
def segment_slope(spark, sf_dir):
    return rfm.segment_slope(rfm.segment_summary(_scored(spark, sf_dir)))


@query(_sql("SELECT customer, round(monetary, 4) AS monetary, round(monetary / (SELECT sum(monetary) FROM m), 8) AS share FROM m ORDER BY monetary DESC, customer LIMIT 10", _RFM))
def top_customers(spark, sf_dir):
    got = rfm.top_customers(rfm.with_measures(aggregates.customers(sales(spark, sf_dir, *ALL))))
    return got.select("customer", F.round("monetary", 4).alias("monetary"), F.round("share", 8).alias("share"))


# Rules: baskets of brands

_BASKETS = """b AS (SELECT invoice_id, brand AS item, min(occurred_at) AS at FROM sales WHERE NOT is_return GROUP BY 1, 2),
n AS (SELECT count(DISTINCT invoice_id) AS n FROM b),
s1 AS (SELECT item, count(*) AS f FROM b GROUP BY 1 HAVING count(*) >= (SELECT ceil(0.01::DOUBLE * n) FROM n)),
k AS (SELECT invoice_id, item FROM b WHERE item IN (SELECT item FROM s1)),
s2 AS (SELECT x.item AS i, y.item AS j, count(*) AS f FROM k x JOIN k y ON x.invoice_id = y.invoice_id AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= (SELECT ceil(0.01::DOUBLE * n) FROM n))"""


def _baskets(spark, sf_dir):
    return rules.basket_items(sales(spark, sf_dir, "invoice_id", "brand", "occurred_at", "is_return"), "brand")


@query(_sql("SELECT count(DISTINCT invoice_id) AS baskets, count(*) AS items, count(DISTINCT item) AS vocabulary FROM b", _BASKETS))
def baskets(spark, sf_dir):
    return _baskets(spark, sf_dir).agg(F.count_distinct("invoice_id").alias("baskets"), F.count("*").alias("items"), F.count_distinct("item").alias("vocabulary"))


@query(_sql("SELECT item AS items, 1::BIGINT AS length, f AS freq FROM s1 UNION ALL SELECT i || ',' || j, 2, f FROM s2", _BASKETS))
def itemsets_2(spark, sf_dir):
    return rules.itemsets(_baskets(spark, sf_dir), 0.01, 2).select(F.array_join("items", ",").alias("items"), "length", "freq")


@query(_sql("""SELECT x.item || ',' || y.item || ',' || z.item AS items, count(*) AS freq FROM k x JOIN k y ON x.invoice_id = y.invoice_id AND x.item < y.item JOIN k z ON x.invoice_id = z.invoice_id AND y.item < z.item
GROUP BY 1 HAVING count(*) >= (SELECT ceil(0.0015::DOUBLE * n) FROM n)""", _BASKETS.replace("0.01", "0.0015")))
def itemsets_3(spark, sf_dir):
    return rules.itemsets(_baskets(spark, sf_dir), 0.0015, 3).where("length = 3").select(F.array_join("items", ",").alias("items"), "freq")


_RULES = _BASKETS + """,
d AS (SELECT i AS a, j AS c, f FROM s2 UNION ALL SELECT j, i, f FROM s2),
r AS (SELECT a, c, d.f::DOUBLE AS b, x.f::DOUBLE AS l, y.f::DOUBLE AS q, n::DOUBLE AS n FROM d JOIN s1 x ON x.item = a JOIN s1 y ON y.item = c, n),
v AS (SELECT *, b / l AS confidence, b * n / (l * q) AS lift FROM r)"""


def _mined_from(items):
    return rules.generate(rules.itemsets(items, 0.01, 2), 0.05, 1.0)


def _mined(spark, sf_dir):
    return _mined_from(_baskets(spark, sf_dir))


def _kept_baskets(spark, sf_dir):
    return stored(_baskets(spark, sf_dir), "baskets")


@query(_sql("""SELECT a AS antecedent, c AS consequent, round(b / n, 8) AS support, round(confidence, 8) AS confidence, round(lift, 8) AS lift, round(b / n - l / n * q / n, 8) AS leverage,
  round((1 - q / n) / (1 - confidence), 6) AS conviction, round(coalesce((confidence - q / n) / greatest(confidence * (1 - q / n), q / n * (1 - confidence)), 0), 6) AS zhang,
  round(b / greatest(l, q), 8) AS all_confidence, round(b / sqrt(l * q), 8) AS cosine, round(least(l, q) / greatest(l, q), 8) AS cross_support FROM v WHERE confidence >= 0.05 AND lift >= 1""", _RULES))
def rules_pairs(spark, sf_dir):
    got = _mined(spark, sf_dir)
    wide = [F.round(c, 6 if c in ("conviction", "zhang") else 8).alias(c) for c in ("support", "confidence", "lift", "leverage", "conviction", "zhang", "all_confidence", "cosine", "cross_support")]
    return got.select(F.array_join("antecedent", ",").alias("antecedent"), "consequent", *wide)


@query()
def rules_pruned(spark, sf_dir):
    found = rules.generate(rules.itemsets(_baskets(spark, sf_dir), 0.0015, 3), 0.05, 1.0)
    return rounded(rules.drop_redundant(rules.drop_trivial(found)).select(F.array_join("antecedent", ",").alias("antecedent"), "consequent", "confidence", "lift"), 8)


@query(_sql("SELECT count(*) AS items, count(r.c) AS reachable, round(count(r.c) / count(*)::DOUBLE, 6) AS share FROM (SELECT DISTINCT item FROM b) i LEFT JOIN (SELECT DISTINCT c FROM v WHERE confidence >= 0.05 AND lift >= 1) r ON r.c = i.item", _RULES))
def rule_coverage(spark, sf_dir):
    return rounded(rules.coverage(_mined(spark, sf_dir), _baskets(spark, sf_dir)), 6)


@query(_sql("SELECT least(a, c) AS a, greatest(a, c) AS b, round(max(lift), 8) AS weight FROM v WHERE confidence >= 0.05 AND lift >= 1 GROUP BY 1, 2", _RULES))
def affinity_edges(spark, sf_dir):
    return rounded(rules.affinity(_mined(spark, sf_dir), "lift"), 8)


@query(_sql("""SELECT count(*) AS baskets, round(avg(z), 6) AS mean_zones, round(median(z), 4) AS median_zones, max(z) AS most_zones, round(avg((z = 1)::INT), 6) AS single_share
FROM (SELECT invoice_id, count(DISTINCT zone) AS z FROM b JOIN (SELECT item, (row_number() OVER (ORDER BY count(*) DESC, item) - 1) // 5 AS zone FROM b GROUP BY 1) USING (item) GROUP BY 1)""", _BASKETS))
def picking_effort_popularity(spark, sf_dir):
    items = _baskets(spark, sf_dir)
    return rounded(rules.picking_effort(items, rules.popularity_zones(items, 5)), 6)


@query()
def picking_effort_affinity(spark, sf_dir):
    items = _baskets(spark, sf_dir)
    return rounded(rules.picking_effort(items, rules.affinity_zones(rules.affinity(_mined(spark, sf_dir)), items, 5)), 6)


_LAYOUTS = """ly AS (SELECT 'popularity' AS layout, item, (row_number() OVER (ORDER BY count(*) DESC, item) - 1) // 5 AS zone FROM b GROUP BY item
  UNION ALL SELECT 'random_' || s, item, (row_number() OVER (PARTITION BY s ORDER BY md5(item || ':' || s), item) - 1) // 5 FROM (SELECT DISTINCT item FROM b), (SELECT unnest(range(1, 6)) AS s))"""


@query(_sql("""SELECT layout, count(*) AS baskets, round(avg(z), 6) AS mean_zones, round(median(z), 6) AS median_zones, max(z) AS most_zones, round(avg((z = 1)::INT), 6) AS single_share
FROM (SELECT layout, invoice_id, count(DISTINCT zone) AS z FROM b JOIN ly USING (item) GROUP BY 1, 2) GROUP BY 1""", _BASKETS, _LAYOUTS))
def layout_baselines(spark, sf_dir):
    items = _kept_baskets(spark, sf_dir)
    return rounded(layout.efforts(items, layout.baselines(items, 5)), 6)


@query()
def layout_evaluated(spark, sf_dir):
    """Zones grown from rules, against random ones and the order of popularity."""
    items = _kept_baskets(spark, sf_dir)
    return rounded(layout.evaluated(items, layout.affinity_zones(rules.affinity(_mined_from(items)), items, 5), 5), 6)


@query()
def layout_merged(spark, sf_dir):
    """The same with zones merged in rounds."""
    items = _kept_baskets(spark, sf_dir)
    return rounded(layout.evaluated(items, layout.merged_zones(rules.affinity(_mined_from(items)), items, 5), 5), 6)
