"""Queries of segmentation over time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quern.operators import choice, segments
from quern.plans.retail import _RFM, _scored, _sql, query, rounded
from quern.sources.sales import order_sales
from quern.sources.stage import stored

SPANS = segments.windows(date(1995, 1, 1), date(2001, 8, 1), 4, 730)

_SNAP = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, DATE '{lo}', DATE '{hi}')" for k, lo, hi in SPANS) + """) v(win, lo, hi)),
s AS (SELECT win, customer_id AS customer, date_diff('day', max(occurred_at)::DATE, any_value(hi)) AS recency, count(DISTINCT CASE WHEN NOT is_return THEN invoice_id END) AS frequency,
  coalesce(sum(CASE WHEN NOT is_return THEN revenue END), 0)::DOUBLE - abs(coalesce(sum(CASE WHEN is_return THEN revenue END), 0))::DOUBLE AS monetary
  FROM sales JOIN g ON occurred_at >= lo AND occurred_at <= hi::TIMESTAMP WHERE customer_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT win, customer, CASE WHEN recency <= 90 THEN 'a' WHEN recency <= 365 THEN 'b' ELSE 'c' END AS label FROM s),
t AS (SELECT x.label AS a, y.label AS b, count(*) AS n FROM l x JOIN l y ON x.customer = y.customer AND x.win = 2 AND y.win = 3 GROUP BY 1, 2)"""


#: Agreement of the labels of every pair of windows.
STABILITY_SQL = """st AS (SELECT x.win AS earlier, y.win AS later, x.label AS a, y.label AS b, count(*)::DOUBLE AS n FROM l x JOIN l y ON x.customer = y.customer AND x.win < y.win GROUP BY 1, 2, 3, 4),
sp AS (SELECT earlier, later, k::BIGINT AS customers, (s - x * y / (k * (k - 1) / 2)) / ((x + y) / 2 - x * y / (k * (k - 1) / 2)) AS ari, stayed / k AS retention
  FROM (SELECT earlier, later, sum(n) AS k, sum(n * (n - 1) / 2) AS s, sum(n) FILTER (a = b) AS stayed FROM st GROUP BY 1, 2)
  JOIN (SELECT earlier, later, sum(n * (n - 1) / 2) AS x FROM (SELECT earlier, later, a, sum(n) AS n FROM st GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (earlier, later)
  JOIN (SELECT earlier, later, sum(n * (n - 1) / 2) AS y FROM (SELECT earlier, later, b, sum(n) AS n FROM st GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (earlier, later))"""


def _snapshots(spark, sf_dir):
    return stored(segments.snapshots(order_sales(spark, sf_dir), SPANS), "snapshots")


@query(_sql("SELECT CAST(win AS BIGINT) AS window, customer, recency, frequency, round(monetary, 4) AS monetary FROM s", _SNAP))
def rfm_windows(spark, sf_dir):
    return rounded(_snapshots(spark, sf_dir).select("window", "customer", "recency", "frequency", "monetary"))


@query(_sql("SELECT customer FROM s GROUP BY 1 HAVING count(DISTINCT win) = 4", _SNAP))
def common_customers(spark, sf_dir):
    return segments.common_customers(_snapshots(spark, sf_dir))


@query(_sql("""SELECT customer, round((-recency - a1) / d1, 5) AS x_recency, round((ln(1 + frequency) - a2) / d2, 5) AS x_frequency, round((sign(monetary) * ln(1 + abs(monetary)) - a3) / d3, 5) AS x_monetary
FROM s, (SELECT avg(-recency) AS a1, stddev_pop(-recency) AS d1, avg(ln(1 + frequency)) AS a2, stddev_pop(ln(1 + frequency)) AS d2, avg(sign(monetary) * ln(1 + abs(monetary))) AS a3, stddev_pop(sign(monetary) * ln(1 + abs(monetary))) AS d3 FROM s WHERE win = 3) WHERE win = 3""", _SNAP))
def feature_matrix(spark, sf_dir):
    rows = _snapshots(spark, sf_dir).where("window = 3")
    return rounded(segments.matrix(rows).select("customer", "x_recency", "x_frequency", "x_monetary"), 5)


def labelled(snapshots):
    label = F.when(F.col("recency") <= 90, "a").when(F.col("recency") <= 365, "b").otherwise("c")
    return snapshots.select("window", "customer", label.alias("label"))


def _labels(spark, sf_dir):
    return labelled(_snapshots(spark, sf_dir))


def _table(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    return stored(segments.contingency(labels.where("window = 2"), labels.where("window = 3")), "table")


@query(_sql("SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a)::DOUBLE, 6) AS share_of_source, a = b AS stays FROM t", _SNAP))
def migration(spark, sf_dir):
    return rounded(segments.migration(_table(spark, sf_dir)), 6)


@query(_sql("""SELECT k::BIGINT AS customers, round((s - x * y / (k * (k - 1) / 2)) / ((x + y) / 2 - x * y / (k * (k - 1) / 2)), 6) AS adjusted_rand FROM (SELECT sum(n)::DOUBLE AS k, sum(n * (n - 1) / 2.0::DOUBLE) AS s FROM t),
(SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS x FROM (SELECT sum(n)::DOUBLE AS n FROM t GROUP BY a)), (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS y FROM (SELECT sum(n)::DOUBLE AS n FROM t GROUP BY b))""", _SNAP))
def adjusted_rand(spark, sf_dir):
    return rounded(segments.adjusted_rand(_table(spark, sf_dir)), 6)


def _clusters(spark, sf_dir, algorithm):
    return stored(segments.clustered(segments.matrix(_snapshots(spark, sf_dir).where("window = 3")), 3, algorithm, starts=10 if algorithm == "kmeans" else 5), "clusters")


@query()
def segments_kmeans(spark, sf_dir):
    return rounded(segments.profiles(_clusters(spark, sf_dir, "kmeans")))


@query()
def segments_mixture(spark, sf_dir):
    return rounded(segments.quality(_clusters(spark, sf_dir, "mixture")))


@query(_sql("SELECT CAST(earlier AS BIGINT) AS earlier, CAST(later AS BIGINT) AS later, customers, round(ari, 6) AS adjusted_rand, round(retention, 6) AS retention FROM sp", _SNAP, STABILITY_SQL))
def stability_windows(spark, sf_dir):
    return rounded(segments.stability(_labels(spark, sf_dir)), 6)


@query(_sql("""SELECT count(*) AS pairs, round(avg(ari), 6) AS mean_adjusted_rand, round(avg(ari) FILTER (later = earlier + 1), 6) AS mean_consecutive, round(avg(retention), 6) AS mean_retention, min(customers) AS thinnest,
  CASE WHEN avg(ari) >= 0.75 THEN 'stable' WHEN avg(ari) >= 0.4 THEN 'moderately stable' ELSE 'unstable' END AS verdict FROM sp""", _SNAP, STABILITY_SQL))
def stability_summary(spark, sf_dir):
    return rounded(segments.stability_summary(segments.stability(_labels(spark, sf_dir))), 6)


@query(_sql("""SELECT count(*) AS points, round(avg(CASE WHEN n > 1 THEN coalesce((b - a) / greatest(a, b), 0) ELSE 0 END), 5) AS silhouette_squared FROM (
  SELECT id, any_value(n) FILTER (own) AS n, any_value(d * n / greatest(n - 1, 1)) FILTER (own) AS a, min(d) FILTER (NOT own) AS b FROM (
    SELECT p.id, p.label = c.label AS own, c.n, pow(p.x1, 2) + pow(p.x2, 2) + pow(p.x3, 2) + c.q - 2 * (p.x1 * c.m1 + p.x2 * c.m2 + p.x3 * c.m3) AS d
    FROM p, (SELECT label, count(*) AS n, avg(pow(x1, 2) + pow(x2, 2) + pow(x3, 2)) AS q, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM p GROUP BY 1) c) GROUP BY 1)""", _SNAP,
"""p AS (SELECT s.customer AS id, label, (-recency - a1) / d1 AS x1, (ln(1 + frequency) - a2) / d2 AS x2, (sign(monetary) * ln(1 + abs(monetary)) - a3) / d3 AS x3 FROM s JOIN l ON l.customer = s.customer AND l.win = 3,
  (SELECT avg(-recency) AS a1, stddev_pop(-recency) AS d1, avg(ln(1 + frequency)) AS a2, stddev_pop(ln(1 + frequency)) AS d2, avg(sign(monetary) * ln(1 + abs(monetary))) AS a3, stddev_pop(sign(monetary) * ln(1 + abs(monetary))) AS d3 FROM s WHERE win = 3) WHERE s.win = 3)"""))
def silhouette_labels(spark, sf_dir):
    rows = segments.matrix(_snapshots(spark, sf_dir).where("window = 3"))
    labels = _labels(spark, sf_dir).where("window = 3").select("customer", F.col("label").alias("cluster"))
    return rounded(choice.silhouette_squared(rows.join(labels, "customer")), 5)


@query()
def segments_by_k(spark, sf_dir):
    """Every index, the gap and the elbow for 2 to 8 clusters."""
    return rounded(choice.compared(segments.matrix(_snapshots(spark, sf_dir).where("window = 3"))), 4)


@query()
def segments_ward(spark, sf_dir):
    """Profiles of Ward's clusters of the last window's customers."""
    return rounded(segments.profiles(_clusters(spark, sf_dir, "ward")))


@query()
def stability_clusters(spark, sf_dir):
    """Agreement of the clusters of every pair of windows, by each algorithm; a window's clusters are named after those before."""
    snaps, out = _snapshots(spark, sf_dir), None
    for algorithm in ("kmeans", "mixture", "ward"):
        one = segments.stability(segments.cluster_windows(snaps, 3, algorithm, starts=2)).withColumn("algorithm", F.lit(algorithm))
        out = one if out is None else out.union(one)
    return rounded(out, 4)


#: The RFM segments.
BANDS = ("champions", "loyal", "new", "potential_loyalist", "at_risk", "hibernating")


@query(_sql("SELECT label, " + ", ".join(f"count(*) FILTER (segment = '{b}') AS {b}" for b in BANDS) + ", "
            + "CASE " + " ".join(f"WHEN count(*) FILTER (segment = '{b}') = greatest(" + ", ".join(f"count(*) FILTER (segment = '{c}')" for c in BANDS) + f") THEN '{b}'" for b in BANDS) + " END AS largest, "
            + "round(greatest(" + ", ".join(f"count(*) FILTER (segment = '{c}')" for c in BANDS) + ") / count(*)::DOUBLE, 6) AS largest_share FROM l JOIN z ON z.customer = l.customer WHERE win = 3 GROUP BY 1", _SNAP, _RFM))
def segments_against_bands(spark, sf_dir):
    """The last window's labels against the RFM segments of all time."""
    bands = _scored(spark, sf_dir).select("customer", F.col("segment").alias("band"))
    return rounded(segments.against(_labels(spark, sf_dir).where("window = 3").select("customer", "label"), bands, BANDS), 6)
