"""Segmentation of customers over time: windows, features, clusters, their quality, stability and profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import mixture
from quern.operators.aggregates import customers
from quern.operators.rfm import with_measures
from quern.operators.shape import ratio
from quern.operators.ward import ward_each
from quern.sources.stage import stored

FEATURES = ("recency", "frequency", "monetary")
#: Points to a task of a fit.
POINTS = 20_000


def windows(first: date, last: date, count: int = 4, least_days: int = 180, days: int | None = None) -> list[tuple[int, date, date]]:
    """(window, from, to): evenly spaced ends after least_days; from the start of the data, or the last `days`."""
    span = (last - first).days - least_days
    if count < 1 or span < count - 1:
        raise ValueError("the data are too short for so many windows")
    ends = [first + timedelta(days=least_days + (span * k // (count - 1) if count > 1 else span)) for k in range(count)]
    return [(k, max(first, e - timedelta(days=days)) if days else first, e) for k, e in enumerate(ends)]


def snapshots(sales: DataFrame, spans: Sequence[tuple[int, date, date]]) -> DataFrame:
    """Customers' measures as of each window's end (midnight, so that day's later sales are not in it).

    A line belongs to every window whose range holds it.  One pass over the lines serves the handful
    of windows; the customers' rows are stored, so that their measures do not take another.
    """
    at = F.col("occurred_at")
    inside = [F.when((at >= F.lit(lo)) & (at <= F.lit(hi).cast("timestamp_ntz")), F.lit(k).cast("long")) for k, lo, hi in spans]
    rows = sales.where(F.coalesce(*inside).isNotNull()).withColumn("window", F.explode(F.array_compact(F.array(*inside))))
    ends = F.create_map(*[x for k, _, hi in spans for x in (F.lit(k).cast("long"), F.lit(hi))])
    found = with_measures(stored(customers(rows, ["window"]), "customers"), ["window"]).withColumn("recency", F.datediff(ends[F.col("window")], "last_purchase").cast("long"))
    return found.select(*[c for c in found.columns if c != "window"], "window")


def common_customers(frames: DataFrame) -> DataFrame:
    """Customers that every window has."""
    n = frames.agg(F.count_distinct("window").alias("n"))
    return frames.groupBy("customer").agg(F.count_distinct("window").alias("k")).join(F.broadcast(n)).where("k = n").select("customer")


def transformed(name: str) -> Column:
    """Recency negated, frequency as a logarithm, money as a signed logarithm."""
    x = F.col(name).cast("double")
    return {"recency": -x, "frequency": F.log1p(x), "monetary": F.signum(x) * F.log1p(F.abs(x))}.get(name, x)


def matrix(rows: DataFrame, features: Sequence[str] = FEATURES, scaler: str = "standard") -> DataFrame:
    """rows with x_<feature> transformed and scaled: standard (population deviation), robust (median, quartiles), minmax or none."""
    values = rows.select("*", *[transformed(c).alias(f"x_{c}") for c in features]).dropna(subset=[f"x_{c}" for c in features])
    aggs = []
    for c in features:
        x = f"x_{c}"
        q = F.percentile(x, [0.25, 0.5, 0.75])
        centre, width = {
            "standard": (F.avg(x), F.stddev_pop(x)), "robust": (F.element_at(q, 2), F.element_at(q, 3) - F.element_at(q, 1)),
            "minmax": (F.min(x), F.max(x) - F.min(x)), "none": (F.lit(0.0), F.lit(1.0)),
        }[scaler]
        aggs += [centre.alias(f"c_{c}"), F.when(width > 1e-12, width).otherwise(1.0).alias(f"w_{c}")]
    both = values.join(F.broadcast(values.agg(*aggs)))
    return both.select(*rows.columns, *[((F.col(f"x_{c}") - F.col(f"c_{c}")) / F.col(f"w_{c}")).alias(f"x_{c}") for c in features])


def clustered(points: DataFrame, k: int, algorithm: str = "kmeans", features: Sequence[str] = FEATURES, starts: int = 5, seed: int = 17) -> DataFrame:
    """points with cluster: the best of several seeded starts of k-means (least cost) or a Gaussian mixture (likelihood), or Ward's tree cut at k."""
    return clustered_each({0: points}, k, algorithm, features, starts, seed)[0]


def clustered_each(frames: dict[int, DataFrame], k: int, algorithm: str = "kmeans", features: Sequence[str] = FEATURES, starts: int = 5, seed: int = 17) -> dict[int, DataFrame]:
    """`clustered` of each of a handful of tables on its own; a round of mixtures or of Ward's merges is one job for all tables and starts."""
    if algorithm == "ward":
        return ward_each(frames, k, features)
    names = [f"x_{c}" for c in features]
    held = {}
    for s, points in frames.items():
        rows = stored(VectorAssembler(inputCols=names, outputCol="_v").transform(points), "points")
        held[s] = rows.coalesce(max(1, math.ceil(rows.count() / POINTS)))  # a fit is many small jobs
    if algorithm == "kmeans":
        return {s: _nearest(rows, k, starts, seed) for s, rows in held.items()}
    begun = {(s, t): model for s, rows in held.items() for t, model in enumerate(mixture.begun(rows, k, starts, seed, names))}
    best = mixture.fits(_sets(held, names), begun, names)
    return {s: mixture.labelled(rows.drop("_v"), best[s][1], names) for s, rows in held.items()}


def _sets(held: dict[int, DataFrame], names: Sequence[str]) -> DataFrame:
    """The points of all tables, with the table's number."""
    each = [rows.select(F.lit(s).cast("long").alias("set"), *names) for s, rows in held.items()]
    return reduce(DataFrame.union, each)


def _nearest(rows: DataFrame, k: int, starts: int, seed: int) -> DataFrame:
    models = [KMeans(k=k, seed=seed + s, featuresCol="_v", predictionCol="cluster").fit(rows) for s in range(starts)]
    best = min(models, key=lambda model: model.summary.trainingCost)
    return best.transform(rows).withColumn("cluster", F.col("cluster").cast("long")).drop("_v")


def quality(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row: within and between sums of squares, and the Calinski-Harabasz and Davies-Bouldin indices, from sums by cluster."""
    names = [f"x_{c}" for c in features]
    by = rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m_{x}") for x in names], F.sum(sum((F.pow(x, F.lit(2)) for x in names), F.lit(0.0))).alias("sq"))
    by = by.withColumn("within", F.greatest(F.lit(1e-12), F.col("sq") - F.col("n") * sum((F.pow(f"m_{x}", F.lit(2)) for x in names), F.lit(0.0))))
    centres = by.select(F.col("cluster").alias("_c"), *[F.col(f"m_{x}").alias(f"c_{x}") for x in names])
    spread = rows.join(F.broadcast(centres), F.col("cluster") == F.col("_c")).groupBy("cluster").agg(F.avg(F.sqrt(sum((F.pow(F.col(x) - F.col(f"c_{x}"), 2) for x in names), F.lit(0.0)))).alias("s"))
    k = by.join(spread, "cluster").collect()  # one row for each cluster
    n, total = sum(r.n for r in k), {x: sum(r.n * r[f"m_{x}"] for r in k) for x in names}
    within = sum(r.within for r in k)
    between = sum(r.n * sum((r[f"m_{x}"] - total[x] / n) ** 2 for x in names) for r in k)
    far = lambda a, b: math.sqrt(sum((a[f"m_{x}"] - b[f"m_{x}"]) ** 2 for x in names)) or math.inf
    db = sum(max(((a.s + b.s) / far(a, b) for b in k if b.cluster != a.cluster), default=0.0) for a in k) / len(k)
    ch = (between / (len(k) - 1)) / (within / (n - len(k))) if len(k) > 1 and n > len(k) else None
    return rows.sparkSession.createDataFrame([(len(k), within, between, ch, db)], "clusters long, within double, between double, calinski_harabasz double, davies_bouldin double")


def elbow(costs: dict[int, float]) -> tuple[int, bool]:
    """The k farthest from the chord of cost by k; distinct if over 1.5 times the median distance."""
    ks = sorted(costs)
    (x0, y0), (x1, y1) = (ks[0], costs[ks[0]]), (ks[-1], costs[ks[-1]])
    away = {k: abs((y1 - y0) * k - (x1 - x0) * costs[k] + x1 * y0 - y1 * x0) / (math.hypot(y1 - y0, x1 - x0) or 1.0) for k in ks}
    best = max(ks, key=lambda k: (away[k], -k))
    inner = sorted(away[k] for k in ks[1:-1]) or [0.0]
    return best, away[best] > 1.5 * inner[len(inner) // 2]


def contingency(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, b, n): customers by label in both partitions (columns customer, label)."""
    return first.select("customer", F.col("label").alias("a")).join(second.select("customer", F.col("label").alias("b")), "customer").groupBy("a", "b").agg(F.count("*").alias("n"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row: chance-adjusted pair agreement of a contingency table."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = table.agg(pairs("n").alias("s"), F.sum("n").alias("all"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs("n").alias("sa"))
    columns = table.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs("n").alias("sb"))
    joined = both.join(F.broadcast(rows)).join(F.broadcast(columns))
    expected = F.try_divide(F.col("sa") * F.col("sb"), F.col("all") * (F.col("all") - 1) / 2)
    top = (F.col("sa") + F.col("sb")) / 2
    return joined.select(F.col("all").alias("customers"), F.when(top == expected, 1.0).otherwise(F.try_divide(F.col("s") - expected, top - expected)).alias("adjusted_rand"))


def stability(labels: DataFrame) -> DataFrame:
    """(earlier, later, customers, adjusted_rand, retention) of every pair of windows, over the customers in both.

    labels: window, customer, label.  One join by customer serves all pairs; windows are few.
    """
    left = labels.select("customer", F.col("window").alias("earlier"), F.col("label").alias("a"))
    right = labels.select("customer", F.col("window").alias("later"), F.col("label").alias("b"))
    pair = ["earlier", "later"]
    table = stored(left.join(right, "customer").where("earlier < later").groupBy(*pair, "a", "b").agg(F.count("*").alias("n")), "contingency")
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = table.groupBy(*pair).agg(pairs("n").alias("s"), F.sum("n").alias("customers"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("stayed"))
    rows = table.groupBy(*pair, "a").agg(F.sum("n").alias("n")).groupBy(*pair).agg(pairs("n").alias("sa"))
    columns = table.groupBy(*pair, "b").agg(F.sum("n").alias("n")).groupBy(*pair).agg(pairs("n").alias("sb"))
    expected = F.try_divide(F.col("sa") * F.col("sb"), F.col("customers") * (F.col("customers") - 1) / 2)
    top = (F.col("sa") + F.col("sb")) / 2
    return both.join(rows, pair).join(columns, pair).select(
        *pair, "customers", F.when(top == expected, 1.0).otherwise(F.try_divide(F.col("s") - expected, top - expected)).alias("adjusted_rand"), ratio(F.col("stayed"), F.col("customers")).alias("retention"))


def stability_summary(pairs: DataFrame) -> DataFrame:
    """One row: mean agreement and retention over all pairs, agreement of neighbours, the thinnest pair, and a verdict."""
    nth = pairs.withColumn("_step", F.col("later") - F.col("earlier"))
    got = nth.agg(
        F.count("*").alias("pairs"), F.avg("adjusted_rand").alias("mean_adjusted_rand"), F.avg(F.when(F.col("_step") == 1, F.col("adjusted_rand"))).alias("mean_consecutive"),
        F.avg("retention").alias("mean_retention"), F.min("customers").alias("thinnest"))
    return got.withColumn("verdict", verdict(F.col("mean_adjusted_rand"), F.col("mean_retention")))


def assigned(gain: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of the largest total gain (square), by shortest augmenting paths."""
    n = len(gain)
    cost = gain.max(initial=0) - gain
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for row in range(1, n + 1):
        row_of[0], at = row, 0
        least, before, used = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
        while row_of[at]:
            used[at] = True
            reduced = cost[row_of[at] - 1] - u[row_of[at]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], before[1:][better] = reduced[better], at
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            step_to = int(free.argmin())
            step = free[step_to]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            at = step_to
        while at:
            row_of[at], at = row_of[before[at]], before[at]
    out = np.empty(n, np.int64)
    out[row_of[1:] - 1] = np.arange(n)
    return out


def matched(table: DataFrame) -> dict:
    """The renaming of b's labels to a's that keeps most customers; labels that find no partner are left out.

    The cells of a table of labels, one a pair of clusters, meet on the driver.
    """
    cells = {(r.a, r.b): r.n for r in table.collect()}
    left, right = sorted({a for a, _ in cells}), sorted({b for _, b in cells})
    gain = np.zeros((max(len(left), len(right)),) * 2)
    for (a, b), n in cells.items():
        gain[left.index(a), right.index(b)] = n
    return {right[j]: left[i] for i, j in enumerate(assigned(gain)) if i < len(left) and j < len(right)}


def aligned(labels: DataFrame) -> DataFrame:
    """labels (window, customer, label) with every window's labels renamed after the window before, from the first on.

    A label that no label of the window before matches gets a name that no earlier one has.
    """
    windows = sorted(r.window for r in labels.select("window").distinct().collect())
    before, out, names = None, None, set()
    for w in windows:
        now = labels.where(F.col("window") == w).select("window", "customer", F.col("label").cast("string").alias("label"))
        own = {r.label for r in now.select("label").distinct().collect()}
        if before is not None:
            renamed = matched(contingency(before, now))
            for label in sorted(own - set(renamed)):
                renamed[label] = next(x for x in (label, *(f"{label}{k}" for k in range(2, 1000))) if x not in names and x not in renamed.values())
            pairs = F.create_map(*[F.lit(x) for pair in renamed.items() for x in pair]) if renamed else None
            now = stored(now.withColumn("label", pairs[F.col("label")]) if renamed else now, "aligned")
            own = set(renamed.values())
        names |= own
        before, out = now, now if out is None else out.union(now)
    return labels if out is None else out


def cluster_windows(snapshots: DataFrame, k: int, algorithm: str = "kmeans", starts: int = 5) -> DataFrame:
    """(window, customer, label): each window clustered on its own, its clusters named after those of the window before."""
    windows = sorted(r.window for r in snapshots.select("window").distinct().collect())
    found = clustered_each({w: matrix(snapshots.where(F.col("window") == w)) for w in windows}, k, algorithm, starts=starts)
    each = None
    for w, one in found.items():
        one = stored(one.select(F.lit(w).alias("window"), "customer", F.col("cluster").cast("string").alias("label")), "window")
        each = one if each is None else each.union(one)
    return aligned(each)


def against(labels: DataFrame, bands: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row a label, a column a band (of the declared `names`): customers in both, with the largest band and its share.

    labels: customer, label; bands: customer, band.  Ties go to the first name.
    """
    both = labels.join(bands, "customer").groupBy("label").pivot("band", list(names)).count().na.fill(0, list(names))
    total = sum((F.col(f"`{n}`") for n in names), F.lit(0))
    most = F.greatest(*[F.col(f"`{n}`") for n in names]) if len(names) > 1 else F.col(f"`{names[0]}`")
    first = F.coalesce(*[F.when(F.col(f"`{n}`") == most, F.lit(n)) for n in names])
    return both.select("label", *[f"`{n}`" for n in names], first.alias("largest"), F.try_divide(most, total).alias("largest_share"))


def migration(table: DataFrame) -> DataFrame:
    """Flows with their share of the source, and whether they stay (equal labels)."""
    sums = table.groupBy("a").agg(F.sum("n").alias("_all"))
    return table.join(sums, "a").select("a", "b", "n", ratio(F.col("n"), F.col("_all")).alias("share_of_source"), (F.col("a") == F.col("b")).alias("stays"))


def flows(labels: DataFrame) -> DataFrame:
    """(window, a, b, n, share_of_source) of every two consecutive windows; window is "earlier-later"."""
    left = labels.select("customer", "window", F.col("label").alias("a"))
    right = labels.select("customer", (F.col("window") - 1).alias("window"), F.col("label").alias("b"))
    table = left.join(right, ["customer", "window"]).groupBy("window", "a", "b").agg(F.count("*").alias("n"))
    sums = table.groupBy("window", "a").agg(F.sum("n").alias("_all"))
    return table.join(sums, ["window", "a"]).select(F.concat_ws("-", F.col("window").cast("string"), (F.col("window") + 1).cast("string")).alias("window"), "a", "b", "n", ratio(F.col("n"), F.col("_all")).alias("share_of_source"))


def retention(table: DataFrame) -> DataFrame:
    return table.agg(ratio(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)), F.sum("n")).alias("retention"))


def verdict(ari: Column, retained: Column) -> Column:
    return F.when(ari >= 0.75, "stable").when(ari >= 0.40, "moderately stable").otherwise("unstable")


def profiles(rows: DataFrame) -> DataFrame:
    """By cluster: customers, medians, shares, and a name from the tercile of each median, with an ordinal by money where names collide."""
    total = rows.agg(F.count("*").alias("_n"), F.sum("monetary").alias("_m"))
    by = rows.groupBy("cluster").agg(F.count("*").alias("customers"), *[F.median(c).alias(f"median_{c}") for c in FEATURES], F.sum("monetary").alias("money")).join(F.broadcast(total))
    place = lambda c: F.percent_rank().over(Window.orderBy(f"median_{c}"))
    level = lambda c, low, mid, high: F.when(place(c) < 1 / 3, low).when(place(c) <= 2 / 3, mid).otherwise(high)
    name = F.concat_ws(", ", level("recency", "recent", "occasional", "lapsed"), level("frequency", "rare", "regular", "frequent"), level("monetary", "small", "middling", "large"))
    named = by.withColumn("name", name)
    same = Window.partitionBy("name")
    nth = F.row_number().over(same.orderBy(F.desc("median_monetary"), "cluster"))
    unique = F.when(F.count("*").over(same) > 1, F.concat(F.col("name"), F.lit(" "), nth.cast("string"))).otherwise(F.col("name"))
    return named.select("cluster", unique.alias("name"), "customers", *[f"median_{c}" for c in FEATURES], ratio(F.col("customers"), F.col("_n")).alias("customer_share"), ratio(F.col("money"), F.col("_m")).alias("money_share"))
