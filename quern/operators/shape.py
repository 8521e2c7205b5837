"""Shaping of aggregated results: ratios, gaps, partial periods, rankings, inequality, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.order import numbered, percentiles, running
from quern.sources.stage import stored

#: Interval of each granularity.
STEP = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null for a null or zero denominator and for results that are not finite."""
    out = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)


def growth(current: Column, previous: Column) -> Column:
    return ratio(current - previous, F.abs(previous))


def kpis(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One row from two rows of totals: values, ratios, and growth where the periods are comparable (a column of previous)."""
    old = previous.select(*[F.col(c).alias(f"previous_{c}") if c != "comparable" else F.col(c) for c in previous.columns])
    both = current.join(F.broadcast(old))
    grown = [
        F.when(F.col("comparable"), growth(F.col(c), F.col(f"previous_{c}"))).alias(f"{c}_growth")
        for c in ("gross_revenue", "net_revenue", "orders", "units", "active_customers")
    ]
    return both.select(
        "*", ratio(F.col("gross_revenue"), F.col("orders")).alias("average_order_value"),
        ratio(F.col("returns_value"), F.col("gross_revenue")).alias("return_rate"),
        ratio(F.col("guest_revenue"), F.col("gross_revenue")).alias("guest_share"), *grown,
    )


def calendar(frame: DataFrame, granularity: str, column: str = "period", keys: Sequence[str] = ()) -> DataFrame:
    """Every period from the first to the last of frame, or of each group of keys."""
    span = frame.groupBy(*keys).agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo is not null")
    return span.select(*keys, F.explode(F.expr(f"sequence(lo, hi, {STEP[granularity]})")).alias(column))


def fill_gaps(frame: DataFrame, granularity: str, values: Sequence[str], column: str = "period", keys: Sequence[str] = ()) -> DataFrame:
    """frame on its whole calendar, each group of keys (none of them null) on its own; missing values are 0 and `filled` marks them."""
    marked = frame.withColumn("filled", F.lit(False))
    return calendar(frame, granularity, column, keys).join(marked, [*keys, column], "left").select(
        *keys, column, *[F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values], F.coalesce("filled", F.lit(True)).alias("filled"))


def period_end(start: Column, granularity: str) -> Column:
    """First instant after the period."""
    return start + F.expr(STEP[granularity])


def drop_incomplete(frame: DataFrame, granularity: str, last_day: Column, column: str = "period") -> DataFrame:
    """Without periods whose last day is after last_day."""
    return frame.where(F.date_sub(period_end(F.col(column), granularity).cast("date"), 1) <= last_day)


def trend_points(trend: DataFrame, granularity: str, data_end: DataFrame, window: int = 4, value: str = "net_revenue") -> DataFrame:
    """Gap-filled trend with is_partial, moving average over `window` complete periods, growth over the previous complete one.

    data_end has one row with the last instant of the data.  Windows run over the aggregated
    periods, a few thousand rows at most, whatever the number of sale lines.
    """
    columns = ("gross_revenue", "net_revenue", "returns_value", "units", "orders", "active_customers")
    full = fill_gaps(stored(trend, "trend"), granularity, columns).join(F.broadcast(data_end.select(F.max("occurred_at").alias("data_max"))))
    last_instant = period_end(F.col("period"), granularity).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")
    marked = full.withColumn("is_partial", last_instant > F.col("data_max"))
    order = Window.orderBy("period")
    frame = order.rowsBetween(-(window - 1), 0)
    whole = F.when(~F.col("is_partial"), F.col(value))
    before, before_partial = F.lag(value).over(order), F.lag("is_partial").over(order)
    return marked.select(
        "period", *columns, "filled", "is_partial",
        F.when(F.count(whole).over(frame) == window, F.avg(whole).over(frame)).alias("moving_average"),
        F.when(~F.col("is_partial") & ~before_partial, growth(F.col(value), before)).alias("growth"),
    )


def gini(frame: DataFrame, value: str) -> DataFrame:
    """One row (gini): values of at least 0; one value gives 0, none or a sum of 0 null.

    Equal values share their ranks' sum; counts of values are summed in order by ranges.
    """
    counts = frame.where(F.col(value) >= 0).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    through = F.col("through")
    ranked = running(counts, ["x"], "n", "through").withColumn("ranks", F.col("n") * (2 * through - F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("ranks") * F.col("x")).alias("s"), F.sum(F.col("n") * F.col("x")).alias("t"), F.sum("n").alias("n"))
    return sums.select(F.when(F.col("t") > 0, 2 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def concentration(frame: DataFrame, key: str, value: str, top: float = 0.2) -> DataFrame:
    """Share of the top fraction of entities in the sum of positive values."""
    positive = frame.where(F.col(value) > 0).select(key, F.col(value).cast("double").alias("x"))
    ranked = numbered(positive, [F.desc("x"), key], "rn")
    size = ranked.agg(F.count("*").alias("entities"), F.sum("x").alias("total"))
    both = ranked.join(F.broadcast(size)).withColumn("top_entities", F.greatest(F.lit(1), F.ceil(F.col("entities") * F.lit(top))).cast("long"))
    return both.groupBy("entities", "top_entities", "total").agg(F.sum(F.when(F.col("rn") <= F.col("top_entities"), F.col("x"))).alias("top")).select(
        "entities", "top_entities", ratio(F.col("top"), F.col("total")).alias("top_share"))


def rank(frame: DataFrame, key: str, by: str = "gross_revenue", limit: int = 20, descending: bool = True) -> DataFrame:
    """The first `limit` entities by a measure, with shares of the whole, and one row `others` (place limit + 1) for the rest.

    A plain top-k of the entities; the rest needs only sums, so nothing is sorted as a whole.
    """
    way = F.desc(by) if descending else F.asc(by)
    best = frame.orderBy(way, key).limit(limit)
    total = frame.agg(F.sum(by).alias("total"), F.count("*").alias("entities"))
    place = F.row_number().over(Window.orderBy(way, key))
    running = F.sum(by).over(Window.orderBy(way, key).rowsBetween(Window.unboundedPreceding, 0))
    ranked = best.select(F.col(key).cast("string").alias("key"), F.col(by).cast("double").alias("value"), place.cast("long").alias("place"), running.cast("double").alias("running"))
    shown = ranked.join(F.broadcast(total)).select(
        "place", "key", "value", ratio(F.col("value"), F.col("total")).alias("share"),
        (ratio(F.col("running"), F.col("total")) if descending else F.lit(None).cast("double")).alias("cumulative_share"))
    rest = ranked.agg(F.sum("value").alias("top"), F.count("*").alias("k")).join(F.broadcast(total)).where("entities > k").select(
        F.lit(limit + 1).cast("long").alias("place"), F.lit("others").alias("key"), (F.col("total") - F.col("top")).cast("double").alias("value"),
        ratio(F.col("total") - F.col("top"), F.col("total")).alias("share"), F.lit(None).cast("double").alias("cumulative_share"))
    return shown.union(rest)


def histogram(frame: DataFrame, value: str, bins: int = 20, log: bool = False) -> DataFrame:
    """bin, lower, upper, rows for equal bins from min to max (of logarithms if log, then positive values only).

    The last bin is closed, empty bins have 0 rows, equal values make one bin.
    """
    x = F.col(value).cast("double")
    usable = frame.where(x.isNotNull() & ~F.isnan(x) & ((x > 0) if log else F.lit(True))).select((F.log10(x) if log else x).alias("x"))
    span = usable.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo is not null").withColumn("k", F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins))
    place = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    counted = usable.join(F.broadcast(span)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("rows"))
    grid = span.select("lo", "hi", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)).alias("bin"))
    edge = lambda k: F.col("lo") + k * (F.col("hi") - F.col("lo")) / F.col("k")
    lower, upper = edge(F.col("bin")), edge(F.col("bin") + 1)
    return grid.join(counted, "bin", "left").select(
        "bin", (F.pow(F.lit(10.0), lower) if log else lower).alias("lower"), (F.pow(F.lit(10.0), upper) if log else upper).alias("upper"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def describe(frame: DataFrame, value: str) -> DataFrame:
    """One row: count, moments, quartiles, and outlier counts by fences and by robust z above 3.5.

    Skewness and kurtosis divide by the sample deviation (n - 1); the other two definitions are
    in quern.operators.statistics.
    """
    x = stored(frame.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)"), "values")
    first = x.agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.sum("x").alias("sum")).join(F.broadcast(percentiles(x, "x", PERCENTILES)))
    both = x.join(F.broadcast(first))
    mad = percentiles(both.select(F.abs(F.col("x") - F.element_at("p", 5)).alias("d")), "d", [0.5], "m").select(F.element_at("m", 1).alias("mad"))
    z = (F.col("x") - F.col("mean")) / F.col("sd")
    fence = 1.5 * (F.element_at("p", 6) - F.element_at("p", 4))
    second = both.agg(
        F.avg(F.pow(z, 3)).alias("skewness"), F.avg(F.pow(z, 4)).alias("k4"),
        F.count_if((F.col("x") < F.element_at("p", 4) - fence) | (F.col("x") > F.element_at("p", 6) + fence)).alias("outside_fences"))
    third = both.join(F.broadcast(mad)).agg(
        F.count_if((F.col("mad") > 0) & (0.6745 * F.abs(F.col("x") - F.element_at("p", 5)) / F.col("mad") > 3.5)).alias("robust_outliers"))
    return first.join(F.broadcast(second)).join(F.broadcast(third)).select(
        "n", "mean", "sd", ratio(F.col("sd"), F.col("mean")).alias("cv"), "min", "max", "sum",
        *[F.element_at("p", k + 1).alias(f"p{round(100 * p):02d}") for k, p in enumerate(PERCENTILES)],
        (F.element_at("p", 6) - F.element_at("p", 4)).alias("iqr"), "skewness", (F.col("k4") - 3).alias("kurtosis"), "outside_fences", "robust_outliers")
