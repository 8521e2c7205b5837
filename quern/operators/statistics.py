"""Statistics and relationships: entropy, information, ranks, group tests, correlation, regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import special
from quern.operators.order import percentiles, running
from quern.operators.shape import ratio
from quern.sources.stage import stored


def moments(frame: DataFrame, value: str) -> DataFrame:
    """One row with population skewness and excess kurtosis, quartiles, mean over median."""
    x = F.col(value).cast("double")
    out = frame.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis")).join(F.broadcast(percentiles(frame, x, [0.25, 0.5, 0.75], "q")))
    return out.select(
        "n", "mean", "sd", "min", "max", F.element_at("q", 1).alias("q1"), F.element_at("q", 2).alias("median"), F.element_at("q", 3).alias("q3"),
        (F.element_at("q", 3) - F.element_at("q", 1)).alias("iqr"), "skewness", "kurtosis", ratio(F.col("mean"), F.element_at("q", 2)).alias("mean_over_median"))


def normality(skewness: Column, n: Column) -> Column:
    """A reading of the skewness, no test; fewer than 8 values give no verdict."""
    side = F.when(skewness > 0, "right").otherwise("left")
    return F.when(n < 8, "too few values").when(F.abs(skewness) < 0.5, "roughly symmetric").when(
        F.abs(skewness) < 1, F.concat(F.lit("moderately skewed to the "), side)).otherwise(F.concat(F.lit("strongly skewed to the "), side))


def _log2(x: Column) -> Column:
    return F.log2(x.cast("double"))


def entropy(frame: DataFrame, *columns: str) -> DataFrame:
    """One row: entropy in bits, categories, its maximum and the normalised value, of one column or several together; nulls are left out."""
    present = frame.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("c"))
    # H = log2 N - sum(c log2 c) / N, so one pass over the counts is enough
    sums = present.agg(F.sum("c").alias("n"), F.sum(F.col("c") * _log2(F.col("c"))).alias("s"), F.count("*").alias("categories"))
    h = F.greatest(F.lit(0.0), _log2(F.col("n")) - F.col("s") / F.col("n"))
    top = F.when(F.col("categories") > 1, _log2(F.col("categories"))).otherwise(0.0)
    return sums.select(h.alias("entropy"), "categories", top.alias("max_entropy"), F.when(top > 0, h / top).otherwise(0.0).alias("normalised"))


def information(frame: DataFrame, left: str, right: str) -> DataFrame:
    """One row over complete pairs: joint, marginal and conditional entropies, mutual information, symmetric uncertainty."""
    pairs = frame.dropna(subset=[left, right])
    parts = [entropy(pairs, left, right).select(F.col("entropy").alias("joint")), entropy(pairs, left).select(F.col("entropy").alias("h_left")), entropy(pairs, right).select(F.col("entropy").alias("h_right"))]
    mutual = F.greatest(F.lit(0.0), F.col("h_left") + F.col("h_right") - F.col("joint"))
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2])).select(
        "joint", "h_left", "h_right", (F.col("joint") - F.col("h_right")).alias("left_given_right"), mutual.alias("mutual_information"),
        F.when(F.col("h_left") + F.col("h_right") > 0, 2 * mutual / (F.col("h_left") + F.col("h_right"))).otherwise(0.0).alias("symmetric_uncertainty"))


def quantile_bins(frame: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """frame with a bin by quantile edges: equal edges are one, bins are closed on the right."""
    edges = percentiles(frame, value, [k / bins for k in range(bins + 1)], "_e").select(F.array_distinct("_e").alias("_edges"))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    place = F.size(F.filter(inner, lambda e: e < F.col(value)))
    return frame.join(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), place).cast("long")).drop("_edges")


def average_ranks(frame: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """frame with average ranks: counts of distinct values are summed in order by ranges, so ties and rows do not sort in one task."""
    counts = frame.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranks = running(counts, ["_v"], "_c", "_t").select("_v", (F.col("_t") - (F.col("_c") - 1) / 2).alias(name))
    return frame.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def correlation(frame: DataFrame, left: str, right: str) -> DataFrame:
    """One row: pairs, Pearson and Spearman over complete, finite pairs; null where one side does not vary."""
    x, y = F.col(left).cast("double"), F.col(right).cast("double")
    pairs = frame.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    ranked = average_ranks(average_ranks(pairs, "x", "rx"), "y", "ry")
    alike = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return ranked.agg(F.count("*").alias("n"), alike("x", "y").alias("pearson"), alike("rx", "ry").alias("spearman"))


def correlation_with_p(frame: DataFrame, left: str, right: str) -> dict[str, float]:
    """The same on the driver, with two-sided p-values; fewer than 10 pairs give none."""
    row = correlation(frame, left, right).first()
    if row.n < 10 or row.pearson is None:
        return {"n": row.n}
    return {
        "n": row.n, "pearson": row.pearson, "pearson_p": special.correlation_p(row.pearson, row.n),
        "spearman": row.spearman, "spearman_p": special.correlation_p(row.spearman, row.n),
    }


def correlation_matrix(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left, right, pearson, spearman) of each pair of columns, over the rows complete for that pair."""
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            row = correlation(frame, a, b).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "n", "pearson", "spearman")
            out = row if out is None else out.union(row)
    return out


def group_ranks(frame: DataFrame, label: str, value: str, least: int = 5) -> DataFrame:
    """By group of at least `least` rows: rows, rank sum and the tie term of all ranks."""
    sizes = frame.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label)
    rows = frame.join(sizes, label, "left_semi")
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranks = running(counts, ["_v"], "_c", "_t").select("_v", "_c", (F.col("_t") - (F.col("_c") - 1) / 2).alias("_r"))
    ties = ranks.agg(F.sum(F.pow("_c", F.lit(3)) - F.col("_c")).alias("ties"))
    return rows.groupBy(label, F.col(value).alias("_v")).agg(F.count("*").alias("_k")).join(ranks, "_v").groupBy(label).agg(
        F.sum("_k").alias("n"), F.sum(F.col("_k") * F.col("_r")).alias("rank_sum")).join(F.broadcast(ties))


def kruskal(frame: DataFrame, label: str, value: str) -> DataFrame:
    """One row: groups, rows, H with tie correction, and epsilon squared."""
    ranks = group_ranks(frame, label, value)
    total = ranks.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum(F.pow("rank_sum", F.lit(2)) / F.col("n")).alias("s"), F.first("ties").alias("ties"))
    n = F.col("rows").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (F.pow(n, 3) - n))
    return total.select("groups", "rows", h.alias("h"), F.greatest(F.lit(0.0), F.try_divide(h - F.col("groups") + 1, n - F.col("groups"))).alias("epsilon_squared"))


def mann_whitney(frame: DataFrame, label: str, value: str) -> DataFrame:
    """One row for two groups, in order of label: U of the first, rank-biserial, and z with continuity correction."""
    both = F.sort_array(F.collect_list(F.struct(label, "n", "rank_sum")))
    got = group_ranks(frame, label, value).groupBy("ties").agg(both.alias("g")).where("size(g) = 2")
    n1, n2 = F.element_at("g", 1)["n"].cast("double"), F.element_at("g", 2)["n"].cast("double")
    u = F.element_at("g", 1)["rank_sum"] - n1 * (n1 + 1) / 2
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return got.select(
        F.element_at("g", 1)[label].alias("first"), F.element_at("g", 2)[label].alias("second"), n1.cast("long").alias("n_first"), n2.cast("long").alias("n_second"),
        u.alias("u"), (2 * u / (n1 * n2) - 1).alias("rank_biserial"), F.try_divide(F.abs(u - n1 * n2 / 2) - 0.5, sd).alias("z"))


def compare_groups(frame: DataFrame, label: str, value: str) -> dict[str, float | str]:
    """Mann-Whitney for two groups, Kruskal-Wallis for more, with p-values on the driver."""
    h = kruskal(frame, label, value).first()
    if h is None or not h.groups or h.groups < 2:
        return {"test": "none", "groups": h.groups if h else 0}
    if h.groups == 2:
        row = mann_whitney(frame, label, value).first()
        return {"test": "mann-whitney", "u": row.u, "p": min(1.0, 2 * special.normal_tail(row.z)), "effect": row.rank_biserial, "size": magnitude(abs(row.rank_biserial), 0.1, 0.3, 0.5)}
    return {"test": "kruskal-wallis", "h": h.h, "p": special.chi2_tail(h.h, h.groups - 1), "effect": h.epsilon_squared, "size": magnitude(h.epsilon_squared, 0.01, 0.06, 0.14)}


def magnitude(value: float, small: float, medium: float, large: float) -> str:
    return "negligible" if value < small else "small" if value < medium else "medium" if value < large else "large"


def elasticity(product_periods: DataFrame) -> DataFrame:
    """One row: least squares of ln units on ln price over positive pairs."""
    rows = product_periods.where("units > 0 and avg_unit_price > 0").select(F.ln("units").alias("y"), F.ln("avg_unit_price").alias("x"))
    fit = rows.agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    return fit.select("n", "slope", "intercept", "r2", F.sqrt(F.try_divide(F.try_divide(F.col("syy") * (1 - F.col("r2")), F.col("n") - 2), F.col("sxx"))).alias("stderr"))


def discount_bands(product_periods: DataFrame) -> DataFrame:
    """Units by band of price over the product's own median price."""
    usual = product_periods.where("avg_unit_price > 0").groupBy("product_code").agg(F.median("avg_unit_price").alias("usual"))
    rows = product_periods.where("avg_unit_price > 0").join(usual, "product_code").withColumn("ratio", F.col("avg_unit_price") / F.col("usual"))
    band = F.when(F.col("ratio") < 0.8, "deep discount").when(F.col("ratio") < 0.95, "discount").when(F.col("ratio") < 1.05, "usual").when(F.col("ratio") < 1.2, "above").otherwise("far above")
    overall = rows.agg(F.median("units").alias("all_units"))
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.median("units").alias("median_units"), F.avg("units").alias("mean_units")).join(F.broadcast(overall)).select(
        "band", "n", "median_units", "mean_units", ratio(F.col("median_units"), F.col("all_units")).alias("ratio_to_all"))


def feature_table(weekly: DataFrame, key: str = "product_code", period: str = "period", target: str = "units") -> DataFrame:
    """Lags 1, 2, 4, 8 and rolling means and deviations of past values over 4 and 12 observed rows, with calendar columns."""
    order = Window.partitionBy(key).orderBy(period)
    out = weekly
    for n in (1, 2, 4, 8):
        out = out.withColumn(f"lag_{n}", F.lag(target, n).over(order))
    for n in (4, 12):
        past = order.rowsBetween(-n, -1)
        enough = F.count(target).over(past) >= 2
        out = out.withColumn(f"mean_{n}", F.when(enough, F.avg(target).over(past))).withColumn(f"sd_{n}", F.when(enough, F.stddev_samp(target).over(past)))
    day = F.col(period).cast("date")
    christmas = F.make_date(F.year(day), F.lit(12), F.lit(25))
    next_one = F.when(day > christmas, F.make_date(F.year(day) + 1, F.lit(12), F.lit(25))).otherwise(christmas)
    return out.withColumn("week", F.weekofyear(day).cast("long")).withColumn("month", F.month(day).cast("long")).withColumn(
        "weeks_to_christmas", F.floor(F.datediff(next_one, day) / 7).cast("long")).withColumn(
        "age_weeks", F.floor(F.datediff(day, F.min(day).over(Window.partitionBy(key))) / 7).cast("long"))


def feature_scores(features: DataFrame, columns: Sequence[str], target: str = "units", bins: int = 5) -> DataFrame:
    """(feature, mutual_information, rank): binned mutual information of each feature with the target over complete rows."""
    rows = stored(quantile_bins(features.dropna(subset=[target, *columns]), target, bins, "_t").select("_t", *columns), "features")
    out = None
    for name in columns:
        got = information(quantile_bins(rows, name, bins, "_f"), "_f", "_t").select(F.lit(name).alias("feature"), "mutual_information")
        out = got if out is None else out.union(got)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mutual_information"), "feature")).cast("long"))
