"""Readings of other operators' results, and checks between data sets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import rules, shape
from quern.operators.order import numbered
from quern.operators.shape import ratio
from quern.operators.statistics import correlation
from quern.sources.stage import stored


#: Tasks that compare a sample's points with each other.
PARTS = 16


def params_hash(params: Mapping) -> str:
    """SHA-256 of the canonical form of a request's parameters: the key under which a result can be kept."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value that at least a share p of the rows does not exceed."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def histogram_shape(bins: DataFrame) -> DataFrame:
    """Empty bins between filled ones, rows, and the largest bin's share of a histogram."""
    filled = bins.where(F.col("rows") > 0).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    return bins.join(F.broadcast(filled)).agg(
        F.count_if((F.col("rows") == 0) & F.col("bin").between(F.col("lo"), F.col("hi"))).alias("interior_gaps"), F.sum("rows").alias("rows"),
        ratio(F.max("rows"), F.sum("rows")).alias("dominant_share"))


def dominant(frame: DataFrame, column: str) -> DataFrame:
    """The most frequent value (ties: the smallest) and its share."""
    counts = frame.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("_o")).alias("o"), F.col("value")))
    ordered = counts.withColumn("_o", F.row_number().over(Window.orderBy("value")))
    return ordered.agg(best.alias("b"), F.sum("n").alias("all")).select(F.col("b.value").alias("value"), ratio(F.col("b.n"), F.col("all")).alias("share"))


def rank_correlation(frame: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) of the places by two columns; null under three rows."""
    place = lambda c: F.row_number().over(Window.orderBy(c, key))
    rows = frame.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(F.pow(place(first) - place(second), F.lit(2)).alias("d2"))
    n = F.count("*")
    return rows.agg(n.alias("n"), F.when(n >= 3, 1 - F.try_divide(6 * F.sum("d2"), n * (n * n - 1))).alias("rank_correlation"))


def rank_disagreements(frame: DataFrame, first: str, second: str, key: str, least: int = 2) -> DataFrame:
    """Rows whose places by two columns differ by at least `least`."""
    place = lambda c: F.row_number().over(Window.orderBy(F.desc(c), key)).cast("long")
    return frame.select(key, place(first).alias("place_first"), place(second).alias("place_second")).where(F.abs(F.col("place_first") - F.col("place_second")) >= least)


def outside_training(training: DataFrame, future: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share of future values outside the training range)."""
    spans = training.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    shares = future.join(F.broadcast(spans)).agg(*[F.avg((~F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))).cast("int")).alias(c) for c in columns])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("outside")) for c in columns])).alias("x")).select("x.*")


def correlated_pairs(matrix: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs of a correlation matrix at or above the threshold."""
    return matrix.where(F.abs("pearson") >= threshold).select("left", "right", "pearson")


def permutation_importance(rows: DataFrame, features: Sequence[str], predict, target: str = "target", seed: int = 11, repeats: int = 10) -> DataFrame:
    """(feature, rise of the mean absolute error when its values are dealt anew, mean and deviation over the repeats).

    Values are dealt by joining each row with the value at the same place of another seeded order:
    no task sees a whole column.  predict takes rows and adds a column prediction.
    """
    base = stored(rows.withColumn("_id", F.xxhash64(F.lit(seed), *rows.columns)).withColumn("_h", F.pmod("_id", F.lit(1 << 20))), "importance")
    error = F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("e")
    before = predict(base).agg(error).first().e
    base = base.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    out = []
    for k, name in enumerate(features):
        place = F.row_number().over(Window.partitionBy("_r", F.pmod("_id", F.lit(256))).orderBy("_id", *features))
        dealt = F.row_number().over(Window.partitionBy("_r", F.pmod("_id", F.lit(256))).orderBy(F.xxhash64(F.lit(seed + k), "_r", "_id", *features)))
        left = base.withColumn("_part", F.pmod("_id", F.lit(256))).withColumn("_n", place)
        right = base.select(F.col("_r").alias("_q"), F.pmod("_id", F.lit(256)).alias("_p"), dealt.alias("_m"), F.col(name).alias("_new"))
        shuffled = left.join(right, (F.col("_r") == F.col("_q")) & (F.col("_part") == F.col("_p")) & (F.col("_n") == F.col("_m"))).withColumn(name, F.col("_new"))
        errors = predict(shuffled).groupBy("_r").agg(error).agg(F.avg("e").alias("e"), F.coalesce(F.stddev_pop("e"), F.lit(0.0)).alias("sd")).first()
        out.append((name, float(errors.e - before), float(errors.sd)))
    return rows.sparkSession.createDataFrame(out, "feature string, rise double, rise_sd double")


def rank_agreement(scores: DataFrame, k: int = 5) -> DataFrame:
    """One row from (feature, first, second): rank correlation over the features that both score, and how many of the k best they share."""
    both = stored(scores.where("first is not null and second is not null"), "agreement")
    best = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "feature")) <= k  # noqa: E731  features are few
    marked = both.select("first", "second", best("first").alias("a"), best("second").alias("b"))
    rho = correlation(both, "first", "second")
    return rho.select("n", F.when(F.col("n") >= 3, F.col("spearman")).alias("spearman")).join(F.broadcast(marked.agg(F.count_if(F.col("a") & F.col("b")).alias("shared_best"))))


def lift_inflation(found: DataFrame) -> DataFrame:
    """Rules with the share of baskets that hold neither side, which lift rewards and normalised lift does not."""
    neither = 1 - (F.col("n_antecedent") + F.col("n_consequent") - F.col("both")) / F.col("baskets")
    return found.select("antecedent", "consequent", "lift", "normalised_lift", neither.alias("neither_share"))


def exposure(found: DataFrame) -> DataFrame:
    """How rules spread over the items they recommend: items, Gini of their counts and the share of the top tenth (one item at least); without rules 0 items and nulls."""
    counts = stored(found.groupBy(F.col("consequent").alias("item")).agg(F.count("*").cast("double").alias("k")), "exposure")
    every = counts.agg(F.count("*").alias("items"), F.sum("k").alias("all"))
    placed = numbered(counts, [F.desc("k"), "item"], "rn").join(F.broadcast(every))
    top = placed.where(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("items") / 10))).agg(F.sum("k").alias("top"))
    return shape.gini(counts, "k").join(F.broadcast(every)).join(F.broadcast(top)).select("gini", "items", ratio(F.col("top"), F.col("all")).alias("top_tenth_share"))


def singleton_policies(items: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules with and without baskets of one item, and how many gain support from the smaller number of baskets alone."""
    sizes = items.groupBy("invoice_id").agg(F.count("*").alias("n")).where("n > 1").select("invoice_id")
    both = [rules.generate(rules.itemsets(x, min_support, 2), min_confidence, 0.0).select("antecedent", "consequent", "both", "support") for x in (items, items.join(sizes, "invoice_id", "left_semi"))]
    left, right = both[0], both[1].withColumnRenamed("both", "both_2").withColumnRenamed("support", "support_2")
    return left.join(right, ["antecedent", "consequent"], "full").agg(
        F.count("both").alias("rules_with_singletons"), F.count("both_2").alias("rules_without"),
        F.count_if((F.col("both") == F.col("both_2")) & (F.col("support_2") > F.col("support"))).alias("inflated"))


def lost_invoices(judged: DataFrame) -> DataFrame:
    """(reason, invoices): invoices of which no line was kept, by each reason that took their lines."""
    kept = judged.where("reason is null").select("invoice_id").distinct()
    return judged.where("reason is not null and invoice_id is not null").join(kept, "invoice_id", "left_anti").groupBy("reason").agg(F.count_distinct("invoice_id").alias("invoices"))


def silhouette(points: DataFrame, features: Sequence[str], sample: int = 10_000) -> DataFrame:
    """Mean silhouette (Euclidean) of at most `sample` points, picked by a hash, against each other.

    A sampling operator: all pairs of a bounded sample, in one broadcast join of that many rows.
    """
    names = [f"x_{c}" for c in features]
    some = stored(points.select("cluster", *names).withColumn("_h", F.xxhash64(*names, "cluster")).orderBy("_h").limit(sample).withColumn("_id", F.monotonically_increasing_id()), "sample")
    other = some.select(F.col("_id").alias("_o"), F.col("cluster").alias("_c"), *[F.col(x).alias(f"o_{x}") for x in names])
    far = F.sqrt(sum((F.pow(F.col(x) - F.col(f"o_{x}"), 2) for x in names), F.lit(0.0)))
    dealt = some.repartition(PARTS, "_id")  # the sample lies in one file
    by = dealt.join(F.broadcast(other), F.col("_id") != F.col("_o")).groupBy("_id", "cluster", "_c").agg(F.avg(far).alias("d"))
    each = by.groupBy("_id").agg(F.min(F.when(F.col("cluster") == F.col("_c"), F.col("d"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("_c"), F.col("d"))).alias("b"))
    return each.agg(F.count("*").alias("points"), F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def rendered(recommendations: DataFrame) -> DataFrame:
    """Recommendations as lines of text, in order."""
    caveat = F.when(F.size("caveats") > 0, F.concat(F.lit(" ("), F.array_join("caveats", "; "), F.lit(")"))).otherwise("")
    return recommendations.select("place", F.concat(F.col("place").cast("string"), F.lit(". "), F.col("action"), caveat).alias("line"))
