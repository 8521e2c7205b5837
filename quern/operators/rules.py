"""Baskets, frequent itemsets, association rules, their tests, pruning, validation and use."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import special
from quern.operators.bitmaps import bitmaps, counted, itemsets  # noqa: F401  (the search that rules start from)
from quern.operators.layout import affinity_zones, picking_effort, popularity_zones  # noqa: F401  (the use that rules are put to)
from quern.operators.order import numbered
from quern.operators.shape import gini, ratio
from quern.operators.statistics import correlation
from quern.sources.stage import stored


def basket_items(lines: DataFrame, item: str, floor: int = 1) -> DataFrame:
    """(invoice_id, item, at), distinct, without returns; invoices of fewer than `floor` items are left out."""
    rows = lines.where(f"invoice_id is not null and {item} is not null and not is_return").groupBy("invoice_id", F.col(item).alias("item")).agg(F.min("occurred_at").alias("at"))
    if floor <= 1:
        return rows
    sizes = rows.groupBy("invoice_id").agg(F.count("*").alias("n")).where(F.col("n") >= floor).select("invoice_id")
    return rows.join(sizes, "invoice_id", "left_semi")


def split_by_date(items: DataFrame, holdout: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Baskets before, and from, the date at the (1 - holdout) position of all baskets in order of date.

    Items are stored with their basket's date, so that either side is a filter, not a join.
    """
    basket = Window.partitionBy("invoice_id")
    dated = stored(items.withColumn("_first", F.min("at").over(basket)).withColumn("_head", F.row_number().over(basket.orderBy("item")) == 1), "items")
    days = dated.where("_head").groupBy("_first").agg(F.count("*").alias("n"))
    through = days.select("_first", F.sum("n").over(Window.orderBy("_first")).alias("through"))
    cut = stored(through.join(F.broadcast(days.agg(F.sum("n").alias("all")))).where(F.col("through") > F.floor(F.col("all") * F.lit(1 - holdout))).agg(F.min("_first").alias("cut")), "cut")
    marked = dated.join(F.broadcast(cut))
    return marked.where("_first < cut").select(*items.columns), marked.where("_first >= cut").select(*items.columns)


def top_itemsets(sets: DataFrame, n: int = 20, length: int | None = None) -> DataFrame:
    chosen = sets if length is None else sets.where(F.col("length") == length)
    return chosen.orderBy(F.desc("freq"), "items").limit(n)


def dependence(both: Column, left: Column, right: Column, n: Column) -> dict[str, Column]:
    """Measures of a rule from counts of baskets."""
    support, p_left, p_right = both / n, left / n, right / n
    confidence, lift = both / left, both * n / (left * right)
    bottom = F.greatest(confidence * (1 - p_right), p_right * (1 - confidence))
    most = F.least(F.lit(1.0) / p_left, F.lit(1.0) / p_right)
    least = F.greatest(F.lit(0.0), (p_left + p_right - 1) / (p_left * p_right))
    return {
        "support": support, "confidence": confidence, "lift": lift, "leverage": support - p_left * p_right,
        "conviction": F.when(confidence < 1, (1 - p_right) / (1 - confidence)), "zhang": F.coalesce(F.try_divide(confidence - p_right, bottom), F.lit(0.0)),
        "all_confidence": both / F.greatest(left, right), "cosine": both / F.sqrt(left * right),
        "normalised_lift": F.coalesce(F.try_divide(lift - least, most - least), F.lit(0.0)), "cross_support": F.least(left, right) / F.greatest(left, right),
    }


def generate(sets: DataFrame, min_confidence: float = 0.2, min_lift: float = 1.0, min_cross: float = 0.0) -> DataFrame:
    """Rules with one consequent: every split of each set of two items or more, joined with the counts of its parts."""
    split = sets.where("length >= 2").select("items", F.col("freq").alias("both"), "baskets", F.explode("items").alias("consequent")).withColumn(
        "antecedent", F.array_except("items", F.array("consequent")))
    left = sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("n_antecedent"))
    right = sets.where("length = 1").select(F.element_at("items", 1).alias("consequent"), F.col("freq").alias("n_consequent"))
    rows = split.join(left, "antecedent").join(right, "consequent")
    got = dependence(*[F.col(c).cast("double") for c in ("both", "n_antecedent", "n_consequent", "baskets")])
    rows = rows.select("antecedent", "consequent", "both", "n_antecedent", "n_consequent", "baskets", *[c.alias(k) for k, c in got.items()])
    return rows.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift) & (F.col("cross_support") >= min_cross))


def benjamini_hochberg(frame: DataFrame, p: str = "p_value", name: str = "q_value", tie: str = "antecedent") -> DataFrame:
    """Step-up adjusted p-values, over the rules that were found (bounded by their candidates)."""
    ordered = frame.withColumn("_rn", F.row_number().over(Window.orderBy(p, tie, "consequent"))).join(F.broadcast(frame.agg(F.count("*").alias("_m"))))
    down = Window.orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rn")).over(down))).drop("_rn", "_m")


def fisher_p(both: pd.Series, left: pd.Series, right: pd.Series, n: pd.Series) -> pd.Series:
    """One-sided exact test of each rule's counts."""
    return pd.Series([special.fisher_greater(int(b), int(x), int(y), int(t)) for b, x, y, t in zip(both, left, right, n, strict=True)])


def tested(rules: DataFrame, alpha: float = 0.05) -> DataFrame:
    fisher = F.pandas_udf(fisher_p, "double")
    rows = rules.withColumn("p_value", fisher("both", "n_antecedent", "n_consequent", "baskets"))
    return benjamini_hochberg(rows).withColumn("significant", F.col("q_value") <= alpha).withColumn("is_association", (F.col("lift") > 1) & F.col("significant"))


def drop_trivial(rules: DataFrame, most: float = 0.5) -> DataFrame:
    return rules.where(F.col("n_consequent") / F.col("baskets") <= most)


def drop_redundant(rules: DataFrame, tolerance: float = 0.0, longest: int = 3) -> DataFrame:
    """Without rules that a kept rule dominates: same consequent, part of the antecedent, no less confidence.

    Only shorter antecedents can dominate, so one round for each length is enough.
    """
    rules = stored(rules, "rules")
    kept = rules.where("size(antecedent) = 1")
    for length in range(2, longest):
        now = rules.where(F.size("antecedent") == length)
        small = kept.select(F.col("antecedent").alias("_a"), F.col("consequent").alias("_c"), F.col("confidence").alias("_conf"))
        over = (F.col("consequent") == F.col("_c")) & (F.size(F.array_intersect("antecedent", "_a")) == F.size("_a")) & (F.col("_conf") >= F.col("confidence") - tolerance)
        kept = kept.union(now.join(small, over, "left_anti"))
    return kept


def measure_on(rules: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of each rule on other baskets: both sides and the whole by the bitmaps of the rules' items.

    Only those items of the baskets are shuffled, once, whatever the number of rules.
    """
    rows = items.where("invoice_id is not null and item is not null").select("invoice_id", "item")
    n = rows.select("invoice_id").distinct().count()
    whole = F.array_append("antecedent", F.col("consequent"))
    names = stored(numbered(rules.select(F.explode(whole).alias("item")).distinct(), ["item"], "no"), "names")
    blocks = stored(bitmaps(rows.join(names, "item").select("invoice_id", "no"), n), "bitmaps")
    parts = {"held_both": whole, "held_antecedent": F.col("antecedent"), "held_consequent": F.array("consequent")}
    each = rules.select("antecedent", "consequent", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), c.alias("items")) for k, c in parts.items()])).alias("_x")).select("antecedent", "consequent", "_x.*")
    placed = each.withColumn("item", F.explode("items")).join(names, "item").groupBy("antecedent", "consequent", "part").agg(F.array_sort(F.collect_list("no")).alias("nos"))
    wanted = stored(placed, "wanted")
    counts = [counted(blocks, wanted.where(F.size("nos") == r.k).select("nos").distinct(), r.k) for r in wanted.select(F.size("nos").alias("k")).distinct().collect()]  # a handful of lengths
    found = wanted.join(reduce(DataFrame.union, counts), "nos", "left") if counts else wanted.withColumn("freq", F.lit(0).cast("long"))
    return found.groupBy("antecedent", "consequent").agg(*[F.coalesce(F.max(F.when(F.col("part") == k, F.col("freq"))), F.lit(0).cast("long")).alias(k) for k in parts]).withColumn("held_baskets", F.lit(n).cast("long"))


def validate(rules: DataFrame, items: DataFrame, min_lift: float = 1.0, least: int = 5, alpha: float = 0.05) -> DataFrame:
    """Each rule on held-out baskets: held_lift, whether it is judged, its held_q, and whether it survives.

    Rules are judged if both sides occur there and the antecedent does `least` times.  Surviving
    takes a lift over `min_lift` and significance: independent items have a lift over 1 half of the
    time, so a one-sided exact test decides, corrected over all judged rules.
    """
    rules = stored(rules, "rules")
    held = measure_on(rules, items)
    lift = F.try_divide(F.col("held_both") * F.col("held_baskets"), F.col("held_antecedent").cast("double") * F.col("held_consequent"))
    rows = stored(rules.join(held, ["antecedent", "consequent"]).withColumn("observable", (F.col("held_antecedent") > 0) & (F.col("held_consequent") > 0)).withColumn(
        "judged", F.col("observable") & (F.col("held_antecedent") >= least)).withColumn("held_lift", lift), "held")
    exact = F.pandas_udf(fisher_p, "double")
    p = rows.where("judged").select("antecedent", "consequent", exact("held_both", "held_antecedent", "held_consequent", "held_baskets").alias("held_p"))
    q = benjamini_hochberg(p, "held_p", "held_q").select("antecedent", "consequent", "held_p", "held_q")
    return rows.join(q, ["antecedent", "consequent"], "left").withColumn("held_significant", F.coalesce(F.col("held_q") <= alpha, F.lit(False))).withColumn(
        "survives", F.col("judged") & F.coalesce(F.col("held_lift") > min_lift, F.lit(False)) & F.col("held_significant"))


def survival(validated: DataFrame, min_lift: float = 1.0) -> DataFrame:
    """One row: rules mined, judged, surviving, too thin, unobservable, and lost on significance alone; the judged rules' share
    of survivors, median lifts with their difference, mean change of lift, and rank correlation of lift (from three rules on)."""
    rows = stored(validated, "validated")
    judged = rows.where("judged")
    ranks = correlation(judged, "lift", "held_lift").select(F.col("spearman").alias("lift_rank_correlation"))
    above = F.coalesce(F.col("held_lift") > min_lift, F.lit(False))
    counts = rows.agg(
        F.count("*").alias("mined"), F.count_if("judged").alias("judged"), F.count_if("survives").alias("surviving"), F.count_if(F.col("observable") & ~F.col("judged")).alias("too_thin"),
        F.count_if(~F.col("observable")).alias("unobservable"), F.count_if(F.col("judged") & above & ~F.col("held_significant")).alias("lost_on_significance"))
    means = judged.agg(
        F.avg(F.col("survives").cast("int")).alias("survival_rate"), F.median("lift").alias("median_lift_mined"), F.median("held_lift").alias("median_lift_held"),
        (F.median("held_lift") - F.median("lift")).alias("lift_shrinkage"), F.avg(F.col("held_lift") - F.col("lift")).alias("mean_shrinkage"))
    return counts.join(F.broadcast(means)).join(F.broadcast(ranks)).withColumn("lift_rank_correlation", F.when(F.col("judged") >= 3, F.col("lift_rank_correlation")))


#: Shares of surviving rules from which they count as durable, or as mixed.
SURVIVED_WELL, SURVIVED_POORLY = 0.70, 0.40


def survival_verdict(rate: Column) -> Column:
    return F.when(rate.isNull(), "not judged").when(rate >= SURVIVED_WELL, "durable").when(rate >= SURVIVED_POORLY, "mixed").otherwise("transient")


def summary(rules: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row over tested rules: how many, associations, significant ones, those lost to the correction; lifts and supports."""
    return rules.agg(
        F.count("*").alias("rules"), F.count_if("is_association").alias("associations"), F.count("p_value").alias("tested"), F.count_if("significant").alias("significant"),
        F.count_if((F.col("p_value") <= alpha) & ~F.col("significant")).alias("lost_to_correction"), F.median("lift").alias("median_lift"), F.max("lift").alias("highest_lift"), F.median("support").alias("median_support"))


#: Measures by which rules can be ranked.
RANKED_BY = ("lift", "confidence", "support", "leverage", "conviction", "zhang", "all_confidence", "cosine", "normalised_lift", "cross_support")


def top_rules(rules: DataFrame, by: str = "lift", n: int = 20) -> DataFrame:
    """The n best associations by one measure (null last), with their place; ties go by items."""
    if by not in RANKED_BY:
        raise ValueError(f"rules are not ranked by {by}")
    order = [F.col(by).desc_nulls_last(), F.asc("antecedent"), F.asc("consequent")]
    best = rules.where("is_association").orderBy(*order).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def new_item_coverage(rules: DataFrame, mined: DataFrame, later: DataFrame, threshold: int = 1) -> DataFrame:
    """One row: items that only the later baskets have, and how many of them the rules recommend."""
    fresh = later.select("item").distinct().join(mined.select("item").distinct(), "item", "left_anti")
    counts = rules.groupBy(F.col("consequent").alias("item")).agg(F.count("*").alias("k"))
    return fresh.join(counts, "item", "left").agg(F.count("*").alias("new_items"), F.count_if(F.coalesce("k", F.lit(0)) >= threshold).alias("covered")).withColumn("share", ratio(F.col("covered"), F.col("new_items")))


def hazards(rules: DataFrame, catalogue: DataFrame, later: DataFrame) -> DataFrame:
    """One row: what rules cannot reach (catalogue, new items), how many explain themselves (all do), and how uneven their exposure is."""
    counts = rules.groupBy(F.col("consequent").alias("item")).agg(F.count("*").alias("k"))
    near = coverage(rules, catalogue).select("items", "reachable", F.col("share").alias("item_coverage"))
    fresh = new_item_coverage(rules, catalogue, later).select("new_items", F.col("share").alias("new_item_coverage"))
    shown = rules.agg(F.count("*").alias("rules"), F.coalesce(F.avg((F.size("antecedent") > 0).cast("int")), F.lit(1.0)).alias("transparency"))
    return near.join(F.broadcast(fresh)).join(F.broadcast(shown)).join(F.broadcast(gini(counts, "k").select(F.col("gini").alias("exposure_gini"))))


def overlap(first: DataFrame, second: DataFrame, n: int = 50) -> DataFrame:
    """Jaccard of the keys of the n best rules (by lift) of two rule sets; not a number where neither has rules."""
    best = lambda r: r.orderBy(F.desc("lift"), "antecedent", "consequent").limit(n).select("antecedent", "consequent")
    shared = best(first).intersect(best(second)).agg(F.count("*").alias("shared"))
    every = best(first).union(best(second)).distinct().agg(F.count("*").alias("all"))
    return shared.join(F.broadcast(every)).select("shared", "all", F.coalesce(F.try_divide("shared", "all"), F.lit(float("nan"))).alias("jaccard"))


def coverage(rules: DataFrame, catalogue: DataFrame, threshold: int = 1) -> DataFrame:
    """Share of the catalogue's items that at least `threshold` rules recommend."""
    counts = rules.groupBy(F.col("consequent").alias("item")).agg(F.count("*").alias("k"))
    return catalogue.select("item").distinct().join(counts, "item", "left").agg(
        F.count("*").alias("items"), F.count_if(F.coalesce("k", F.lit(0)) >= threshold).alias("reachable")
    ).withColumn("share", ratio(F.col("reachable"), F.col("items")))


def affinity(rules: DataFrame, weight: str = "normalised_lift") -> DataFrame:
    """Undirected edges (a < b): the largest weight of the rules that hold both items."""
    whole = rules.select(F.array_append("antecedent", F.col("consequent")).alias("items"), F.col(weight).alias("w"))
    pairs = whole.select("w", "items", F.explode("items").alias("a")).select("w", "a", F.explode("items").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.max("w").alias("weight"))
