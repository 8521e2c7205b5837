"""Insight: reliability of each engine, signals, findings that reconcile them, ranked recommendations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.shape import ratio

#: The engines, the default weights of the ranking, and the bounds of bands and signals.
SOURCES = ("association", "forecast", "segmentation")
WEIGHTS = {"revenue_at_stake": 0.40, "evidence_weight": 0.40, "corroboration": 0.20}
STRONG, MODERATE = 0.70, 0.40
MATERIAL_FLOW = 0.15
LEAST_LIFT = 0.5
CONCENTRATED = 1.5


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))


# Reliability


def band(score: Column) -> Column:
    return F.when(score >= STRONG, "strong").when(score >= MODERATE, "moderate").when(score.isNotNull(), "weak").otherwise("unknown")


def forecast_reliability(wape: Column, coverage: Column, nominal: Column) -> Column:
    """1 from 15 % WAPE down, 0 from 30 % up, less where intervals cover too little; half where coverage is unknown."""
    honesty = F.when(coverage.isNull() | nominal.isNull(), 0.5).otherwise(_clamp(1 - F.greatest(F.lit(0.0), nominal - coverage) / 0.15))
    return _clamp((30 - wape) / 15) * honesty


def segmentation_reliability(ari: Column) -> Column:
    return _clamp(ari)


def association_reliability(survival: Column, correlation: Column) -> Column:
    """The survival rate; where the rank correlation of lift is known, it counts for a quarter."""
    return F.when(correlation.isNull(), _clamp(survival)).otherwise(_clamp(0.75 * survival + 0.25 * _clamp(correlation)))


def assess(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(source, score, band) of every engine from one-row frames with a column score; one without a row, or with null, is unknown and scores 0."""
    spark = next(iter(parts.values())).sparkSession
    grid = spark.createDataFrame([(s,) for s in SOURCES], "source string")
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(s).alias("source"), F.col("score").cast("double").alias("score")) for s, d in parts.items()])
    return grid.join(rows, "source", "left").select("source", F.coalesce("score", F.lit(0.0)).alias("score"), band(F.col("score")).alias("band"))


def reliability_summary(assessed: DataFrame) -> DataFrame:
    """One row: engines whose evidence is weak, those without any, and the caveat that the list carries; scores are not averaged."""
    named = lambda band_: F.array_sort(F.collect_list(F.when(F.col("band") == band_, F.col("source"))))
    got = assessed.agg(named("weak").alias("weak"), named("unknown").alias("unavailable"))
    return got.withColumn("caveat", F.when(F.size("weak") > 0, F.concat(F.lit("evidence of "), F.array_join("weak", ", "), F.lit(" is weak"))).otherwise("no engine's evidence is weak"))


# Signals


def _signal(source: str, kind: str, scope: str, key: Column, label: Column, direction: Column, magnitude: Column, nth: Column, evidence: Mapping[str, Column], about: Column | None = None, share: Column | None = None) -> list[Column]:
    pairs = [x for k, c in evidence.items() for x in (F.lit(k), c.cast("string"))]
    return [
        F.lit(source).alias("source"), F.lit(kind).alias("kind"), F.lit(scope).alias("scope"), key.cast("string").alias("key"), label.cast("string").alias("label"),
        direction.cast("int").alias("direction"), magnitude.cast("double").alias("magnitude"), nth.cast("long").alias("nth"), F.create_map(*pairs).alias("evidence"),
        (F.array().cast("array<string>") if about is None else about).alias("about"), (F.lit(None) if share is None else share).cast("double").alias("revenue_share"),
    ]


def from_forecast(bounds: DataFrame, nominal: float = 0.8) -> DataFrame:
    """Demand of the whole business, with its range, and a warning where intervals cover less than they promise.

    bounds: step, actual, forecast, lower, upper of the horizon.
    """
    got = bounds.agg(
        F.count("forecast").alias("horizon"), F.avg("forecast").alias("point"), F.coalesce(F.avg("actual"), F.min_by("forecast", "step")).alias("base"),
        F.avg("lower").alias("lo"), F.avg("upper").alias("hi"), F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("int")).alias("observed"),
    ).where("horizon > 0")
    over = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col("base"), F.col("base")), F.lit(0.0))
    way = F.when(over("point") > 0.02, 1).when(over("point") < -0.02, -1).otherwise(0)
    total = F.lit("__TOTAL__")
    demand = got.select(*_signal("forecast", "demand_direction", "business", total, total, way, over("point"), F.lit(0), {
        "horizon": F.col("horizon"), "pessimistic": F.round(over("lo"), 6), "central": F.round(over("point"), 6), "optimistic": F.round(over("hi"), 6)}))
    risk = got.where(F.col("observed") < nominal).select(*_signal("forecast", "interval_understates_risk", "business", total, total, F.lit(-1), nominal - F.col("observed"), F.lit(1), {
        "nominal": F.lit(nominal), "observed": F.round("observed", 6)}))
    return demand.union(risk)


def from_segments(profiles: DataFrame, flows: DataFrame | None = None, largest: int = 5) -> DataFrame:
    """Concentration of revenue by segment, and material flows out of one.

    profiles: key, name, customers, customer_share, revenue_share; flows: window, a, b, n, share_of_source
    (the `largest` of each window count, from a material share on).
    """
    over = F.coalesce(F.try_divide(F.col("revenue_share"), F.col("customer_share")), F.lit(0.0))
    out = profiles.where("revenue_share is not null and customer_share is not null").select(*_signal(
        "segmentation", "revenue_concentration", "segment", F.col("key"), F.col("name"), F.when(over > 1, 1).otherwise(-1), over, F.lit(0), {"customers": F.col("customers")}, share=F.col("revenue_share")))
    if flows is None:
        return out
    nth = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("n"), "a", "b"))
    moved = flows.where("a <> b").withColumn("_nth", nth).where((F.col("_nth") <= largest) & (F.col("share_of_source") >= MATERIAL_FLOW))
    names = profiles.select(F.col("key").alias("_key"), "name")
    named = moved.join(F.broadcast(names), F.col("a") == F.col("_key"), "left")
    return out.union(named.select(*_signal(
        "segmentation", "segment_outflow", "segment", F.col("a"), F.coalesce("name", "a"), F.lit(-1), F.col("share_of_source"), F.dense_rank().over(Window.orderBy("window")) * (largest + 1) + F.col("_nth"),
        {"window": F.col("window"), "to": F.col("b")}, F.array(F.col("b").cast("string")))))


def from_rules(rules: DataFrame, coverage: DataFrame | None = None, fresh: DataFrame | None = None, limit: int = 25, least: float = LEAST_LIFT) -> DataFrame:
    """The best associations by normalised lift (durable if they held on later baskets), and what rules cannot reach.

    rules: antecedent, consequent, both, lift, normalised_lift, is_association, held; coverage: items, reachable;
    fresh: new_items, covered.
    """
    order = [F.desc("normalised_lift"), F.col("antecedent"), F.col("consequent")]
    best = rules.where(F.col("is_association") & (F.col("normalised_lift") >= least)).orderBy(*order).limit(limit).withColumn("nth", F.row_number().over(Window.orderBy(*order)))
    key = F.concat(F.array_join("antecedent", " + "), F.lit(" -> "), F.col("consequent"))
    evidence = {"support_count": F.col("both"), "lift": F.round("lift", 4)}
    items = F.array_sort(F.array_distinct(F.array_append("antecedent", F.col("consequent"))))
    parts = [
        best.where(which).select(*_signal("association", kind, "product", key, key, F.lit(1), F.col("normalised_lift"), F.col("nth"), evidence, items))
        for kind, which in (("durable_pairing", F.coalesce("held", F.lit(False))), ("pairing", ~F.coalesce("held", F.lit(False))))
    ]
    for frame, kind, name, n, k in ((coverage, "catalogue_blind_spot", "__CATALOGUE__", "items", "reachable"), (fresh, "new_product_blind_spot", "__NEW_PRODUCTS__", "new_items", "covered")):
        if frame is not None:
            parts.append(frame.where(F.col(n) > 0).select(*_signal("association", kind, "business", F.lit(name), F.lit(name), F.lit(-1), 1 - F.col(k) / F.col(n), F.lit(0), {n: F.col(n), k: F.col(k)})))
    return reduce(DataFrame.union, parts)


def collect_signals(parts: Sequence[DataFrame], assessed: DataFrame) -> DataFrame:
    """All signals with the reliability of their engine; engines that were not assessed weigh 0."""
    rows = reduce(DataFrame.unionByName, parts)
    known = F.broadcast(assessed.select(F.col("source").alias("_s"), "score", "band"))  # one row for each engine
    return rows.join(known, F.col("source") == F.col("_s"), "left").drop("_s").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("band", F.coalesce("band", F.lit("unknown")))


def scopes_present(signals: DataFrame) -> DataFrame:
    return signals.groupBy("source").agg(F.array_sort(F.collect_set("scope")).alias("scopes"))


# Findings


def reconcile(signals: DataFrame) -> DataFrame:
    """Findings by (scope, key): sources, corroboration, conflicts, the strongest reliability, and the business signals as context."""
    by = lambda d: F.array_sort(F.collect_set(F.when(F.col("direction") == d, F.col("source"))))
    grouped = signals.groupBy("scope", "key").agg(
        F.max("label").alias("label"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("kind")).alias("kinds"),
        by(1).alias("_up"), by(-1).alias("_down"), F.max("score").alias("evidence_weight"), F.count("*").alias("signals"),
        F.array_sort(F.collect_set(F.when(F.col("band").isin("weak", "unknown"), F.concat_ws(" ", "source", "band")))).alias("weak"))
    context = signals.where("scope = 'business'").agg(F.array_sort(F.collect_set("kind")).alias("context"))  # a handful of kinds
    within = F.array_intersect("_up", "_down")
    up, down = F.array_except(F.col("_up"), within), F.array_except(F.col("_down"), within)
    conflicts = F.concat(
        F.when((F.size(up) > 0) & (F.size(down) > 0), F.array(F.lit("between sources"))).otherwise(F.array().cast("array<string>")),
        F.transform(within, lambda s: F.concat(F.lit("within "), s)))
    return grouped.join(F.broadcast(context)).select(
        "scope", "key", "label", "sources", "kinds", "signals", "evidence_weight", (F.size("sources") > 1).alias("corroborated"), conflicts.alias("conflicts"),
        F.array_except(F.array(*[F.lit(s) for s in SOURCES]), "sources").alias("silent"), "weak",
        F.when(F.col("scope") == "business", F.array().cast("array<string>")).otherwise(F.col("context")).alias("context"))


def integration_report(findings: DataFrame, signals: DataFrame) -> DataFrame:
    """One row: how many findings several engines support, how many conflict, and where engines share a scope."""
    shared = signals.groupBy("scope").agg(F.count_distinct("source").alias("k")).where("k > 1").agg(F.array_join(F.array_sort(F.collect_set("scope")), ",").alias("shared_scopes"))
    per = lambda s: F.count_if(F.col("scope") == s).alias(f"{s}_findings")
    return findings.agg(
        F.count("*").alias("findings"), F.count_if("corroborated").alias("corroborated"), F.coalesce(F.avg(F.col("corroborated").cast("int")), F.lit(0.0)).alias("corroborated_share"),
        F.count_if(F.size("conflicts") > 0).alias("with_conflicts"), per("business"), per("segment"), per("product")).join(F.broadcast(shared))


# Recommendations


def recommendations(findings: DataFrame, signals: DataFrame, total_revenue: DataFrame | None = None) -> DataFrame:
    """Decision items, each from a kind of signal of a finding, with its evidence and caveats.

    total_revenue: one row with a column total, for the revenue at stake in a concentrated segment.
    """
    first = F.row_number().over(Window.partitionBy("scope", "key", "_template").orderBy(F.col("kind") != "durable_pairing", "nth"))
    template = (
        F.when(F.col("kind").isin("durable_pairing", "pairing"), "stock_and_display_together")
        .when((F.col("kind") == "revenue_concentration") & (F.col("magnitude") >= CONCENTRATED), "protect_concentrated_revenue")
        .when(F.col("kind") == "segment_outflow", "investigate_segment_outflow").when(F.col("kind") == "demand_direction", "plan_for_demand_direction")
        .when(F.col("kind") == "catalogue_blind_spot", "cover_catalogue_blind_spot").when(F.col("kind") == "new_product_blind_spot", "cover_new_product_blind_spot"))
    rows = signals.withColumn("_template", template).where("_template is not null").withColumn("_n", first).where("_n = 1").select(
        F.col("scope").alias("_scope"), F.col("key").alias("_key"), F.col("_template").alias("template"), "kind", "magnitude", "about", "revenue_share", "evidence")
    joined = findings.join(rows, (F.col("scope") == F.col("_scope")) & (F.col("key") == F.col("_key"))).drop("_scope", "_key")
    joined = joined.withColumn("total", F.lit(None).cast("double")) if total_revenue is None else joined.join(F.broadcast(total_revenue.select(F.col("total").cast("double").alias("total"))))
    own = lambda t: F.col("template") == t
    name = (
        F.when(own("stock_and_display_together"), F.concat(F.lit("pairing::"), F.array_join("about", " | ")))
        .when(own("protect_concentrated_revenue"), F.concat(F.lit("concentration::"), F.col("key")))
        .when(own("investigate_segment_outflow"), F.concat(F.lit("outflow::"), F.col("key"), F.lit("::"), F.element_at("about", 1)))
        .when(own("plan_for_demand_direction"), F.lit("demand::total")).otherwise(F.concat(F.lit("blindspot::"), F.col("key"))))
    action = (
        F.when(own("stock_and_display_together"), F.concat(F.lit("Stock and show together: "), F.array_join("about", ", ")))
        .when(own("protect_concentrated_revenue"), F.concat(F.lit("Serve apart from the rest: "), F.col("label")))
        .when(own("investigate_segment_outflow"), F.concat(F.lit("Find out why customers leave: "), F.col("label")))
        .when(own("plan_for_demand_direction"), F.concat(F.lit("Plan for demand between "), F.element_at("evidence", "pessimistic"), F.lit(" and "), F.element_at("evidence", "optimistic")))
        .when(own("cover_catalogue_blind_spot"), F.lit("Advise by other means on products that no rule reaches")).otherwise(F.lit("Advise by other means on new products")))
    extra = F.filter(F.array(
        F.when(F.col("kind") == "pairing", "not confirmed on later baskets"),
        F.when(own("plan_for_demand_direction") & F.array_contains("kinds", "interval_understates_risk"), "intervals understate the risk")), lambda c: c.isNotNull())
    caveats = F.concat(F.transform("weak", lambda w: F.concat(F.lit("evidence of "), w)), F.transform("conflicts", lambda c: F.concat(F.lit("conflict "), c)), extra)
    stake = F.when(own("protect_concentrated_revenue"), F.col("total") * F.col("revenue_share"))
    return joined.select(
        name.alias("key"), "template", action.alias("action"), "scope", F.col("key").alias("subject"), "label", "sources", "silent", "corroborated", "evidence_weight", "signals", "magnitude", "evidence",
        caveats.alias("caveats"), stake.alias("revenue_at_stake"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """The best evidence of each key; ties go to the finding of most signals, then to the first subject."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("evidence_weight"), F.desc("signals"), "subject"))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")


def weights(given: Mapping[str, float] | None = None) -> dict[str, float]:
    """All three components named, none negative, scaled to a sum of one."""
    chosen = dict(WEIGHTS if given is None else given)
    if set(chosen) != set(WEIGHTS) or min(chosen.values()) < 0 or not sum(chosen.values()):
        raise ValueError(f"weights must be non-negative and name {sorted(WEIGHTS)}")
    return {k: v / sum(chosen.values()) for k, v in chosen.items()}


def explain_weights(given: Mapping[str, float] | None = None) -> dict[str, str]:
    meaning = {
        "revenue_at_stake": "money at stake over the largest in the list; 0 where none is known",
        "evidence_weight": "reliability of the strongest engine behind the item", "corroboration": "1 where several engines speak of the same subject",
    }
    return {k: f"{w:.2f}: {meaning[k]}" for k, w in weights(given).items()}


def ranked(rows: DataFrame, given: Mapping[str, float] | None = None) -> DataFrame:
    """Priority from relative revenue at stake, evidence and corroboration; order by priority, evidence, key.

    The window orders recommendations, a list for people.
    """
    w = weights(given)
    top = rows.agg(F.max("revenue_at_stake").alias("_top"))
    money = F.coalesce(F.when(F.col("_top") > 0, ratio(F.col("revenue_at_stake"), F.col("_top"))), F.lit(0.0))
    priority = w["revenue_at_stake"] * money + w["evidence_weight"] * F.col("evidence_weight") + w["corroboration"] * F.col("corroborated").cast("int")
    scored = rows.join(F.broadcast(top)).withColumn("priority", priority).drop("_top")
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), F.desc("evidence_weight"), "key")).cast("long"))


# Readings of the list

#: What the quantities in evidence are called.
DRIVERS = {
    "support_count": "orders with both products", "lift": "times more often together than by chance", "items": "products in the catalogue", "reachable": "products that a rule names",
    "new_items": "products that only later orders have", "covered": "of those, products that a rule names", "pessimistic": "lower end of demand", "optimistic": "upper end of demand",
    "customers": "customers in the segment", "customer_share": "the segment's share of customers", "revenue_share": "the segment's share of revenue", "coverage": "share of periods inside the interval",
}


def drivers(listed: DataFrame) -> DataFrame:
    """(key, place, feature, label, value): the quantities behind each recommendation that have a name for people."""
    labels = F.create_map(*[F.lit(x) for pair in DRIVERS.items() for x in pair])
    each = listed.select("key", "place", F.explode("evidence").alias("feature", "value"))
    return each.withColumn("label", labels[F.col("feature")]).where("label is not null and value is not null").select("key", "place", "feature", "label", "value")



def transparency(rows: DataFrame) -> DataFrame:
    """Share of recommendations that carry evidence."""
    return rows.agg(F.count("*").alias("n"), F.avg((F.size("evidence") > 0).cast("int")).alias("transparency"))


def consistency(rows: DataFrame, threshold: float = 0.34) -> DataFrame:
    """By template: mean Jaccard distance of pairs of source sets, from counts of distinct sets, not from all pairs of rows."""
    sets = rows.groupBy("template", "sources").agg(F.count("*").alias("n"))
    a = sets.select("template", F.col("sources").alias("x"), F.col("n").alias("nx"))
    b = sets.select(F.col("template").alias("_t"), F.col("sources").alias("y"), F.col("n").alias("ny"))
    union = F.size(F.array_union("x", "y"))
    far = F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect("x", "y")) / union)
    both = a.join(b, F.col("template") == F.col("_t")).groupBy("template").agg(F.sum(far * F.col("nx") * F.col("ny")).alias("s"))
    sizes = sets.groupBy("template").agg(F.sum("n").alias("n"))
    out = both.join(sizes, "template").select("template", "n", F.coalesce(F.try_divide("s", F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("divergence"))
    return out.withColumn("consistent", F.col("divergence") <= threshold)


def isolated(signals: DataFrame, per_list: int = 10) -> DataFrame:
    """The lists that each engine alone would show: its strongest signals."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.abs("magnitude")), "scope", "key", "kind", "nth"))
    return signals.withColumn("place", nth.cast("long")).where(F.col("place") <= per_list)


def burden(integrated: DataFrame, lists: DataFrame) -> DataFrame:
    """One row: what a reader of separate lists has to compare, and what only the integrated list has."""
    alone = lists.agg(F.count("*").alias("baseline_items"))
    return integrated.agg(
        F.count("*").alias("integrated_items"), F.count_if("corroborated").alias("corroborated_items"), F.count_if(F.size("caveats") > 0).alias("items_with_caveat"),
    ).join(F.broadcast(alone)).withColumn("comparisons_required", F.col("baseline_items") * (len(SOURCES) - 1))


def session_pack(lists: DataFrame) -> DataFrame:
    """(source, place, line): the separate lists as text, one report for each engine."""
    return lists.select("source", "place", F.concat(F.col("place").cast("string"), F.lit(". "), F.col("label"), F.lit(": "), F.col("kind"), F.lit(" "), F.round("magnitude", 4).cast("string")).alias("line"))
