"""Recency, frequency and money: scores, segments, summaries, bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.order import numbered, percentiles
from quern.operators.shape import ratio
from quern.sources.stage import stored

#: Upper bounds of the bands that reports show.
RECENCY_BANDS = (7, 30, 60, 90, 180, 365, 730)
MONETARY_BANDS = (100, 250, 500, 1_000, 2_500, 5_000, 10_000, 25_000, 50_000)


def with_measures(customers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recency in days before the last purchase of all (within `by`), tenure, net money, money per order."""
    as_of = customers.groupBy(*by).agg(F.max("last_purchase").alias("as_of"))
    return customers.join(F.broadcast(as_of), list(by) or None).select(
        *customers.columns, F.datediff("as_of", "last_purchase").cast("long").alias("recency"), F.datediff("as_of", "first_purchase").cast("long").alias("tenure"),
        (F.col("monetary_gross") - F.col("returns_value")).alias("monetary"), ratio(F.col("monetary_gross"), F.col("frequency")).alias("average_order"))


def scored(customers: DataFrame, bins: int = 5) -> DataFrame:
    """Scores 1 to `bins` by place (ties by customer); a recent customer has a high recency score."""
    rows = stored(with_measures(customers), "customers")
    out = rows.join(F.broadcast(rows.agg(F.count("*").alias("_n"))))
    for name, value in (("r", F.desc("recency")), ("f", F.asc("frequency")), ("m", F.asc("monetary"))):
        out = numbered(out, [value, "customer"], f"_{name}")
        out = out.withColumn(name, F.greatest(F.lit(1), F.ceil((F.col(f"_{name}") - 1) * F.lit(bins) / F.greatest(F.col("_n") - 1, F.lit(1)))).cast("long"))
    cell = F.concat(*[F.col(c).cast("string") for c in "rfm"])
    named = out.withColumn("cell", cell).withColumn("segment", segment(F.col("r"), F.col("f"), F.col("m"), bins))
    return stored(named.drop("_n", "_r", "_f", "_m"), "scores")


def segment(r: Column, f: Column, m: Column, top: int = 5) -> Column:
    """Six segments, first match wins; a customer's value is the better of frequency and money."""
    high, low = top - 1, 2
    valuable, recent = F.greatest(f, m) >= high, r >= high
    return (
        F.when(recent & valuable, "champions").when(valuable & (r >= low), "loyal").when(recent & (f <= low), "new")
        .when(recent, "potential_loyalist").when(valuable, "at_risk").otherwise("hibernating")
    )


def segment_summary(scored_rows: DataFrame) -> DataFrame:
    total = scored_rows.agg(F.sum("monetary").alias("all_money"), F.count("*").alias("all_customers"))
    money = percentiles(scored_rows, "monetary", [0.5], "_p", ["segment"]).select("segment", F.element_at("_p", 1).alias("median_monetary"))
    return scored_rows.groupBy("segment").agg(
        F.count("*").alias("customers"), F.sum("monetary").alias("monetary"), F.median("recency").alias("median_recency"), F.median("frequency").alias("median_frequency"),
    ).join(F.broadcast(money), "segment").join(F.broadcast(total)).select(
        "segment", "customers", "monetary", ratio(F.col("customers"), F.col("all_customers")).alias("customer_share"),
        ratio(F.col("monetary"), F.col("all_money")).alias("money_share"), "median_recency", "median_frequency", "median_monetary")


def bands(rows: DataFrame, value: str, uppers: Sequence[float]) -> DataFrame:
    """Customers by the first band that holds the value; every band has a row."""
    spark = rows.sparkSession
    names = [*[float(u) for u in uppers], float("inf")]
    place = F.lit(len(uppers))
    for k in reversed(range(len(uppers))):
        place = F.when(F.col(value) <= uppers[k], k).otherwise(place)
    grid = spark.createDataFrame([(k, u) for k, u in enumerate(names)], "band long, upper double")
    counted = rows.where(F.col(value).isNotNull()).groupBy(place.cast("long").alias("band")).agg(F.count("*").alias("customers"))
    return grid.join(counted, "band", "left").select("band", F.when(F.col("upper") < float("inf"), F.col("upper")).alias("upper"), F.coalesce("customers", F.lit(0)).cast("long").alias("customers"))


def recency_split(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("recency") <= 30).cast("int")).alias("recent_share"), F.avg((F.col("recency") > 365).cast("int")).alias("dormant_share"))


def segment_slope(summary: DataFrame) -> DataFrame:
    """Each segment's place by customers and by money."""
    by = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "segment")).cast("long")
    return summary.select("segment", by("customers").alias("place_by_customers"), by("monetary").alias("place_by_money"))


def top_customers(rows: DataFrame, k: int = 10) -> DataFrame:
    total = rows.agg(F.sum("monetary").alias("total"))
    return rows.orderBy(F.desc("monetary"), "customer").limit(k).join(F.broadcast(total)).select("customer", "monetary", ratio(F.col("monetary"), F.col("total")).alias("share"))
