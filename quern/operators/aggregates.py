"""Aggregates over sale lines: totals, trends, breakdowns, customers, baskets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.sales import bucket
from quern.sources.stage import stored


def _when(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("double")


def sold() -> Column:
    return ~F.col("is_return")


def returned() -> Column:
    return F.col("is_return")


def measures() -> dict[str, Column]:
    """Aggregates shared by totals and trends; a KPI that has no rows is 0, never null."""
    return {
        "gross_revenue": _when(sold(), F.col("revenue")),
        "returns_value": F.abs(_when(returned(), F.col("revenue"))),
        "units": _when(sold(), F.col("quantity")),
        "orders": F.count_distinct(F.when(sold(), F.col("invoice_id"))),
        "active_customers": F.count_distinct("customer_id"),
    }


def _by_order(sales: DataFrame, *keys: Column | str) -> DataFrame:
    """Lines summed by (keys, invoice, customer, return): what the distinct counts run over is orders, not lines."""
    return sales.groupBy(*keys, "invoice_id", "customer_id", "is_return").agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"), F.count("*").alias("_lines"))


def totals(sales: DataFrame) -> DataFrame:
    """One row: revenue, returns, units, orders, customers, guests' revenue, lines."""
    return _by_order(sales).agg(
        *[c.alias(k) for k, c in measures().items()],
        _when(sold() & F.col("customer_id").isNull(), F.col("revenue")).alias("guest_revenue"),
        F.coalesce(F.sum("_lines"), F.lit(0)).alias("lines"),
    ).withColumn("net_revenue", F.col("gross_revenue") - F.col("returns_value"))


def trend(sales: DataFrame, granularity: str = "week") -> DataFrame:
    return _by_order(sales, bucket("occurred_at", granularity).alias("period")).groupBy("period").agg(
        *[c.alias(k) for k, c in measures().items()]
    ).withColumn("net_revenue", F.col("gross_revenue") - F.col("returns_value"))


def breakdown(sales: DataFrame, *keys: str) -> DataFrame:
    """Measures by product, region, category or customer; rows without the key are left out."""
    present = sales.where(F.col(keys[0]).isNotNull())
    orders = present.groupBy(*dict.fromkeys([*keys, "invoice_id", "is_return"])).agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"), F.count("*").alias("_lines"))
    return orders.groupBy(*keys).agg(
        *[c.alias(k) for k, c in measures().items() if k not in ("active_customers", "orders")],
        F.count(F.when(sold(), F.col("invoice_id"))).alias("orders"), F.sum("_lines").alias("lines")
    )


def order_values(sales: DataFrame) -> DataFrame:
    return sales.where(sold()).groupBy("invoice_id").agg(F.sum("revenue").cast("double").alias("value"))


def daily_with_hour(sales: DataFrame) -> DataFrame:
    return sales.groupBy(bucket("occurred_at", "day").alias("day"), F.hour("occurred_at").cast("long").alias("hour")).agg(
        *[c.alias(k) for k, c in measures().items() if k in ("gross_revenue", "orders", "units")]
    )


def top_products(sales: DataFrame, n: int) -> DataFrame:
    """The n products of the largest gross revenue, ties by code."""
    return sales.where(sold()).groupBy("product_code").agg(F.sum("revenue").alias("r")).orderBy(F.desc("r"), "product_code").limit(n).select("product_code")


def product_periods(sales: DataFrame, granularity: str = "week", top: int | None = None) -> DataFrame:
    """Product by period; the average price counts return lines too, and divides a sum (exact for decimals).

    Regions, of which there are few, are counted as a set: a second distinct count would triple the rows that are shuffled.
    """
    chosen = sales if top is None else sales.join(top_products(sales, top), "product_code", "left_semi")
    return chosen.groupBy("product_code", bucket("occurred_at", granularity).alias("period")).agg(
        _when(sold(), F.col("quantity")).alias("units"), _when(sold(), F.col("revenue")).alias("gross_revenue"),
        F.try_divide(F.sum("unit_price").cast("double"), F.count("unit_price")).alias("avg_unit_price"),
        F.count_distinct("customer_id").alias("customers"), F.size(F.collect_set("region")).cast("long").alias("regions"),
    )


def group_values(sales: DataFrame, group: str, value: str = "order_value") -> DataFrame:
    """(label, value) by region, quarter or customer type; value is revenue of a line or of an order's lines under the label."""
    label = {
        "region": F.col("region"), "quarter": F.concat(F.lit("Q"), F.quarter("occurred_at")),
        "customer_type": F.when(F.col("customer_id").isNull(), "guest").otherwise("identified"),
    }[group]
    rows = sales.where(sold()).select(label.alias("label"), "invoice_id", F.col("revenue").alias("value")).where("label is not null")
    if value == "line":
        return rows.select("label", F.col("value").cast("double").alias("value"))
    return rows.groupBy("label", "invoice_id").agg(F.sum("value").cast("double").alias("value")).select("label", "value")


def filter_options(sales: DataFrame) -> DataFrame:
    """(kind, value, weight): date bounds and lines, regions by revenue, top 100 products, categories.

    One pass over the sales: sums by region, product, category and as a whole are grouping sets of
    one aggregation, combined on the map side.
    """
    none = F.lit(None).cast("double")
    sets = [[F.col("region")], [F.col("product_code")], [F.col("category")], []]
    got = stored(sales.groupingSets(sets, "region", "product_code", "category").agg(
        F.grouping_id().alias("level"), F.coalesce(F.sum(F.when(sold(), F.col("revenue"))), F.lit(0)).cast("double").alias("w"),
        F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"), F.count("*").alias("n")), "options")
    bounds = got.where("level = 7").select(F.explode(F.array(
        F.struct(F.lit("date_min").alias("kind"), F.col("lo").cast("date").cast("string").alias("value"), none.alias("weight")),
        F.struct(F.lit("date_max").alias("kind"), F.col("hi").cast("date").cast("string").alias("value"), none.alias("weight")),
        F.struct(F.lit("lines").alias("kind"), F.col("n").cast("string").alias("value"), none.alias("weight")),
    )).alias("x")).select("x.*")
    regions = got.where("level = 3 and region is not null").select(F.lit("region").alias("kind"), F.col("region").alias("value"), F.col("w").alias("weight"))
    products = got.where("level = 5").orderBy(F.desc("w"), "product_code").limit(100).select(
        F.lit("product").alias("kind"), F.col("product_code").alias("value"), F.col("w").alias("weight"))
    categories = got.where("level = 6 and category is not null").select(F.lit("category").alias("kind"), F.col("category").alias("value"), none.alias("weight"))
    return bounds.union(regions).union(products).union(categories)


def customers(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each identified customer (within `by`): first, last, orders, revenue, returns, units, lines.

    sales are lines, or sums of lines with their number in a column `lines`.
    """
    counted = F.sum("lines") if "lines" in sales.columns else F.count("*")
    return sales.where("customer_id is not null").groupBy(*by, F.col("customer_id").alias("customer")).agg(
        F.min("occurred_at").alias("first_purchase"), F.max("occurred_at").alias("last_purchase"),
        F.count_distinct(F.when(sold(), F.col("invoice_id"))).alias("frequency"),
        _when(sold(), F.col("revenue")).alias("monetary_gross"), F.abs(_when(returned(), F.col("revenue"))).alias("returns_value"),
        _when(sold(), F.col("quantity")).alias("units"), counted.alias("lines"),
    )


def guests(sales: DataFrame) -> DataFrame:
    return sales.where("customer_id is null").agg(_when(sold(), F.col("revenue")).alias("gross_revenue"), F.count("*").alias("lines"))


def basket_sizes(sales: DataFrame) -> DataFrame:
    return sales.where(sold()).groupBy("invoice_id").agg(
        F.count_distinct("product_code").alias("products"), F.sum("quantity").cast("double").alias("units"), F.sum("revenue").cast("double").alias("revenue"))


def basket_lines(sales: DataFrame, include_returns: bool = False) -> DataFrame:
    rows = sales.where("invoice_id is not null and product_code is not null")
    return rows if include_returns else rows.where(sold())
