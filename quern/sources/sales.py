"""The retail view: one row for each sale line, over the star of order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of the view -> (expression, dimension tables it needs).  The price's halves go away from zero, as doubles, like its SQL's.
_COLUMNS = {
    "invoice_id": ("cast(l_orderkey as string)", ()),
    "occurred_at": ("o_orderdate", ("orders",)),
    "product_code": ("cast(l_partkey as string)", ()),
    "brand": ("p_brand", ("part",)),
    "product_name": ("p_name", ("part",)),
    "category": ("p_type", ("part",)),
    "customer_id": ("case when c_mktsegment = 'HOUSEHOLD' then null else cast(c_custkey as string) end", ("orders", "customer")),
    "region": ("n_name", ("orders", "customer", "nation")),
    "quantity": ("cast(cast(l_quantity as decimal(12,3)) * case when l_returnflag = 'R' then -1 else 1 end as decimal(12,3))", ()),
    "unit_price": ("cast(cast(round(l_extendedprice / l_quantity * 10000) as decimal(12,0)) / 10000 as decimal(12,4))", ()),
    "revenue": ("cast(cast(l_extendedprice as decimal(14,2)) * case when l_returnflag = 'R' then -1 else 1 end as decimal(14,2))", ()),
    "is_return": ("l_returnflag = 'R'", ()),
}
_KEYS = {
    "orders": ("l_orderkey", "o_orderkey"), "part": ("l_partkey", "p_partkey"),
    "customer": ("o_custkey", "c_custkey"), "nation": ("c_nationkey", "n_nationkey"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The view's columns (all by default); only the dimensions they need are joined."""
    wanted = columns or tuple(_COLUMNS)
    needed = {t for c in wanted for t in _COLUMNS[c][1]}
    lines = read(spark, sf_dir, "lineitem")
    for name, (left, right) in _KEYS.items():
        if name in needed:
            lines = lines.join(read(spark, sf_dir, name), F.col(left) == F.col(right))
    return lines.selectExpr(*[f"{_COLUMNS[c][0]} as {c}" for c in wanted])


def order_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view by order and return: invoice_id, occurred_at, customer_id, is_return, quantity and revenue as sums, and lines.

    Lines are summed before they meet their orders and customers, so the joins run over orders.
    """
    kept = [F.expr(_COLUMNS[c][0]).alias(c) for c in ("is_return", "quantity", "revenue")]
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", *kept).groupBy("l_orderkey", "is_return").agg(
        F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"), F.count("*").alias("lines"))
    for name in ("orders", "customer"):
        left, right = _KEYS[name]
        lines = lines.join(read(spark, sf_dir, name), F.col(left) == F.col(right))
    return lines.selectExpr(*[f"{_COLUMNS[c][0]} as {c}" for c in ("invoice_id", "occurred_at", "customer_id")], "is_return", "quantity", "revenue", "lines")


def bucket(column: str | Column, granularity: str) -> Column:
    """First day of the day, week (Monday), month, quarter or year."""
    return F.date_trunc(granularity, column).cast("date")


SALES_SQL = """
sales AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS invoice_id, o_orderdate AS occurred_at, CAST(l_partkey AS VARCHAR) AS product_code,
         p_brand AS brand, p_name AS product_name, p_type AS category,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS customer_id, n_name AS region,
         CAST(CAST(l_quantity AS DECIMAL(12,3)) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS DECIMAL(12,3)) AS quantity,
         CAST(l_extendedprice / l_quantity AS DECIMAL(12,4)) AS unit_price,
         CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS DECIMAL(14,2)) AS revenue,
         l_returnflag = 'R' AS is_return
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey)
"""
