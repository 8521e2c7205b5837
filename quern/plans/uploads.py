"""Queries over text files that Spark writes from the given tables, bad lines among them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.operators import cleaning
from quern.plans.retail import query, rounded
from quern.sources import files
from quern.sources.sales import read
from quern.sources.stage import shared_dir

#: Lines of customers in debt have a field too many, those without a place in the market's segments one too few.
_CUSTOMER = """CASE WHEN c_acctbal < 0 THEN concat_ws(',', c_custkey, c_name, c_mktsegment, c_acctbal, 'debt') WHEN c_mktsegment = 'BUILDING' THEN concat_ws(',', c_custkey, c_name, c_mktsegment)
  ELSE concat_ws(',', c_custkey, concat('"', c_name, ', "', '"Ltd"', '""'), c_mktsegment, c_acctbal) END"""


def _written(spark, lines, header: str) -> str:
    """A folder of text files with a header each; a separator that no line holds keeps lines as they are."""
    folder = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}/text-{uuid.uuid4().hex}.csv"
    lines.toDF(header).write.csv(folder, header=True, sep="\x1f", quote="", emptyValue="")
    return folder


def _customers(spark, sf_dir):
    return _written(spark, read(spark, sf_dir, "customer").select(F.expr(_CUSTOMER)), "key,name,segment,balance")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE c_name || ', "Ltd"' END AS name, c_mktsegment AS segment,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN round(c_acctbal, 4) END AS balance FROM customer WHERE c_acctbal >= 0""")
def text_customers(spark, sf_dir):
    rows = files.read_table(spark, _customers(spark, sf_dir))
    return rounded(rows.withColumn("balance", F.col("balance").cast("double")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, 'debt' AS reason FROM customer WHERE c_acctbal < 0")
def text_malformed(spark, sf_dir):
    lines = files.malformed(spark, _customers(spark, sf_dir))
    return lines.select(F.substring_index("line", ",", 1).alias("key"), F.substring_index("line", ",", -1).alias("reason"))


_SALES = "concat_ws(',', l_orderkey, concat(' ', lower(l_returnflag)), CASE WHEN l_linestatus = 'F' THEN cast(l_quantity as string) ELSE 'none' END, date_format(l_shipdate, 'yyyy-MM-dd'), l_extendedprice)"


@query("""SELECT CAST(period AS VARCHAR) AS period, round(coalesce(value, 0), 3) AS value FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAYS))::DATE AS period, last FROM (
    SELECT date_trunc('week', min(l_shipdate)) AS lo, date_trunc('week', max(l_shipdate)) AS hi, max(l_shipdate)::DATE AS last FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'A'))
  LEFT JOIN (SELECT date_trunc('week', l_shipdate)::DATE AS period, sum(l_quantity * l_extendedprice) AS value FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'A' GROUP BY 1) USING (period) WHERE period + 6 <= last""")
def text_weekly(spark, sf_dir):
    folder = _written(spark, read(spark, sf_dir, "lineitem").select(F.expr(_SALES)), "Invoice,StockCode,Quantity,InvoiceDate,Price")
    return rounded(files.weekly_series(files.read_text(spark, folder), "StockCode", "Quantity", "Price", "InvoiceDate", ["A"]), 3)


@query("""SELECT 'rows' AS check, CASE WHEN count(*) >= 100 THEN '' ELSE 'TOO_FEW_ROWS' END AS code, count(*)::BIGINT AS found, 100::BIGINT AS needed FROM (SELECT 1 FROM lineitem WHERE l_extendedprice > 0)
UNION ALL SELECT 'weeks', CASE WHEN count(DISTINCT date_trunc('week', l_shipdate)) >= 8 THEN '' ELSE 'TOO_FEW_WEEKS' END, count(DISTINCT date_trunc('week', l_shipdate))::BIGINT, 8 FROM lineitem WHERE l_extendedprice > 0""")
def clean_enough(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_extendedprice > 0").select(F.col("l_shipdate").cast("timestamp_ntz").alias("occurred_at"))
    return cleaning.sufficient(rows)
