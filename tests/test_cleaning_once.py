"""The cleaning works a text out once, and its short way for days reads what the patterns read."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from quern.operators import cleaning


def test_a_text_is_normalised_once(spark):
    rows = spark.createDataFrame([("1.0", " a  b"), ("2", "c"), (None, "")], "invoice_id string, product_name string")
    seen = Observation()
    got = cleaning.normalised_once(rows, seen, ["invoice_id", "product_name"])
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = next(i for i, line in enumerate(plan) if "CollectMetrics" in line)
    assert not any("translate(" in line for line in plan[: above + 1]) and any("translate(" in line for line in plan[above:])
    assert [tuple(r) for r in got.collect()] == [("1", "a b"), ("2", "c"), (None, None)]
    assert seen.get == {"raw": 3, "text_invoice_id": 1, "text_product_name": 2}


def test_days_read_as_by_the_pattern(spark):
    values = ["2020-01-06", "2020-1-6", "2020-02-30", "0000-01-01", "0001-01-01", "2020-01-1 ", "+202-01-01", "-202-01-01", "2020-01-1T", "2020-1 -01", "20é0-01-01", "2020-13-01", "9999-12-31", "not a date", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    pattern = F.try_to_timestamp("v", F.lit("yyyy-M-d")).cast("timestamp_ntz")
    differing = rows.where(~cleaning.parse_date(F.col("v"), "iso").eqNullSafe(pattern)).select("v").collect()
    assert [r.v for r in differing] == []
