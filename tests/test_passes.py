from datetime import date, datetime

from pyspark.sql import functions as F

from quern.operators import aggregates, rules, segments, statistics


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_correlation_of_what_does_not_vary_is_null(spark):
    got = statistics.correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "a double, b double"), "a", "b").first()
    assert (got.n, got.pearson, got.spearman) == (2, None, None)


def test_either_side_of_a_date_is_a_filter(spark):
    rows = [(str(k), item, datetime(2024, 1, 1 + k)) for k in range(8) for item in "ab"] + [("0", "c", datetime(2024, 1, 8))]
    train, later = rules.split_by_date(spark.createDataFrame(rows, "invoice_id string, item string, at timestamp_ntz"))
    assert {r.invoice_id for r in later.collect()} == {"6", "7"} and train.count() == 13
    assert "SortMergeJoin" not in _plan(later) and "HashJoin" not in _plan(later)


def test_rules_are_measured_by_long_antecedents_and_absent_items(spark):
    rows = [("1", "a"), ("1", "b"), ("1", "c"), ("2", "a"), ("2", "b"), ("3", "c")]
    items = spark.createDataFrame(rows, "invoice_id string, item string")
    found = spark.createDataFrame([(["a", "b"], "c"), (["c"], "a"), (["d"], "a")], "antecedent array<string>, consequent string")
    got = {tuple(r.antecedent): (r.held_both, r.held_antecedent, r.held_consequent, r.held_baskets) for r in rules.measure_on(found, items).collect()}
    assert got == {("a", "b"): (1, 2, 2, 3), ("c",): (1, 2, 2, 3), ("d",): (0, 0, 2, 3)}
    assert rules.measure_on(found.where("consequent = 'x'"), items).count() == 0


def test_windows_take_one_pass_over_the_lines(spark):
    lines = spark.createDataFrame([("c", "1", datetime(2024, 1, 5), 1.0, 2.0, False), ("c", "2", datetime(2024, 2, 5), 1.0, 3.0, False), ("c", "2", datetime(2024, 2, 5), 1.0, 1.0, True)],
                                  "customer_id string, invoice_id string, occurred_at timestamp_ntz, quantity double, revenue double, is_return boolean")
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    got = segments.snapshots(lines.coalesce(1).mapInArrow(counted, lines.schema), [(0, date(2024, 1, 1), date(2024, 1, 31)), (1, date(2024, 1, 1), date(2024, 2, 29))])
    assert {(r.window, r.recency, r.tenure, r.frequency, r.monetary) for r in got.collect()} == {(0, 26, 4 - 4, 1, 2.0), (1, 24, 55 - 24, 2, 4.0)}
    assert passes.value == 3 and got.where(F.col("window") == 1).count() == 1


def test_products_by_period_shuffle_no_row_twice(spark):
    rows = [("p", datetime(2024, 1, d), c, r, 1.0, 2.0, 2.0, False) for d, c, r in ((1, "x", "n"), (2, "y", "n"), (3, None, "m"), (4, "x", None))]
    lines = spark.createDataFrame(rows, "product_code string, occurred_at timestamp_ntz, customer_id string, region string, quantity double, revenue double, unit_price double, is_return boolean")
    got = aggregates.product_periods(lines, "month")
    assert [(r.customers, r.regions, r.units) for r in got.collect()] == [(2, 2, 4.0)]
    assert "Expand" not in _plan(got)
