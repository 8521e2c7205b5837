"""Queries against their SQL in another engine, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A cross-section of every group; the full set runs at a larger size elsewhere.
CHOSEN = [
    "sales_filtered", "sales_semi_category", "kpi_growth", "trend_week", "breakdown_customer", "product_periods_top", "rfm_base", "filter_options", "trend_points",
    "pareto_products", "gini_products", "hist_revenue_log", "describe_revenue", "calendar_dow", "gap_fill_day", "clean_reasons", "clean_rows", "mi_events",
    "corr_quantity_price", "kruskal_h", "mannwhitney_u", "discount_bands", "feature_table", "series_profile", "decompose_month", "anomaly_week", "rfm_scores",
    "anomaly_day", "rfm_summary", "itemsets_2", "rules_pairs", "rules_tested", "rules_holdout", "rule_hazards", "recommendations", "fc_total", "fc_folds", "fc_seasonal_drift", "fc_combination_median", "fc_intervals", "rfm_windows", "adjusted_rand", "stream_sessions",
]


def plain(rows, columns):
    def one(v):
        return "null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, sf_dir, engine, name):
    got = [r.asDict() for r in __spark_entry__.queries()[name](spark, sf_dir).collect()]
    cursor = engine.execute(__spark_entry__.oracle_sql()[name])
    columns = sorted(c[0] for c in cursor.description)
    expected = [dict(zip([c[0] for c in cursor.description], r)) for r in cursor.fetchall()]
    assert not got or sorted(got[0]) == columns
    assert plain(got, columns) == plain(expected, columns)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
