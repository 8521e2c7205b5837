"""Products by period with their average price, against SQL."""

import duckdb
import pytest

import __spark_entry__
from quern.sources.sales import SALES_SQL, sales

TABLES = "nation customer part orders lineitem".split()


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_price_is_averaged(spark, sf_dir, engine):
    got = __spark_entry__.queries()["product_periods"](spark, sf_dir)
    expected = engine.execute(f"WITH {SALES_SQL} SELECT product_code, CAST(date_trunc('month', occurred_at)::DATE AS VARCHAR) AS period, sum(unit_price)::DOUBLE / count(unit_price) AS price FROM sales GROUP BY 1, 2").fetchall()
    assert sorted((r.product_code, r.period, r.avg_unit_price) for r in got.collect()) == sorted(expected)


def test_product_periods_equals_sql(spark, sf_dir, engine):
    got = __spark_entry__.queries()["product_periods"](spark, sf_dir)
    cursor = engine.execute(__spark_entry__.oracle_sql()["product_periods"])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns) and "avg_unit_price" in columns
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(cursor.fetchall())


def test_prices_halfway_are_those_of_sql(spark, sf_dir, engine):
    lines = sorted((r.invoice_id, r.product_code, r.unit_price) for r in sales(spark, sf_dir, "invoice_id", "product_code", "unit_price").collect())
    assert lines == sorted(engine.execute(f"WITH {SALES_SQL} SELECT invoice_id, product_code, unit_price FROM sales").fetchall())
