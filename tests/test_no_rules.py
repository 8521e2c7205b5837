import shutil

import duckdb
import pytest

import __spark_entry__
from tests.test_queries import TABLES, plain


@pytest.fixture(scope="module")
def without_rules(sf_dir, tmp_path_factory):
    """The smallest tables with a brand for each part, so that no pair is frequent."""
    folder = tmp_path_factory.mktemp("brands")
    for name in TABLES:
        shutil.copy(f"{sf_dir}/{name}.parquet", folder)
    duckdb.execute(f"COPY (SELECT * REPLACE ('Brand ' || p_partkey AS p_brand) FROM '{sf_dir}/part.parquet') TO '{folder}/part.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["rule_exposure", "rule_hazards", "rule_overlap"])
def test_tables_without_rules_equal_sql(spark, without_rules, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{without_rules}/{table}.parquet'")
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    expected = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert plain([r.asDict() for r in __spark_entry__.queries()[name](spark, without_rules).collect()], columns) == plain(expected, columns)
