"""Queries of signals that every mined rule may give, against their SQL; the tables' rules are no significant associations."""

import pytest

import __spark_entry__
from tests.test_queries import engine, plain  # noqa: F401  (a fixture)

#: What each query showed of rules in products before associations of a high normalised lift were asked for.
SHOWS = {
    "signal_scopes": lambda rows: {r["scopes"] for r in rows if r["source"] == "association"} == {"business,product"},
    "presentation_isolated": lambda rows: any(r["scope"] == "product" for r in rows),
    "reconciliation_burden": lambda rows: rows[0]["integrated_items"] > 10,
    "recommendation_consistency": lambda rows: any(r["template"] == "stock_and_display_together" for r in rows),
}


@pytest.mark.parametrize("name", sorted(SHOWS))
def test_every_rule_may_give_a_signal(spark, sf_dir, engine, name):  # noqa: F811
    got = [r.asDict() for r in __spark_entry__.queries()[name](spark, sf_dir).collect()]
    cursor = engine.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    expected = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert plain(got, columns) == plain(expected, columns)
    assert SHOWS[name](got)
