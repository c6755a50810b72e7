"""Every query of the engine against its SQL."""

import pytest

from palimpsest.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(name, same):
    same(plans.QUERIES[name], plans.SQL[name])


def test_rules_are_reached(duck):
    """Queries over rules have rows for each of them."""
    from palimpsest.functions import policy

    assert {r[0] for r in duck.sql(plans.SQL["exclusion_reason"]).project("exclusion").fetchall()} == {*policy.REASONS, None}
    assert {r[0] for r in duck.sql(plans.SQL["page_kind"]).project("kind").fetchall()} == {0, 1}
    assert len({r[0] for r in duck.sql(plans.SQL["robots_mask"]).project("mask").fetchall()}) > 2


def test_all_have_sql():
    assert set(plans.QUERIES) == set(plans.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[0] == "position" and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
