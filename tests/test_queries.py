"""Every registered query of the library proper against its SQL, and the entry point."""

import pytest

from folioquarry import catalog, catalog_more  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, sf, duck, same, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        same(df, duck.execute(catalog.ORACLES[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalog.QUERIES["qs_half_open_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10" in plan and "LessThan(l_quantity,12" in plan
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan
    top = catalog.QUERIES["qs_eq_in_sort_limit"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
