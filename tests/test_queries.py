import pytest
from oracle import assert_same

from tamarisk.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(name, spark):
    """At the size at which rows fall on ties and unlike zones, which the smallest has too few of."""
    assert_same(catalogue.QUERIES[name], catalogue.ORACLE[name], spark, "/root/testdata/sf0.01")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["adm1_en", "adm1_pcode", "adm0_en", "mean_exposed", "total_pop", "pct_exposed"]
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
