"""Every query of the catalog against its SQL on the small tables."""

import pytest

from cleanloom.plans import analyses, catalog

SMALL = "/root/testdata/sf0.001"


QUERIES, ORACLES = catalog.QUERIES | analyses.QUERIES, catalog.ORACLES | analyses.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, oracle, name):
    oracle(QUERIES[name](spark, SMALL), ORACLES[name])


def test_sample(spark):
    assert catalog.QUERIES["analyze_sample"](spark, SMALL).count() == 3


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
