"""Every registered query of the engine against its SQL."""

import pytest

from tidemark import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, sf_dir, same, name):
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLES[name])


def test_processing_time_window(spark, sf_dir):
    rows = catalogue.processing_time_window(spark, sf_dir).collect()
    assert sum(int(r.value.split()[1]) for r in rows) == 200


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
