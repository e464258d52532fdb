"""Every registered query of the engine against its SQL, and the ones without SQL against plain expectations."""

import pytest
from oracle import compare

from sparkloom.plans.registry import HAND_ORACLES, HAND_QUERIES, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(HAND_ORACLES))
def test_by_hand_against_sql(spark, sf, name):
    compare(HAND_QUERIES[name](spark, sf), HAND_ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(HAND_QUERIES) - set(HAND_ORACLES)))
def test_by_hand_runs(spark, sf, name):
    assert HAND_QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 7
    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
