"""Every query against its SQL; queries without SQL are tested against plain versions in the other files."""

import pytest
from oracle import same

import __spark_entry__
from cadenza import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
