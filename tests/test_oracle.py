"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as entry_module
from doccat.plans.oracle import ORACLES
from doccat.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_entry(spark):
    page = entry_module.entry(spark)
    assert page.columns == ["id", "title", "concern"]
    assert 0 < page.count() <= 20


def test_sync_plan_partitions_everything(spark, sf_dir):
    from doccat.plans import inputs as I

    on_disk, known = I.index_state(spark, sf_dir)
    plan = QUERIES["sync_plan"](spark, sf_dir)
    ids = on_disk.select("id").union(known.select("id")).distinct()
    assert plan.count() == ids.count() == plan.select("id").distinct().count()
