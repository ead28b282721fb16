"""Every query with SQL gives what its SQL gives; every query runs."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, rows
from tribuna.plans import catalog, training

OWN = {**catalog.QUERIES, **training.QUERIES}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, data, con, name):
    ours = OWN[name](spark, data).toPandas()
    theirs = con.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(OWN) - set(catalog.SQL)))
def test_runs(spark, data, name):
    assert OWN[name](spark, data).columns


def test_entry(spark, data):
    assert entry.entry(spark).limit(1).collect()
    assert set(entry.oracle_sql()) <= set(entry.queries())
