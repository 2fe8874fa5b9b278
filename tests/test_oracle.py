"""Every core query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import oracle
from pagemill.plans import registry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connection(DATA)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, con, name):
    assert oracle.compare(registry.queries()[name](spark, DATA), con, registry.oracle_sql()[name]) == ""


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
