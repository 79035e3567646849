"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

from pathlib import Path

import oracle
import pytest

from kisaran.plans import registry

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(BASE)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_rows_match(spark, con, name):
    assert oracle.compare(registry.QUERIES[name](spark, BASE), con, registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_others_run(spark, name):
    assert registry.QUERIES[name](spark, BASE).columns


def test_flagship(spark):
    rows = registry.flagship(spark, BASE)
    assert rows.columns == ["commodity", "region", "obs_date", "fusion_score", "level", "components"]
    assert rows.count() > 0


def test_every_sql_has_its_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
