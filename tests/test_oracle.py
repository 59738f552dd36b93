"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

import oracle
from turnwise import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    if name in SQL:
        assert not oracle.differences(df, con, SQL[name])
    else:
        assert df.count() >= 0


def test_flagship(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).count() > 0
