"""Every query of the engine beside its SQL in DuckDB."""

import pytest

from siftline.plans import queries as core
from tests.conftest import SF, rows_of


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows(spark, oracle, name):
    assert rows_of(core.QUERIES[name](spark, SF).toPandas()) == rows_of(oracle(core.SQL[name]))


def test_entry(spark):
    assert core.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.SQL)
