"""Every query of the library against its oracle."""

import pytest

from siftwork.catalog import ORACLES, QUERIES
from tests.compare import SMALL, oracle_rows, rows_of


def test_each_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, name):
    assert rows_of(QUERIES[name](spark, SMALL)) == oracle_rows(ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
