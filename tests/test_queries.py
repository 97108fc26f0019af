"""Every registered query against its SQL, on whole tables."""

import pytest

from workload import ORACLES, QUERIES
from workload.check import compare


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, connection, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, connection, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
