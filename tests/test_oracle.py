"""Every registered query against its oracle SQL on the smallest tables.

A result may be empty only when the oracle's is; the larger tables are compared
with `python tests/compare.py` (SF_DIR selects the folder).
"""

import pytest

import __spark_entry__ as entry
from tests import compare

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    bad, *_ = compare.check(spark, con, FOLDER, name, entry.queries()[name], ORACLES.get(name))
    assert bad is None, bad


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
