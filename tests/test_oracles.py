"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle_check import compare, duck

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
QS, SQLS = queries(), oracle_sql()
#: Queries whose result is empty on the smallest tables.
EMPTY = {"s02_pruned_scan"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_equals_sql(spark, con, name):
    assert compare(QS[name](spark, SF), con, SQLS[name]) == ("both empty" if name in EMPTY else None)


def test_names_agree():
    assert set(SQLS) <= set(QS)


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
