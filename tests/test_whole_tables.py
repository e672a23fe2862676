"""Queries over every window, batch and order: equal to their SQL as registered, and with all rows in it."""

import pytest
from oracle_check import compare, duck

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
QS, SQLS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def check(spark, con, name):
    return compare(QS[name](spark, SF), con, SQLS[name])


@pytest.mark.parametrize("name", sorted(k for k, q in SQLS.items() if "windows AS (" in q))
def test_every_error_row_is_a_window(spark, con, name):
    assert check(spark, con, name) is None
    if name == "t21_period_bands":
        n = con.execute("SELECT count(*) FROM events WHERE event_type = 'error'").fetchone()[0]
        assert QS[name](spark, SF).select("event").distinct().count() == n


def test_merge_new_takes_three_batches(spark, con):
    assert check(spark, con, "s12_merge_new") is None
    assert QS["s12_merge_new"](spark, SF).count() == con.execute("SELECT count(*) FROM events").fetchone()[0]


def test_every_order_can_be_a_partner(spark, con):
    assert check(spark, con, "e03_either_order_pairs") is None
    assert QS["e03_either_order_pairs"](spark, SF).where("NOT venue_id_found").count() == 0
