"""Queries on a tape with several prints of a market in one second, against their SQL on one thread."""

from pathlib import Path

import pytest
from oracle_check import TABLES, compare, duck

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """The smallest tables with every event followed, in its second, by a purchase and a view of another price."""
    d = tmp_path_factory.mktemp("tied")
    for t in TABLES:
        if t != "events":
            (d / f"{t}.parquet").symlink_to(Path(SF, f"{t}.parquet"))
    con = duck(SF)
    con.execute(
        f"""COPY (SELECT event_id + k * 1000000 AS event_id, ts, user_id, CASE k WHEN 0 THEN event_type WHEN 1 THEN 'purchase' WHEN 2 THEN 'view' ELSE event_type END AS event_type, value,
          CASE k WHEN 0 THEN props ELSE '{{"k": ' || ((CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) + k * 17) % 100) || '}}' END AS props
        FROM events, range(4) r(k) ORDER BY k, event_id) TO '{d}/events.parquet' (FORMAT parquet)"""
    )
    con = duck(d)
    con.execute("SET threads = 1")
    return str(d), con


@pytest.mark.parametrize("name", ["s03_candles_with_close", "s08_flatten_candles", "t18_price_life", "v32_pre_cutoff", "v33_book_devig"])
def test_first_print_of_a_second(spark, tied, name):
    d, con = tied
    assert compare(queries()[name](spark, d), con, oracle_sql()[name]) is None
