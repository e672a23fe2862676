"""Queries on text tickers and trade ids give the rows that they give on numbers."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from __spark_entry__ import queries
from marketlens.operators import temporal as T
from marketlens.plans import views as v

SF = "/root/testdata/sf0.001"
IDS = ("ticker", "trade_id", "quote_id", "row_id", "src_tie")
NAMES = [
    "c02_horizon_panel", "c07_divergence_episodes", "c08_gap_summary", "b07_gap_minutes", "m09_turning_points", "m12_breaks", "m22_braid", "m23_braid_live", "v26_rate_step", "b10_shock_multiples", "m28_friction_band",
]


def as_text(df):
    return df.withColumns({c: F.concat(F.lit("KX-"), F.lpad(F.col(c).cast("string"), 12, "0")) for c in df.columns if c in IDS})


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, monkeypatch, name):
    run = queries()[name]
    want = rows(as_text(run(spark, SF)))
    own = {n: getattr(v, n) for n in ("tape", "quotes", "markets")}

    def texts(n):
        def view(s, d):
            with monkeypatch.context() as m:
                m.setattr(v, "tape", own["tape"])
                return as_text(own[n](s, d))

        return view

    for n in own:
        monkeypatch.setattr(v, n, texts(n))
    got = run(spark, SF)
    assert dict(got.dtypes)["ticker"] == "string" if "ticker" in got.columns else True
    assert rows(got) == want and want


def test_forward_asof_with_text_ties(spark):
    left = spark.createDataFrame([("a", 5)], "k string, ts long")
    right = spark.createDataFrame([("a", 7, "t9", 0.9), ("a", 7, "t1", 0.1), ("a", 8, "t0", 0.5)], "k string, ts long, id string, p double")
    assert rows(T.asof(left, right, ["k"], "ts", "ts", {"p": "p"}, "id", forward=True), "p") == [(0.1,)]
