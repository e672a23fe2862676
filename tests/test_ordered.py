"""Chunked ordered functions equal the plain window, with a hot key, ties and nulls."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions import ordered as O

ORDER = ["ts", "id"]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(7)
    out = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{r.randrange(12)}"
        out.append((key, r.randrange(0, 5000) // 7 * 7, i, r.randrange(100) if r.random() < 0.6 else None))
    return spark.createDataFrame(out, "k string, ts long, id long, v long").repartition(5)


def plain():
    return W.partitionBy("k").orderBy(*ORDER)


@pytest.mark.parametrize("width", [1, 60, 1000, 10**9])
def test_against_plain_windows(data, width):
    c = O.time_chunk("ts", width)
    up = plain().rowsBetween(W.unboundedPreceding, 0)
    down = plain().rowsBetween(0, W.unboundedFollowing)
    v = F.col("v")
    cases = [
        (O.running_sum(data, ["k"], ORDER, F.coalesce(v, F.lit(0)), "o", c), F.sum(F.coalesce(v, F.lit(0))).over(up)),
        (O.row_number(data, ["k"], ORDER, "o", c), F.row_number().over(plain()).cast("long")),
        (O.running_max(data, ["k"], ORDER, v, "o", c), F.max(v).over(up)),
        (O.running_max(data, ["k"], ORDER, v, "o", c, before=True), F.max(v).over(plain().rowsBetween(W.unboundedPreceding, -1))),
        (O.last_known(data, ["k"], ORDER, v, "o", c), F.last(v, ignorenulls=True).over(up)),
        (O.previous(data, ["k"], ORDER, v, "o", c), F.lag(v).over(plain())),
        (O.following(data, ["k"], ORDER, v, "o", c), F.lead(v).over(plain())),
    ]
    for got, want in cases:
        assert rows(got, "id", "o") == rows(data.withColumn("o", want), "id", "o")
    got = O.neighbours(data, ["k"], ORDER, v, "p", "n", c)
    want = data.withColumn("p", F.lag(v).over(plain())).withColumn("n", F.lead(v).over(plain()))
    assert rows(got, "id", "p", "n") == rows(want, "id", "p", "n")
    got = O.known_around(data, ["k"], ORDER, v, "p", "n", c)
    want = data.withColumn("p", F.last(v, ignorenulls=True).over(up)).withColumn("n", F.first(v, ignorenulls=True).over(down))
    assert rows(got, "id", "p", "n") == rows(want, "id", "p", "n")


def test_no_key_is_a_global_order(data):
    got = O.row_number(data, [], ORDER, "o", O.time_chunk("ts", 50))
    assert [r[1] for r in rows(got, "ts", "o")] and sorted(r[0] for r in rows(got, "o")) == list(range(1, 601))


@pytest.mark.parametrize("block", [3, 10, 10_000])
def test_framed(data, block):
    num = O.row_number(data, ["k"], ORDER, "pos")
    got = O.framed(num, ["k"], "pos", {"a": ("sum(id)", -2, 2), "b": ("max(id)", -5, -1), "c": ("count(1)", 0, 4)}, block)
    w = plain()
    want = (
        data.withColumn("a", F.sum("id").over(w.rowsBetween(-2, 2)))
        .withColumn("b", F.max("id").over(w.rowsBetween(-5, -1)))
        .withColumn("c", F.count(F.lit(1)).over(w.rowsBetween(0, 4)))
    )
    assert rows(got, "id", "a", "b", "c") == rows(want, "id", "a", "b", "c")


def test_quantiles(data):
    got = O.quantiles(data, ["k"], "v", [0.25, 0.5], ["q1", "q2"])
    want = data.groupBy("k").agg(F.percentile("v", 0.25).alias("q1"), F.median("v").alias("q2"))
    assert rows(got, "k", "q1", "q2") == rows(want, "k", "q1", "q2")


def test_null_keys_keep_their_carry(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 5000, 1), (None, 9000, 1), ("a", 1, 1)], "k string, ts long, x long")
    got = O.running_sum(df, ["k"], ["ts"], F.col("x"), "n")
    assert rows(got.where("k IS NULL"), "ts", "n") == [(1, 1), (5000, 2), (9000, 3)]


@pytest.mark.parametrize("kind,values", [("long", [None, 0, 1, -5]), ("string", [None, "", "=", "a"]), ("double", [None, 0.0, 1.5, -2.0]), ("boolean", [None, True, False]), ("date", None)])
def test_null_keys_are_not_their_filler(spark, kind, values):
    """A null key is apart from the value that fills it; rows without a time come first."""
    import datetime

    values = values or [None, datetime.date(1970, 1, 1), datetime.date(2024, 5, 6)]
    data = [(values[i % len(values)], None if i % 11 == 0 else (i * 7919) % 20_000, i) for i in range(200)]
    df = spark.createDataFrame(data, f"k {kind}, ts long, id long")
    w = W.partitionBy("k").orderBy("ts", "id")
    for got, want in [
        (O.row_number(df, ["k"], ORDER, "o"), F.row_number().over(w).cast("long")),
        (O.previous(df, ["k"], ORDER, F.col("id"), "o"), F.lag("id").over(w)),
    ]:
        assert got.columns == ["k", "ts", "id", "o"] and got.schema["k"] == df.schema["k"]
        assert rows(got, "id", "o") == rows(df.withColumn("o", want), "id", "o")


def test_rows_shuffle_once(spark, data):
    """Four exchanges without broadcast: the rows' own, and three of the summary; join and window share the first."""
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, x in keys.items():
        spark.conf.set(k, x)
    try:
        got = O.running_sum(data, ["k"], ORDER, F.col("id"), "o")
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert plan.count("Exchange hashpartitioning") <= 4
