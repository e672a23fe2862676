"""Documented fixtures of the market rules."""

import random
from functools import reduce

import pytest
from conftest import rows
from pyspark.sql import functions as F

from marketlens.operators import bias as B
from marketlens.operators import calibration as C
from marketlens.operators import entities as E
from marketlens.operators import micro as M
from marketlens.operators import quality as Q
from marketlens.operators import temporal as TT
from marketlens.operators import volume as V
from marketlens.sources import normalise as N

TRADE = "trade_id long, ticker long, created_ts long, yes_price_usd double, count_contracts double, taker_side string"


def tape(spark, prices, step=60, ticker=1, size=1.0, start=0):
    return spark.createDataFrame([(i, ticker, start + i * step, p, size, "yes") for i, p in enumerate(prices)], TRADE)


def test_grain_indices_skip_and_conserve(spark):
    t = spark.createDataFrame([(i, 1, i, 0.5, float(c), "yes") for i, c in enumerate([70, 10, 80, 300])], TRADE)
    got = V.grain_population(t, 75)
    assert rows(got, "bucket", "dollars") == [(0, 70.0), (1, 10.0), (2, 80.0), (6, 300.0)]
    inclusive = V.grain_population(t, 75, closing="inclusive")
    assert rows(inclusive, "bucket", "dollars") == [(0, 80.0), (1, 80.0), (2, 300.0)]
    assert V.grain_population(t, 500).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_grain_is_independent_of_layout(spark, parts):
    r = random.Random(1)
    t = spark.createDataFrame([(i, 0 if i % 3 else i % 7, r.randrange(50_000), 0.4, r.randrange(1, 9000) / 100, "no") for i in range(900)], TRADE)
    one = rows(V.grain_population(t.coalesce(1), 200, chunk_s=10**9))
    assert rows(V.grain_population(t.repartition(parts), 200, chunk_s=333)) == one


def test_glitch_exactly_one(spark):
    px = [3.40, 3.40, 1.416, 3.40, 3.39]
    at = [0, 100, 200.0, 202.3, 300]
    q = spark.createDataFrame([(i, 1, float(t), 1 / p) for i, (t, p) in enumerate(zip(at, px))], "id long, k long, ts double, x double")
    for preset, extra in (("reversion", {}), ("isolated", {"both_s": 150.0}), ("level", {})):
        g = Q.screen_glitches(q, ["k"], "ts", "id", "x", preset, **extra)
        assert [r[0] for r in rows(g.where("is_glitch"), "id")] == [2], preset


def _match(spark, moves):
    """Three legs over an hour; ``moves`` maps minute to a jump of team1, taken from the tie."""
    out, n = [], 0
    a, c = 0.3, 0.4
    for m in range(60):
        a, c = a + moves.get(m, 0), c - moves.get(m, 0)
        for tick, p in ((1, a), (2, 0.3), (3, c)):
            out.append((n, tick, m * 60 + 5, round(p, 4), 1.0, "yes"))
            n += 1
    t = spark.createDataFrame(out, TRADE)
    legs = spark.createDataFrame([(9, leg, k, 0, 3540) for leg, k in (("team1", 1), ("team2", 2), ("tie", 3))], "match_id long, leg string, ticker long, lo long, hi long")
    return M.leg_series(t, legs)


def test_flat_match_has_no_event(spark):
    assert M.peaks(M.total_variation(_match(spark, {}))).count() == 0


@pytest.mark.parametrize("second,want", [(22, [20, 40]), (24, [20, 24, 40])])
def test_peak_separation(spark, second, want):
    s = _match(spark, {20: 0.20, second: 0.15, 40: -0.20})
    ev = M.primary_leg(M.peaks(M.total_variation(s)), s)
    assert [r[0] // 60 for r in rows(ev, "event_ts")] == want
    assert {r[0] for r in rows(ev.where("event_ts = 1200"), "direction")} == {"up"}


def test_peaks_against_brute_force(spark):
    r = random.Random(5)
    tv = [(m, b * 60, round(r.random(), 3)) for m in range(6) for b in range(200)]
    got = rows(M.peaks(spark.createDataFrame(tv, "match_id long, bin_ts long, tv double"), mult=0.5), "match_id", "event_ts")
    want = []
    for m in range(6):
        mine = [(b, x) for k, b, x in tv if k == m]
        med = lambda xs: (sorted(xs)[99] + sorted(xs)[100]) / 2
        c = med([x for _, x in mine])
        th = max(0.08, c + 0.5 * 1.4826 * med([abs(x - c) for _, x in mine]))
        taken = []
        for b, x in sorted(mine, key=lambda p: (-p[1], p[0])):
            if x >= th and all(abs(b - o) >= 240 for o in taken):
                taken.append(b)
        want += [(m, b) for b in taken]
    assert got == sorted(want)


def test_turning_points_against_walk(spark):
    r = random.Random(11)
    prices = {k: [r.randrange(1, 99) / 100 for _ in range(300)] for k in (1, 2)}
    t = reduce(lambda a, b: a.unionByName(b), [tape(spark, p, ticker=k) for k, p in prices.items()])
    for block in (17, 100_000):
        got = dict(rows(M.turning_points(t, block=block), "ticker", "n_turns"))
        for k, p in prices.items():
            s = [sorted(p[max(0, i - 2) : i + 3]) for i in range(len(p))]
            s = [(x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2 for x in s]
            turns, last, ext = 0, 0, s[0]
            for a, b in zip(s, s[1:]):
                d = (b > a) - (b < a)
                if d == 0:
                    continue
                if last and d != last and round(abs(b - ext), 9) > 0.05:
                    turns, ext = turns + 1, b
                if not last:
                    ext = b
                last = d
            assert got[k] == turns


def test_episode_length(spark):
    rows_ = [(leg, m * 60, 0.60, 0.55 if m < n else 0.60, 1) for leg, n in ((1, 29), (2, 30), (3, 31)) for m in range(60)]
    s = spark.createDataFrame(rows_, "leg long, bin_ts long, a double, b double, outcome int").withColumn("gap", F.round(F.col("a") - F.col("b"), 9))
    assert rows(C.episodes(s, "leg"), "leg", "steps", "closer") == [(2, 30, "a"), (3, 31, "a")]


def test_devig_sums_to_one(spark):
    q = [(1, 1, 1, 0, 1000, 2.20), (2, 1, 1, 1, 1000, 3.40), (3, 1, 1, 2, 1000, 3.60), (4, 1, 1, 0, 2000, 2.05), (5, 1, 1, 2, 2000, 3.80)]
    df = spark.createDataFrame([(*x, True) for x in q], "quote_id long, f long, bk long, o long, created_ms long, price_decimal double, active boolean")
    out = {r["quote_id"]: r for r in C.devig_async(df, ["f", "bk"], "o").collect()}
    assert abs(sum(out[i]["prob_devig"] for i in (1, 2, 3)) - 1) < 1e-12
    assert out[4]["overround_at_ts"] > 1 and out[4]["prob_devig"] > out[2]["prob_devig"]


def test_devig_loses_no_quote(spark):
    q = [
        (1, None, "b", "h", 1000, 2.0, True), (2, None, "b", None, 1000, 4.0, True), (3, "f", None, "h", 1000, 0.0, True), (4, "f", None, "a", 2000, 2.0, True),
        (5, "f", None, "h", None, 2.0, True), (6, "f", None, "h", 3000, -1.0, True), (7, "f", "", "h", 3000, 5.0, None), (8, "", "b", "h", 1000, 8.0, True),
    ]
    df = spark.createDataFrame(q, "quote_id long, f string, bk string, o string, created_ms long, price_decimal double, active boolean")
    out = C.devig_async(df, ["f", "bk"], "o")
    assert out.columns == [*df.columns, "overround_at_ts", "prob_devig"]
    got = {r["quote_id"]: (r["overround_at_ts"], r["prob_devig"]) for r in out.collect()}
    assert got[1] == (0.75, pytest.approx(2 / 3)) and got[2] == (0.75, pytest.approx(1 / 3)) and got[8] == (0.125, 1.0)
    assert got[3] == (0.0, None) and got[4] == (0.5, 1.0) and got[5] == (None, None) and got[6] == (0.5, None) and got[7] == (0.0, None)


def test_window_sums_with_overlaps_and_a_hot_market(spark):
    import random

    r = random.Random(8)
    trades = [(k, "hot" if k % 3 == 0 else f"m{k % 7}", 1_700_000_000 + r.randrange(400_000), r.randrange(1, 10_000) / 100) for k in range(900)]
    spans = []
    for k in range(300):
        a = 1_700_000_000 + r.randrange(-5_000, 400_000)
        spans.append((k, r.choice(["hot", "hot", "m1", "m2", "none"]), a, a + r.choice([0, 50, 9_000, 300_000])))
    spans += [spans[0], (900, "hot", None, 1_700_000_500), (901, None, 1_700_000_000, 1_700_400_000)]
    t = spark.createDataFrame(trades, "trade_id long, ticker string, created_ts long, count_contracts double")
    w = spark.createDataFrame(spans, "event long, ticker string, win_start long, win_end long")
    got = {x["event"]: x for x in V.window_sums(t, w, ["ticker"]).collect()}
    assert len(got) == 302 and got[900]["n_trades"] is None and (got[901]["contracts"], got[901]["n_trades"]) == (0, 0)
    for e, m, a, b in spans[:300]:
        inside = [c for _, k, at, c in trades if k == m and a <= at <= b]
        assert got[e]["n_trades"] == len(inside) and got[e]["contracts"] == pytest.approx(sum(inside), abs=1e-6)
    split = {x["in_window"]: x["n_trades"] for x in V.window_split(t, w.where("event < 300"), ["ticker"]).collect()}
    covered = sum(any(m == k and a <= at <= b for _, m, a, b in spans[:300]) for _, k, at, _ in trades)
    assert split == {True: covered, False: 900 - covered}


def test_lower_half_among_equals(spark):
    rows_ = [(k, 5.0) for k in range(0, 60_000, 7)] + [(-k, float(k)) for k in range(1, 40)]
    df = spark.createDataFrame(rows_, "ticker long, dollars double")
    got = {x["ticker"]: (x["rank"], x["in_lower_half"]) for x in V.lower_half(df).collect()}
    want = [t for t, _ in sorted(rows_, key=lambda x: (x[1], x[0]))]
    assert got == {t: (i + 1, i + 1 <= len(want) // 2) for i, t in enumerate(want)}


def test_tails_and_pins(spark):
    late_dip = [0.5, 0.98, 0.99, 0.9, 0.99, 0.99]
    t = tape(spark, late_dip).unionByName(tape(spark, [0.5, 0.4, 0.6, 0.5, 0.4], ticker=2)).unionByName(tape(spark, [0.98] * 6, ticker=3))
    m = spark.createDataFrame([(1, "yes"), (2, "yes"), (3, "yes")], "ticker long, result string")
    assert rows(M.settlement_tail(t, m), "ticker", "n_pre", "n_tail", "tail_s") == [(1, 4, 2, 60)]
    assert rows(M.pin_high(t), "ticker", "pin_ts") == [(1, 240)]
    low = tape(spark, [0.5, 0.02, 0.01, 0.01])
    assert rows(M.pin_low(low), "pin_ts") == [(120,)]


def test_buckets(spark):
    ml = spark.createDataFrame([(p / 100, 1, 1.0) for p in (0.99, 1, 4.999, 5, 95, 99, 99.5)], "price double, realized int, volume double")
    assert rows(B.flb_buckets(ml), "bucket", "n_markets") == [("1-5c", 2), ("5-10c", 1), ("95-100c", 2)]


def test_names_and_empty_events(spark):
    a = spark.createDataFrame([("Congo DR",), ("United States",), ("Nowhere",)], "a string")
    b = spark.createDataFrame([("DR Congo",), ("USA",)], "b string")
    al = spark.createDataFrame([("united states", "usa")], "name string, alias string")
    assert dict(rows(E.norm_name_join(a, b, "a", "b", al), "a", "b")) == {"Congo DR": "DR Congo", "United States": "USA", "Nowhere": None}
    raw = spark.createDataFrame([('{"id":"1","slug":"x","markets":[]}',), ('{"id":"2","slug":"y"}',)], "body string")
    assert rows(N.flatten_events(raw), "event_id", "market_id", "n_tokens") == [("1", None, 0), ("2", None, 0)]


def test_year_only_dates(spark):
    f = ["1959", "00", "00", "AA", "BB", "2", "1", "F", "", "10", "1500", "1490", "", "", "7", "9"]
    raw = spark.createDataFrame([("\t".join(f), "BB"), ("short\tline", "BB")], "value string, team_code string")
    codes = spark.createDataFrame([("AA", "Aland")], "code string, name string")
    got = rows(N.normalise_history(raw, codes), "date_precision", "match_epoch_utc", "opponent", "result", "rating_change")
    assert got == [("year_only", -347155200, "Aland", "L", -10.0)]


def test_lead_lag(spark):
    r = random.Random(2)
    x = [r.uniform(-1, 1) for _ in range(80)]
    a = spark.createDataFrame([(1, i * 60, v) for i, v in enumerate(x)], "match_id long, bin_ts long, ret double")
    b = spark.createDataFrame([(1, i * 60, x[i - 2] if i >= 2 else 0.01 * i) for i in range(80)], "match_id long, bin_ts long, ret double")
    assert rows(M.lead_lag(a, b), "best_lag", "leader") == [(2, "a")]


def test_json_paths(spark):
    d = spark.createDataFrame([(1, '{"a":{"b":[{"x":1}]}}'), (2, '{"a":{"b":[]}}'), (3, "{nope")], "id long, body string")
    got = rows(Q.paths_present(d, "id", "body", [("a.b", "rows:x"), ("a", "value")]), "id", "path", "verdict")
    assert got == [(1, "a", "ok"), (1, "a.b", "ok"), (2, "a", "ok"), (2, "a.b", "empty_list"), (3, "a", "bad_json"), (3, "a.b", "bad_json")]


def test_steps_and_spike(spark):
    up = [0.30] * 40 + [0.50] * 40
    t = tape(spark, up, step=2)
    assert rows(M.steps(t), "step_ts", "before", "after") == [(80, 0.3, 0.5)]
    bump = [0.30] * 30 + [0.60] * 5 + [0.31] * 30
    spans = spark.createDataFrame([(1, 0, 10_000)], "ticker long, lo long, hi long")
    assert rows(M.spike(tape(spark, bump, step=5), spans), "onset_ts", "peak_ts", "peak_c", "resolved_ts") == [(150, 150, 60.0, 175)]


def test_entities_as_the_standard_library(spark):
    import html

    from marketlens.functions import text as tx

    odd = ["Caf&#233; &hearts; &copy; &amp;lt; &#x2019;s &#150; &#0; &#xD800; &#99999999; &nosuch; &amp &copyx & && &", "plain", "", "&notin; &notit; &ampamp;", "&#x1F600;&eacute;&Eacute;&le;a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i long, t string")
    assert rows(df.select("i", tx.decode_entities(F.col("t")).alias("d"))) == [(i, html.unescape(t)) for i, t in enumerate(odd)]
    page = "<p>a<!-- no\n <b>x</b> --> b</p><SCRIPT type='x'>var t='</p>';\n</script ><style>p{}</style> c&eacute;"
    assert rows(spark.createDataFrame([(page,)], "t string").select(tx.strip_markup(F.col("t")).alias("d"))) == [("a b c\u00e9",)]


def test_exact_family_comes_before_keywords(spark):
    from marketlens.operators import entities as E

    df = spark.createDataFrame([("KXWCGAME",), ("KXWCGAMESPREAD",), ("KXOCUSA",), ("KXNONE",)], "t string")
    assert rows(E.classify(df, "t", exact={"KXWCGAME": "winner"})) == [("KXNONE", "other"), ("KXOCUSA", "off_pitch"), ("KXWCGAME", "winner"), ("KXWCGAMESPREAD", "per_match")]


def test_events_keep_every_field(spark):
    body = (
        '{"id": "1", "slug": "a-2026-07-01", "negRisk": true, "volume": "2.5", "createdAt": "2026-01-01T00:00:00Z", "markets": '
        '[{"id": "9", "outcomes": "[\\"Yes\\", \\"No\\"]", "volume1wk": "3", "closedTime": "2026-01-02T00:00:00Z", "active": true}]}'
    )
    got = N.flatten_events(spark.createDataFrame([(body,), ('{"id": "2"}',)], "body string"))
    assert len(got.columns) == len(N.EVENT_FIELDS) + len(N.MARKET_FIELDS) + 2
    cols = ("event_id", "event_neg_risk", "event_volume", "event_created_at_ts", "outcomes_json", "volume_1wk", "closed_time_ts", "active", "closed", "n_tokens")
    assert rows(got, *cols) == [("1", True, 2.5, 1767225600, '["Yes","No"]', 3.0, 1767312000, True, False, 0), ("2", False, None, None, None, None, None, None, None, 0)]


def test_bars_are_shuffled_once_or_not_at_all(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    a = spark.createDataFrame([(1, 0, 0.1)], "match_id long, bin_ts long, ret double")
    assert "Generate" not in plan(M.lead_lag(a, a)) and "Join" not in plan(M.lead_lag(a, a))
    # No join of the dense marks: those that are left are on the ticker.
    assert not [x for x in plan(_match(spark, {20: 0.2})).splitlines() if "Join" in x and "bin_ts" in x]


def test_team_props_of_one_team_are_dealt(spark):
    """One event key: its markets meet its eliminations in several tasks, nulls and repeated rows included."""
    elim = spark.createDataFrame([("N01", i) for i in range(40)] + [("N01", 7), ("N01", None), ("N02", 1)], "loser string, elim_ts long")
    m = spark.createDataFrame([("A-24N01", i) for i in range(60)] + [("A-24N01", 5), ("B-24N02", 1)], "event_ticker string, ticker long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = E.team_props(elim, ["A"], m, "24").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = [("N01", t, e) for t in [*range(60), 5] for e in [*range(40), 7, None]]
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2])
    assert sorted(((r["team"], r["ticker"], r["elim_ts"]) for r in got), key=key) == sorted(want, key=key)
    assert len({r["task"] for r in got}) > 1


def test_team_props_repeat_at_short_range(spark, tmp_path):
    """A team's eliminations are written list by list, so a file of all pairs takes far less than a byte a row."""
    elim = spark.range(20_000).select(F.format_string("N%02d", F.col("id") % 1 + 1).alias("loser"), F.col("id").alias("elim_ts"))
    m = spark.range(640).select(F.format_string("A-24N%02d", F.col("id") % 1 + 1).alias("event_ticker"), F.col("id").alias("ticker"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        E.team_props(elim, ["A"], m, "24").write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 20_000 * 640 == out.distinct().count()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 20_000 * 640


def _written_after_the_last_shuffle(spark, df):
    """True if marks are written out above every exchange of the plan."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return "Generate" in plan and plan.rindex("Generate") < plan.index("Exchange")


def _grid_input(spark):
    """Ticks before, on and between marks, two in one second, one without a price; a market without ticks."""
    ticks = [(1, 1, 5, 0.1), (2, 1, 60, 0.2), (3, 1, 61, 0.3), (4, 1, 61, 0.4), (5, 1, 170, None), (6, 1, 400, 0.6), (7, 2, 900, 0.7)]
    t = spark.createDataFrame(ticks, "trade_id long, ticker long, created_ts long, yes_price_usd double")
    return ticks, t, spark.createDataFrame([(1, 30, 420), (2, 0, 100), (3, 0, 60)], "ticker long, lo long, hi long")


def test_on_grid_orders_ticks_not_marks(spark):
    ticks, t, spans = _grid_input(spark)
    run = lambda: TT.on_grid(t, spans, ["ticker"], "created_ts", "trade_id", "yes_price_usd", 60, "price")
    want = []
    for k, lo, hi in [(1, 30, 420), (2, 0, 100), (3, 0, 60)]:
        for at in range(lo // 60 * 60, hi + 1, 60):
            seen = [(ts, i, p) for i, tk, ts, p in ticks if tk == k and ts <= at]
            want.append((k, at, max(seen, key=lambda r: r[:2])[2] if seen else None))
    assert rows(run(), "ticker", "bin_ts", "price") == sorted(want, key=lambda r: r[:2])
    assert _written_after_the_last_shuffle(spark, run)


def test_braid_and_its_runs_agree(spark):
    """One row for equal marks: no mark is shuffled for the summary, and it equals that of the marks."""
    _, t, spans = _grid_input(spark)
    q = spark.createDataFrame([(1, 1, 100, 0.5), (2, 1, 200, 0.4), (3, 2, 60, 0.9)], "trade_id long, ticker long, created_ts long, yes_price_usd double")
    how = ("created_ts", "yes_price_usd", "trade_id")
    src = {"m": (t, *how), "s": (t.where("trade_id % 2 = 0"), *how), "q": (q, *how)}
    marks, runs = M.braid(spans, src, "q", 60).collect(), M.braid_runs(spans, src, "q", 60)
    assert len(marks) == 7 + 2 + 1 == runs.agg(F.sum("n_bins")).first()[0] and runs.count() < len(marks)
    at = {(r["ticker"], r["bin_ts"]): (r["m"], r["s"], r["q"], r["terminated_at"]) for r in marks}
    assert at[1, 0] == (0.2, 0.2, None, 200) and at[1, 120] == (0.4, 0.4, 0.5, 200) and at[1, 180] == (0.2, 0.4, 0.5, 200)
    assert at[1, 240][2] is None and at[2, 60] == (None, None, 0.9, 60) and at[3, 0] == (None, None, None, None)
    gaps = [abs(m - q) for m, s, q, _ in at.values() if m is not None and q is not None]
    got = M.braid_summary(runs, "m", "q").first()
    assert got["n_legs"] == 3 and got["n_terminated"] == 2 and abs(got["mean_abs_gap_pp"] - 100 * sum(gaps) / len(gaps)) < 1e-9


def test_gap_runs_give_the_episodes_of_the_series(spark):
    """Episodes of runs equal those of single marks, and the series is written out after the last shuffle."""
    a = spark.createDataFrame([(i, 1, i * 600, 0.5 + (i % 4) / 10) for i in range(12)], "trade_id long, ticker long, created_ts long, yes_price_usd double")
    b = spark.createDataFrame([(i, 1, 30 + i * 900, 0.4 + (i % 3) / 10) for i in range(8)], a.schema)
    spans = spark.createDataFrame([(1, 1, 0, 8000)], "ticker long, outcome int, lo long, hi long")
    how = ("created_ts", "yes_price_usd", "trade_id")
    series = lambda: C.gap_series({"a": (a, *how), "b": (b, *how)}, spans, "ticker", 60)
    runs = C.gap_runs({"a": (a, *how), "b": (b, *how)}, spans, "ticker", 60)
    cols = ("start_ts", "end_ts", "steps", "closer")
    assert rows(C.episodes(runs, "ticker", min_steps=2), *cols) == rows(C.episodes(series(), "ticker", min_steps=2), *cols) != []
    assert _written_after_the_last_shuffle(spark, series)


def test_cliffs_sort_a_market_once(spark):
    """Noise without the two largest moves, the earlier of equal ones first; the plan joins nothing after the medians."""
    levels = [50, 52, 49, 80, 50, 51, 20, 21, 60, 20, 20, 70, 5]
    t = tape(spark, [c / 100 for c in levels])
    moves = sorted(((b - a, i) for i, (a, b) in enumerate(zip(levels, levels[1:]), 1)), key=lambda m: (-abs(m[0]), m[1]))[2:]
    mean = sum(m for m, _ in moves) / len(moves)
    th = max(3.0, (sum((m - mean) ** 2 for m, _ in moves) / len(moves)) ** 0.5)
    drops = {i: levels[i - 1] - levels[i + 1] for i in range(1, len(levels) - 1)}
    first = min(i for i, x in drops.items() if x > th)
    later = [(x, -i) for i, x in drops.items() if i >= first + 2 and x > 0]
    got = M.cliffs(t, 60, mult=1.0, skip=2)
    row = got.first()
    assert abs(row["threshold_c"] - th) < 1e-9 and row["first_bar"] == first
    assert row["second_bar"] == (-max(later)[1] if max(later)[0] >= th else None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_turning_points_are_walked_in_a_given_number_of_tasks(spark):
    """Each group costs a Python call whatever its bytes, so tasks are not coalesced by size; no sorted map per row for the medians."""
    plan = M.turning_points(tape(spark, [0.1, 0.5, 0.2]))._jdf.queryExecution().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "percentile" not in plan
