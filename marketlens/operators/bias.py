"""Bias forensics: longshots, attention, drift, post-elimination money."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import ordered
from marketlens.operators import temporal as T
from marketlens.operators.calibration import gap_series

HOUR = 3600
DAY = 86400
#: Fixed bucket edges in cents.
FLB_EDGES = [1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95, 100]
COARSE_EDGES = [0, 25, 45, 55, 75, 100]


def _n() -> Column:
    return F.count(F.lit(1))


def premium() -> Column:
    return F.col("yes_price_usd") * F.col("count_contracts")


def cents(p: str) -> Column:
    return F.round(F.col(p) * 100, 9)


def bucket_label(c: Column, edges: Sequence[int], left_closed: bool = True) -> Column:
    """``lo-hic`` label; right-closed buckets include the lowest edge."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        if left_closed:
            test = (c >= lo) & (c < hi)
        else:
            test = ((c >= lo) if i == 0 else (c > lo)) & (c <= hi)
        label = F.lit(f"{lo}-{hi}c")
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def price_before(m: DataFrame, t: DataFrame, lag_s: int = HOUR) -> DataFrame:
    """Market level: last price at least ``lag_s`` before settlement, count, staleness.

    ``m``: ticker, settle_ts, result and columns to keep. The cutoff is a residual of an equi join,
    and the aggregate combines map-side, so a hot market costs one partial row per task.
    """
    cut = m.select("ticker", (F.col("settle_ts") - lag_s).alias("__cut"))
    seen = t.join(cut, "ticker").where(F.col("created_ts") <= F.col("__cut"))
    g = seen.groupBy("ticker").agg(
        F.max_by("yes_price_usd", F.struct("created_ts", "trade_id")).alias("price"), F.max("created_ts").alias("used_ts"), _n().alias("n_before")
    )
    return m.join(g, "ticker").withColumn("stale_s", F.col("settle_ts") - F.col("used_ts")).withColumn("realized", F.when(F.col("result") == "yes", 1).otherwise(0))


def _in_range(ml: DataFrame) -> DataFrame:
    return ml.withColumn("price_c", cents("price")).where((F.col("price_c") >= 1) & (F.col("price_c") <= 99))


def flb_buckets(ml: DataFrame, edges: Sequence[int] = FLB_EDGES) -> DataFrame:
    """Five-cent buckets, left-closed, prices 1 to 99 cents (B02). ``ml``: price, realized, volume."""
    b = _in_range(ml).withColumn("bucket", bucket_label(F.col("price_c"), edges))
    g = b.groupBy("bucket").agg(
        _n().alias("n_markets"), F.sum("realized").alias("n_yes"), F.avg("price_c").alias("mean_price_c"), (F.avg("realized") * 100).alias("win_rate_pct"), F.sum("volume").alias("volume")
    )
    return g.withColumn("gap_pp", F.col("win_rate_pct") - F.col("mean_price_c"))


def flb_weighted(ml: DataFrame, edges: Sequence[int] = FLB_EDGES) -> DataFrame:
    """The same buckets weighted by volume."""
    b = _in_range(ml).withColumn("bucket", bucket_label(F.col("price_c"), edges))
    w = F.sum("volume")
    g = b.groupBy("bucket").agg(
        _n().alias("n_markets"),
        w.alias("volume"),
        (F.sum(F.col("price_c") * F.col("volume")) / w).alias("weighted_price_c"),
        (F.sum(F.col("realized") * F.col("volume")) / w * 100).alias("weighted_win_pct"),
    )
    return g.withColumn("gap_pp", F.col("weighted_win_pct") - F.col("weighted_price_c"))


def flb_bands(ml: DataFrame) -> DataFrame:
    """Low (<10c), mid (40-60c) and high (>=90c) bands."""
    p = F.col("price_c")
    band = F.when(p < 10, "low").when((p >= 40) & (p < 60), "mid").when(p >= 90, "high")
    return _in_range(ml).withColumn("band", band).where("band is not null").groupBy("band").agg(
        _n().alias("n"), F.avg("price_c").alias("mean_price_c"), (F.avg("realized") * 100).alias("win_rate_pct")
    )


def matched_level(ml: DataFrame, quotes: DataFrame, lag_s: int = HOUR) -> DataFrame:
    """Add the second venue's price at the same cutoff to the market level."""
    marks = ml.withColumn("__at", F.col("settle_ts") - lag_s)
    return T.value_at(marks, quotes, ["ticker"], "__at", "created_ts", "prob", "other_price", "quote_id").drop("__at")


def matched_buckets(ml: DataFrame, price: str, edges: Sequence[int] = COARSE_EDGES) -> DataFrame:
    """Coarse right-closed buckets of one venue's price."""
    ok = ml.where(F.col(price).isNotNull()).withColumn("__c", cents(price))
    g = ok.withColumn("bucket", bucket_label(F.col("__c"), edges, left_closed=False)).where("bucket is not null").groupBy("bucket").agg(
        _n().alias("n"), F.avg("__c").alias("mean_price_c"), (F.avg("realized") * 100).alias("win_rate_pct")
    )
    return g.withColumn("gap_pp", F.col("win_rate_pct") - F.col("mean_price_c"))


def matched_mae(ml: DataFrame) -> DataFrame:
    """Mean absolute error of both venues where both have a price."""
    return ml.where("other_price is not null").agg(
        _n().alias("n"), F.avg(F.abs(F.col("price") - F.col("realized"))).alias("mae_a"), F.avg(F.abs(F.col("other_price") - F.col("realized"))).alias("mae_b")
    )


def attention_premium(m: DataFrame, band: tuple[float, float], floor: float = 1.0) -> DataFrame:
    """Contracts per model point, peer-band flag, and the ratio to the median market.

    ``m``: ticker, volume, model_pct.
    """
    r = m.where(F.col("model_pct") > 0).withColumn("per_point", F.col("volume") / F.col("model_pct"))
    med = ordered.quantiles(r.where(F.col("model_pct") >= floor), [], "per_point", [0.5], ["m"]).scalar()
    return r.withColumn("peer", F.col("model_pct").between(*band)).withColumn("ratio_to_median", F.col("per_point") / med)


def gap_minutes(t: DataFrame, q: DataFrame, spans: DataFrame, step: int = 60) -> DataFrame:
    """Minute series of two prices with volume, dollars and gap (B07). ``spans``: ticker, lo, hi."""
    src = {"a": (t, "created_ts", "yes_price_usd", "trade_id"), "b": (q, "created_ts", "prob", "quote_id")}
    ser = gap_series(src, spans, "ticker", step, floor=0.0)
    flow = (
        t.join(spans.select("ticker", "lo", "hi"), "ticker")
        .where((F.col("created_ts") >= F.col("lo")) & (F.col("created_ts") <= F.col("hi")))
        .groupBy("ticker", T.floor_to(F.col("created_ts"), step).alias("bin_ts"))
        .agg(F.sum("count_contracts").alias("volume"), F.sum(premium()).alias("dollars"))
    )
    out = ser.join(flow, ["ticker", "bin_ts"], "left").na.fill(0.0, ["volume", "dollars"])
    return out.withColumn("minute", F.floor((F.col("bin_ts") - T.floor_to(F.col("lo"), step)) / step)).withColumn("gap_pp", F.col("gap") * 100)


def gap_weighted(series: DataFrame, key: str = "ticker") -> DataFrame:
    """Mean gap, dollar-weighted gap, and dollars traded while overpriced."""
    w = F.greatest(F.col("dollars"), F.lit(1e-9))
    g = series.groupBy(key).agg(
        _n().alias("n_minutes"),
        F.avg("gap_pp").alias("mean_gap_pp"),
        F.when(F.sum("dollars") > 0, F.sum(F.col("gap_pp") * w) / F.sum(w)).alias("weighted_gap_pp"),
        F.sum("dollars").alias("dollars"),
        F.coalesce(F.sum(F.when(F.col("gap_pp") > 0, F.col("dollars"))), F.lit(0.0)).alias("dollars_over"),
    )
    return g.withColumn("pct_over", F.when(F.col("dollars") > 0, F.col("dollars_over") / F.col("dollars") * 100))


def drift(shocks: DataFrame, t: DataFrame, hours: Sequence[int] = (0, 24, 48, 72)) -> DataFrame:
    """Price at fixed hours after a shock, the first pop and hours to exit.

    ``shocks``: ticker, shock_ts, exit_ts.
    """
    at = T.at_offsets(shocks, t, ["ticker"], "shock_ts", "created_ts", "yes_price_usd", [h * HOUR for h in hours], "trade_id")
    cols = [F.max(F.when(F.col("offset_s") == h * HOUR, F.col("price"))).alias(f"price_{h}h") for h in hours]
    g = at.groupBy("ticker", "shock_ts", "exit_ts").agg(*cols)
    a, b = f"price_{hours[0]}h", f"price_{hours[1]}h"
    return g.withColumn("pop_pp", (F.col(b) - F.col(a)) * 100).withColumn("hours_to_exit", (F.col("exit_ts") - F.col("shock_ts")) / HOUR)


def trajectory(shocks: DataFrame, t: DataFrame, lo_h: int = -24, hi_h: int = 96) -> DataFrame:
    """Hourly price around each shock."""
    offs = [h * HOUR for h in range(lo_h, hi_h + 1)]
    at = T.at_offsets(shocks, t, ["ticker"], "shock_ts", "created_ts", "yes_price_usd", offs, "trade_id")
    return at.select("ticker", "shock_ts", F.floor(F.col("offset_s") / HOUR).alias("hour"), "price")


def shock_baseline(shocks: DataFrame, t: DataFrame) -> DataFrame:
    """Median price of the day before a shock, of all earlier history when that day is empty."""
    pre = t.join(shocks.select("ticker", "shock_ts").distinct(), "ticker").where(F.col("created_ts") < F.col("shock_ts"))
    near = F.col("created_ts") >= F.col("shock_ts") - DAY
    # Counts per price level first: medians then read levels, not trades.
    lv = pre.groupBy("ticker", "shock_ts", "yes_price_usd").agg(F.count_if(near).alias("c_near"), _n().alias("c_all"))
    return lv.groupBy("ticker", "shock_ts").agg(
        F.coalesce(F.expr("percentile(yes_price_usd, 0.5D, c_near) FILTER (WHERE c_near > 0)"), F.expr("percentile(yes_price_usd, 0.5D, c_all)")).alias("baseline")
    )


def shock_multiples(shocks: DataFrame, t: DataFrame, before_h: int = 6, after_h: int = 72) -> DataFrame:
    """Hourly price as a multiple of the pre-shock baseline.

    Hours run from the first to the last traded hour of the window, filled forward.
    """
    win = t.join(shocks.select("ticker", "shock_ts").distinct(), "ticker").where(
        F.col("created_ts").between(F.col("shock_ts") - before_h * HOUR, F.col("shock_ts") + after_h * HOUR)
    )
    key = ["ticker", "shock_ts"]
    bars = T.resample_last(win, key, "created_ts", "trade_id", "yes_price_usd", HOUR, "price")
    spans = bars.groupBy(*key).agg(F.min("bin_ts").alias("lo"), F.max("bin_ts").alias("hi"))
    full = T.grid(spans, HOUR).drop("lo", "hi").join(bars, [*key, "bin_ts"], "left")
    filled = T.ffill(full, key, "bin_ts", "price")
    base = shock_baseline(shocks, t)
    return filled.join(base, key).withColumn("multiple", F.when(F.col("baseline") > 0, F.col("price") / F.col("baseline")))


def post_elimination_trades(elim: DataFrame, t: DataFrame) -> DataFrame:
    """Trades on a leg after its team was out and before it settled.

    ``elim``: ticker, elim_ts, settle_ts.
    """
    j = T.between_join(t, elim, ["ticker"], "created_ts", "elim_ts", "settle_ts")
    return j.withColumn("hours_after", (F.col("created_ts") - F.col("elim_ts")) / HOUR)


def post_elimination(elim: DataFrame, t: DataFrame) -> DataFrame:
    """Summary per eliminated leg; legs without such trades keep a zero row."""
    g = post_elimination_trades(elim, t).groupBy("ticker").agg(
        _n().alias("n_trades"),
        F.sum("count_contracts").alias("contracts"),
        F.sum(premium()).alias("dollars"),
        F.count_if(F.col("yes_price_usd") >= 0.01).alias("n_above_1c"),
        F.max("yes_price_usd").alias("max_price"),
        F.max("hours_after").alias("last_hours_after"),
    )
    out = elim.join(g, "ticker", "left").withColumn("lag_hours", (F.col("settle_ts") - F.col("elim_ts")) / HOUR)
    return out.na.fill(0, ["n_trades", "n_above_1c"]).na.fill(0.0, ["contracts", "dollars"])


def post_elimination_props(props: DataFrame, t: DataFrame) -> DataFrame:
    """The same over every prop market of the eliminated team.

    ``props``: team, ticker, elim_ts. Markets are totalled first, teams after.
    """
    j = t.join(props, "ticker").where(F.col("created_ts") > F.col("elim_ts"))
    above = F.col("yes_price_usd") >= 0.01
    per = j.groupBy("team", "ticker").agg(
        _n().alias("n"),
        F.sum("count_contracts").alias("c"),
        F.sum(premium()).alias("d"),
        F.count_if(above).alias("na"),
        F.coalesce(F.sum(F.when(above, premium())), F.lit(0.0)).alias("da"),
        F.max((F.col("created_ts") - F.col("elim_ts")) / HOUR).alias("h"),
    )
    g = per.groupBy("team").agg(
        F.sum("n").alias("n_trades"), _n().alias("n_markets_traded"), F.sum("c").alias("contracts"), F.sum("d").alias("dollars"), F.sum("na").alias("n_above_1c"), F.sum("da").alias("dollars_above_1c"), F.max("h").alias("max_hours_after")
    )
    n = props.groupBy("team").agg(_n().alias("n_prop_markets"))
    return n.join(g, "team", "left").na.fill(0, ["n_trades", "n_markets_traded", "n_above_1c"]).na.fill(0.0, ["contracts", "dollars", "dollars_above_1c"])


def daily_close(t: DataFrame) -> DataFrame:
    """Daily close and volume per leg."""
    return t.groupBy("ticker", F.floor(F.col("created_ts") / DAY).alias("day")).agg(
        F.max_by("yes_price_usd", F.struct("created_ts", "trade_id")).alias("close"), F.sum("count_contracts").alias("volume")
    )


def snapshot_per_unit(days: DataFrame, units: DataFrame, last_day: int) -> DataFrame:
    """Last known close up to a day and its cents per unit (B13). ``units``: ticker, units."""
    last = days.where(F.col("day") <= last_day).groupBy("ticker").agg(F.max("day").alias("day"), F.max_by("close", "day").alias("close"))
    return last.join(units, "ticker", "left").withColumn("cents_per_unit", F.when(F.col("units") > 0, F.col("close") * 100 / F.col("units")))


def ladder_share(ml: DataFrame, event: str, n: int = 10) -> DataFrame:
    """Share of cheap legs that sit in long ladders and at the tick floor.

    Ladder sizes come from an aggregate by (event, cents), so a giant ladder is combined map-side.
    """
    c = ml.withColumn("price_c", cents("price")).where((F.col("price_c") >= 1) & (F.col("price_c") < 10))
    tick = F.count_if(F.bround("price_c", 0).isin(1, 2))
    per = c.groupBy(event).agg(_n().alias("k"), tick.alias("ticks"))
    return per.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_cheap"), (F.sum(F.when(F.col("k") >= n, F.col("k")).otherwise(0)) / F.sum("k") * 100).alias("pct_long_ladder"), (F.sum("ticks") / F.sum("k") * 100).alias("pct_tick_floor")
    )


def worst_bucket(buckets: DataFrame, gap: str = "gap_pp") -> DataFrame:
    """Most overpriced bucket: the lowest win rate minus price."""
    return buckets.agg(F.min_by("bucket", F.struct(F.round(gap, 9), F.col("bucket"))).alias("bucket"), F.min(gap).alias("gap_pp"))


def shelf(ml: DataFrame, lo: float, hi: float) -> DataFrame:
    """One price shelf: size, claimed, realised, losers by family with shares."""
    on = ml.withColumn("price_c", cents("price")).where((F.col("price_c") >= lo) & (F.col("price_c") < hi))
    lost = F.col("realized") == 0
    g = on.groupBy("family").agg(_n().alias("n"), F.sum("price_c").alias("pc"), F.sum("realized").alias("wins"), F.count_if(lost).alias("losers"))
    total = on.agg(F.count_if(lost)).scalar()
    return g.select("family", "n", (F.col("pc") / F.col("n")).alias("claimed_pct"), (F.col("wins") / F.col("n") * 100).alias("realized_pct"), "losers", (F.col("losers") / total).alias("loser_share"))


def shelf_top_losers(ml: DataFrame, lo: float, hi: float, n: int = 10) -> DataFrame:
    """The largest losing markets of a shelf."""
    on = ml.withColumn("price_c", cents("price")).where((F.col("price_c") >= lo) & (F.col("price_c") < hi) & (F.col("realized") == 0))
    return on.orderBy(F.desc("volume"), "ticker").limit(n).select("ticker", "family", "price_c", "volume")


def excess_dollars(ml: DataFrame, edges: Sequence[int] = FLB_EDGES) -> DataFrame:
    """Dollars paid above outcome per bucket: sum of (price - outcome) * volume."""
    b = _in_range(ml).withColumn("bucket", bucket_label(F.col("price_c"), edges))
    return b.groupBy("bucket").agg(F.sum((F.col("price") - F.col("realized")) * F.col("volume")).alias("excess"), F.sum("volume").alias("volume"))


def pooled(buckets: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Count-weighted mean of a few buckets."""
    w = F.sum("n_markets")
    return buckets.where(F.col("bucket").isin(*labels)).agg(
        w.alias("n"), (F.sum(F.col("mean_price_c") * F.col("n_markets")) / w).alias("price_c"), (F.sum(F.col("win_rate_pct") * F.col("n_markets")) / w).alias("win_pct")
    )


def upper_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Element ``floor(n/2)`` of the sorted values: the upper middle, not interpolated."""
    lv = df.groupBy(*keys, F.col(value).alias("__x")).agg(_n().alias("__c"))
    tot = df.groupBy(*keys).agg(_n().alias("__n"))
    # NaN is above all numbers, so its chunk is the last one.
    chunk = F.when(F.isnan("__x"), F.lit(1 << 62)).otherwise(F.floor(F.col("__x") / 1000))
    run = ordered.running_sum(lv, keys, ["__x"], F.col("__c"), "__upto", chunk=chunk)
    hit = run.join(tot, list(keys)).where((F.col("__upto") > F.floor(F.col("__n") / 2)) & (F.col("__upto") - F.col("__c") <= F.floor(F.col("__n") / 2)))
    return hit.select(*keys, F.col("__x").alias(out))


def median_multiples(dots: DataFrame, anchor: str, lo_h: float, hi_h: float, n: int) -> DataFrame:
    """Binned upper-median of price over each key's own pre-anchor median, floored at 1 cent.

    ``dots``: team, birth_ts, price_band and the anchor column.
    """
    hrs = (F.col("birth_ts") - F.col(anchor)) / HOUR
    base = upper_median(dots.where(hrs < 0), ["team"], "price_band", "b").withColumn("b", F.greatest(F.lit(1), F.col("b")))
    span = hi_h - lo_h
    idx = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((hrs - lo_h) / span * n)))
    inside = dots.where((hrs >= lo_h) & (hrs <= hi_h)).join(base, "team").withColumn("bin", idx).withColumn("mult", F.col("price_band") / F.col("b"))
    return upper_median(inside, ["team", "bin"], "mult", "multiple").withColumn("hours", F.lit(lo_h) + (F.col("bin") + 0.5) * (span / n))
