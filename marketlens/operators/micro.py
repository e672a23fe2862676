"""In-game microstructure: events, reactions, tails, detectors.

Bar-level steps use plain key windows: a key has at most span / step bars, whatever its trade
count. Tick-level steps use aggregates or the chunked windows of ``functions.ordered``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions import ordered
from marketlens.operators import temporal as T
from marketlens.operators.calibration import stack_sources
from marketlens.session import cut

MINUTE = 60
#: Fixed values of the detectors.
TV_FLOOR = 0.08
MAD_SCALE = 1.4826
MAD_MULT = 4.0
LEG_ORDER = ("team1", "team2", "tie")
TAIL_HIGH, TAIL_LOW = (0.97, 1.01), (-0.01, 0.03)
EXTREME_HIGH, EXTREME_LOW = (0.985, 1.0), (0.0, 0.015)


def _n() -> Column:
    return F.count(F.lit(1))


def _r(c: Column, nd: int = 9) -> Column:
    """Prices are whole cents: rounding removes float dust before a comparison."""
    return F.round(c, nd)


# ------------------------------------------------------------------ events


def leg_series(t: DataFrame, legs: DataFrame, step: int = MINUTE) -> DataFrame:
    """Dense filled bars of every leg inside its match span.

    ``legs``: match_id, leg, ticker, lo, hi. Adds ``price`` (last value, filled forward inside the
    span) and ``diff`` to the previous bar.
    """
    inside = t.join(legs.select("ticker", "lo", "hi"), "ticker")
    bar = T.floor_to(F.col("created_ts"), step)
    first, top = T.floor_to(F.col("lo"), step), T.floor_to(F.col("hi") + step - 1, step)
    inside = inside.where((bar >= first) & (bar <= top))
    bars = T.resample_last(inside, ["ticker"], "created_ts", "trade_id", "yes_price_usd", step, "price")
    # Bars with a trade are ordered before the fill; each then repeats itself up to the next one, so no dense row is joined or sorted.
    w = W.partitionBy("ticker").orderBy("bin_ts")
    runs = bars.select("ticker", F.col("bin_ts").alias("__at"), F.lead("bin_ts").over(w).alias("__next"), "price", F.lag("price").over(w).alias("__before"))
    heads = bars.groupBy("ticker").agg(F.min("bin_ts").alias("__next"))
    traded = legs.join(runs, "ticker").withColumn("__from", F.col("__at"))
    ahead = legs.join(heads, "ticker", "left").withColumn("__from", first)
    both = traded.unionByName(ahead, allowMissingColumns=True).withColumn("__to", F.coalesce(F.col("__next") - step, top)).where("__from <= __to")
    diff = F.when(F.col("bin_ts") == F.col("__at"), _r(F.col("price") - F.col("__before"))).when(F.col("price").isNotNull(), F.lit(0.0))
    return T.grid(both, step, "__from", "__to").select(*legs.columns, "bin_ts", "price", diff.alias("diff"))


def total_variation(series: DataFrame, step: int = MINUTE) -> DataFrame:
    """Half the summed absolute leg moves per bar, for matches whose three legs all traded.

    Only the moves are shuffled; the still bars between them are written out afterwards, ``step`` apart.
    """
    span = series.groupBy("match_id").agg(
        F.min("bin_ts").alias("bin_ts"), F.max("bin_ts").alias("__hi"), F.count_distinct(F.when(F.col("price").isNotNull(), F.col("leg"))).alias("k")
    )
    # One row per match, and below one per move: small beside the bars, and read by several later branches.
    span = cut(span.where("k = 3"))
    moves = series.where("diff <> 0").select("match_id", "bin_ts", F.abs("diff").alias("m"))
    per = moves.unionByName(span.select("match_id", "bin_ts", F.lit(0.0).alias("m"))).groupBy("match_id", "bin_ts").agg(_r(F.sum("m") / 2).alias("tv"))
    nxt = F.lead("bin_ts").over(W.partitionBy("match_id").orderBy("bin_ts"))
    runs = per.select("match_id", F.col("bin_ts").alias("__at"), "tv", nxt.alias("__next")).join(span.select("match_id", "__hi"), "match_id")
    runs = cut(runs.withColumn("__to", F.coalesce(F.col("__next") - step, F.col("__hi"))))
    return T.grid(runs, step, "__at", "__to").select("match_id", "bin_ts", F.when(F.col("bin_ts") == F.col("__at"), F.col("tv")).otherwise(0.0).alias("tv"))


def peak_threshold(tv: DataFrame, floor: float = TV_FLOOR, mult: float = MAD_MULT, least: float | None = None) -> DataFrame:
    """Attach max(floor, median + mult * scaled MAD) of the match to each bar (M02); bars under ``least`` are left out.

    Both medians come from counts per distinct value, as most bars of a match stand still.
    """
    lv = tv.groupBy("match_id", "tv").agg(_n().alias("c"))
    med = lv.groupBy("match_id").agg(F.expr("percentile(tv, 0.5D, c)").alias("med"))
    off = lv.join(med, "match_id").groupBy("match_id", "med").agg(F.expr("percentile(abs(tv - med), 0.5D, c)").alias("mad"))
    th = off.select("match_id", F.greatest(F.lit(floor), F.col("med") + mult * (F.col("mad") * MAD_SCALE)).alias("threshold"))
    return (tv if least is None else tv.where(F.col("tv") >= least)).join(th, "match_id")


def peaks(tv: DataFrame, floor: float = TV_FLOOR, mult: float = MAD_MULT, sep_s: int = 4 * MINUTE) -> DataFrame:
    """Robust peaks, picked greedily by size with a minimum separation.

    Candidates closer than the separation form an island; a pick in one island can never block
    another, so the greedy walk runs per island, on a short array, inside one column expression.
    Equal sizes prefer the earlier bar.
    """
    cand = peak_threshold(tv, floor, mult, least=floor).where(F.col("tv") >= F.col("threshold"))
    w = W.partitionBy("match_id").orderBy("bin_ts")
    fresh = F.coalesce(F.col("bin_ts") - F.lag("bin_ts").over(w) >= sep_s, F.lit(True)).cast("int")
    isl = cand.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    item = F.struct((-F.col("tv")).alias("neg"), F.col("bin_ts").alias("ts"))
    sorted_items = F.array_sort(F.collect_list(item))
    none = F.slice(sorted_items, 1, 0)
    taken = F.aggregate(
        sorted_items, none, lambda acc, x: F.when(F.exists(acc, lambda a: F.abs(a["ts"] - x["ts"]) < sep_s), acc).otherwise(F.concat(acc, F.array(x)))
    )
    g = isl.groupBy("match_id", "threshold", "island").agg(taken.alias("picks"))
    return g.select("match_id", "threshold", F.explode("picks").alias("p")).select("match_id", F.col("p.ts").alias("event_ts"), (-F.col("p.neg")).alias("magnitude"), "threshold")


def primary_leg(events: DataFrame, series: DataFrame) -> DataFrame:
    """Leg with the largest absolute move at each event and its direction."""
    at = series.withColumnRenamed("bin_ts", "event_ts").where("diff is not null").select("match_id", "event_ts", "leg", "ticker", "diff")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LEG_ORDER]), F.col("leg")), F.lit(0))
    g = at.join(events.select("match_id", "event_ts"), ["match_id", "event_ts"], "left_semi").groupBy("match_id", "event_ts").agg(
        F.max_by(F.struct("leg", "ticker", "diff"), F.struct(F.abs("diff"), -rank)).alias("m")
    )
    out = events.join(g, ["match_id", "event_ts"])
    return out.select(*events.columns, F.col("m.leg").alias("leg"), F.col("m.ticker").alias("ticker"), F.when(F.col("m.diff") > 0, "up").otherwise("down").alias("direction"))


def corroborate(events: DataFrame, sources: Mapping[str, tuple[DataFrame, int, float]]) -> DataFrame:
    """Nearest same-direction jump of every other source, and how many sources agree.

    ``sources`` maps a name to ``(leg series, window seconds, magnitude floor)``.
    """
    jumps = None
    for name, (series, _, floor) in sources.items():
        one = series.where(F.abs("diff") >= floor).select(
            "match_id", "leg", F.when(F.col("diff") > 0, "up").otherwise("down").alias("direction"), F.lit(name).alias("source"), F.col("bin_ts").alias("jump_ts"), F.col("diff").alias("jump")
        )
        jumps = one if jumps is None else jumps.unionByName(one)
    specs = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(w).alias("lim")) for n, (_, w, _) in sources.items()])
    asked = events.withColumn("__s", F.explode(specs)).select(*events.columns, "__s.source", "__s.lim")
    hit = T.nearest(asked, jumps, ["match_id", "leg", "direction", "source"], "event_ts", "jump_ts", F.col("lim"), {"jump_ts": "jump_ts", "jump": "jump"}, open_back=True)
    aggs = []
    for n in sources:
        mine = F.col("source") == n
        aggs += [F.max(F.when(mine, F.col("jump_ts"))).alias(f"{n}_ts"), F.max(F.when(mine, F.col("jump"))).alias(f"{n}_jump")]
    return hit.groupBy(*events.columns).agg(*aggs, (F.count("jump_ts") + 1).cast("int").alias("n_sources"))


def _around(events: DataFrame, src: DataFrame, lo_s: int, hi_s: int) -> DataFrame:
    """Source rows (ticker, source, src_ts, src_value) near each event of their ticker."""
    spans = events.select("event_id", "ticker", "event_ts", "direction", (F.col("event_ts") + lo_s).alias("lo"), (F.col("event_ts") + hi_s).alias("hi"))
    return T.bucket_range_join(src, spans, "src_ts", "lo", "hi", on=["ticker"], width=max(600, hi_s - lo_s))


def latency(events: DataFrame, sources: Mapping[str, tuple[DataFrame, str, str, str]], unit_s: int = MINUTE) -> DataFrame:
    """Pre and post level, jump, and seconds to 20% and 90% of it, per event and source.

    ``events``: event_id, ticker, event_ts, direction. Windows in units of ``unit_s``: pre
    [-5, -1), post [3, 8], crossing [0, 10].
    """
    u = unit_s
    # Ticks near events are a small part of the tape; two later steps read them.
    near = cut(_around(events, stack_sources(sources, "ticker"), -5 * u, 10 * u).withColumn("rel", F.col("src_ts") - F.col("event_ts")))
    pre = (F.col("rel") >= -5 * u) & (F.col("rel") < -u)
    post = (F.col("rel") >= 3 * u) & (F.col("rel") <= 8 * u)
    med = near.groupBy("event_id", "source").agg(F.median(F.when(pre, F.col("src_value"))).alias("pre"), F.median(F.when(post, F.col("src_value"))).alias("post"))
    med = med.where("pre is not null and post is not null").withColumn("jump", _r(F.col("post") - F.col("pre")))
    x = near.where("rel >= 0").join(med, ["event_id", "source"])
    delta = _r(F.col("src_value") - F.col("pre"))

    def crossed(frac: float) -> Column:
        goal = _r(F.col("jump") * frac)
        test = F.when(F.col("direction") == "up", delta >= goal).otherwise(delta <= goal)
        return F.min(F.when((F.col("jump") != 0) & test, F.col("rel")))

    first = x.groupBy("event_id", "source").agg(crossed(0.2).alias("t20_s"), crossed(0.9).alias("t90_s"))
    names = F.array(*[F.lit(n) for n in sources])
    frame = events.select("event_id", F.explode(names).alias("source"))
    return frame.join(med, ["event_id", "source"], "left").join(first, ["event_id", "source"], "left")


def lead_lag(a: DataFrame, b: DataFrame, step: int = MINUTE, max_lag: int = 10, min_bins: int = 20, min_pairs: int = 10, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    """Correlation of bar returns at shifted lags; a positive best lag means ``a`` leads.

    ``a``, ``b``: the keys (a match, or a match and its leg), bin_ts, ret, at most one row per bar. Both are shuffled once by
    key, each bar a single time whatever the number of lags; a key has span / step bars, which its task shifts.
    """
    keys = list(keys)
    side = lambda df, x, y: df.where("ret is not null").select(*keys, "bin_ts", x.alias("x"), y.alias("y"))
    none = F.lit(None).cast("double")
    both = side(a, F.col("ret"), none).unionByName(side(b, none, F.col("ret")))
    schema = [f"{k} {a.schema[k].dataType.simpleString()}" for k in keys]

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        # Bars are unique in each side: a bar counts where both have it.
        xs, ys = (pdf[pdf[c].notna()].set_index("bin_ts")[c] for c in ("x", "y"))
        j = pd.concat([xs, ys], axis=1, join="inner").sort_index()
        at, x, y = j.index.to_numpy(), j["x"].to_numpy(), j["y"].to_numpy()
        found = []
        for lag in range(-max_lag, max_lag + 1) if len(at) >= min_bins else ():
            pos = np.searchsorted(at, at + lag * step)
            hit = np.flatnonzero(at[np.minimum(pos, len(at) - 1)] == at + lag * step)
            if len(hit) < min_pairs:
                continue
            u, v = x[hit], y[pos[hit]]
            u, v = u - u.mean(), v - v.mean()
            su, sv = np.sqrt(np.mean(u * u)), np.sqrt(np.mean(v * v))
            if su >= 1e-9 and sv >= 1e-9:
                found.append((lag, float(np.mean(u * v) / (su * sv))))
        out = pd.DataFrame(found, columns=["lag", "corr"]).assign(n_bins=len(at))
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "n_bins", "lag", "corr"]]

    c = both.groupBy(*keys).applyInPandas(correlate, ", ".join([*schema, "n_bins long", "lag int", "corr double"])).withColumn("corr", _r(F.col("corr"), 8))
    g = c.groupBy(*keys, "n_bins").agg(
        F.max_by("lag", F.when(F.col("corr").isNotNull(), F.struct(F.col("corr"), -F.col("lag")))).alias("best_lag"),
        F.max("corr").alias("best_corr"),
        F.max(F.when(F.col("lag") == 0, F.col("corr"))).alias("same_bar_corr"),
    )
    lead = F.when(F.col("best_lag") > 0, "a").when(F.col("best_lag") < 0, "b").otherwise("same")
    return g.where("best_lag is not null").withColumn("leader", lead)


def overshoot(events: DataFrame, t: DataFrame, unit_s: int = MINUTE) -> DataFrame:
    """Extreme after an event, the settled level, overshoot and its half-life.

    ``events``: event_id, match_id, ticker, event_ts, direction, span_end. Windows in units:
    extreme [0, 12], settled [25, 35] cut at the span's end; a next event of the match before
    the settle window closes marks the row as contaminated.
    """
    u = unit_s
    w = W.partitionBy("match_id").orderBy("event_ts", "event_id")
    ev = events.withColumn("next_ts", F.lead("event_ts").over(w)).withColumn("settle_hi", F.least(F.col("event_ts") + 35 * u, F.col("span_end")))
    ev = ev.withColumn("contaminated", F.coalesce(F.col("next_ts") < F.col("settle_hi"), F.lit(False)))
    src = t.select("ticker", F.col("created_ts").alias("src_ts"), F.col("yes_price_usd").alias("src_value"), "trade_id")
    near = cut(_around(ev, src, 0, 35 * u)).join(ev.select("event_id", "settle_hi", "contaminated"), "event_id")
    rel = F.col("src_ts") - F.col("event_ts")
    side = F.when(F.col("direction") == "up", F.col("src_value")).otherwise(-F.col("src_value"))
    early = rel <= 12 * u
    order = F.when(early, F.struct(-side, "src_ts", "trade_id"))
    top = near.groupBy("event_id", "direction", "contaminated", "event_ts", "settle_hi").agg(
        F.min_by(F.struct("src_value", "src_ts"), order).alias("peak"),
        F.median(F.when((rel >= 25 * u) & (F.col("src_ts") <= F.col("settle_hi")), F.col("src_value"))).alias("settled"),
    )
    top = top.where("peak is not null").select("*", F.col("peak.src_value").alias("peak_price"), F.col("peak.src_ts").alias("peak_ts")).drop("peak")
    usable = F.col("settled").isNotNull() & ~F.col("contaminated")
    over = _r(F.when(F.col("direction") == "up", F.col("peak_price") - F.col("settled")).otherwise(F.col("settled") - F.col("peak_price")))
    top = top.withColumn("overshoot", F.when(usable, over)).withColumn("half", _r(F.col("settled") + 0.5 * (F.col("peak_price") - F.col("settled"))))
    back = near.select("event_id", "src_ts", "src_value").join(top, "event_id").where((F.col("src_ts") > F.col("peak_ts")) & (F.col("src_ts") <= F.col("settle_hi")))
    hit = F.when(F.col("direction") == "up", F.col("src_value") <= F.col("half")).otherwise(F.col("src_value") >= F.col("half"))
    first = back.groupBy("event_id").agg(F.min(F.when(hit & F.col("overshoot").isNotNull(), F.col("src_ts") - F.col("peak_ts"))).alias("half_life_s"))
    return top.join(first, "event_id", "left").select(
        "event_id", "direction", "contaminated", "peak_price", (F.col("peak_ts") - F.col("event_ts")).alias("peak_lag_s"), "settled", "overshoot", "half_life_s"
    )


# ------------------------------------------------------------------ hot windows and tails


def hot_window(t: DataFrame, search: DataFrame, step: int = 30, spread: float = 0.06, quiet: int = 8) -> DataFrame:
    """The last busy stretch of each market, found backwards from its last trade.

    ``search``: ticker, lo. Bins whose price range reaches ``spread`` are hot; the stretch bridges
    up to ``quiet`` quiet bins and keeps that many in front. Adds the trade-rate ratio between
    the stretch and all trades since ``lo``, null if that is the last trade's time.
    """
    late = t.join(search.select("ticker", "lo"), "ticker").where(F.col("created_ts") >= F.col("lo"))
    bins = late.groupBy("ticker", "lo", T.floor_to(F.col("created_ts"), step).alias("bin_ts")).agg(
        _r(F.max("yes_price_usd") - F.min("yes_price_usd")).alias("range"), _n().alias("n"), F.sum("count_contracts").alias("c"), F.max("created_ts").alias("last_ts")
    )
    ends = bins.groupBy("ticker", "lo").agg(F.min("bin_ts").alias("first_bin"), F.max("bin_ts").alias("end_bin"), F.max("last_ts").alias("end_ts"), F.sum("n").alias("n_all"))
    j = bins.join(ends, ["ticker", "lo"])
    mark = j.where((F.col("range") >= spread) | (F.col("bin_ts") == F.col("end_bin")))
    w = W.partitionBy("ticker").orderBy("bin_ts")
    prev = F.lag("bin_ts").over(w)
    head = F.when(prev.isNull() | (F.col("bin_ts") - prev > (quiet + 1) * step), F.col("bin_ts"))
    starts = mark.withColumn("head", head).groupBy("ticker").agg(F.max("head").alias("head"))
    bounds = ends.join(starts, "ticker").withColumn("start_ts", F.greatest(F.col("first_bin"), F.col("head") - quiet * step))
    inside = late.join(bounds.select("ticker", "start_ts", "end_ts", "n_all"), "ticker").where(F.col("created_ts") >= F.col("start_ts"))
    g = inside.groupBy("ticker", "lo", "start_ts", "end_ts", "n_all").agg(_n().alias("n_trades"), F.sum("count_contracts").alias("contracts"))
    minutes = (F.col("end_ts") - F.col("start_ts")) / 60
    whole = (F.col("end_ts") - F.col("lo")) / 60
    tpm = F.col("n_trades") / F.greatest(minutes, F.lit(0.5))
    return g.withColumn("duration_min", minutes).withColumn("trades_per_min", tpm).withColumn("intensity", tpm / F.try_divide("n_all", whole))


def smoothed(t: DataFrame, half: int = 2) -> DataFrame:
    """Centred rolling median of the tick price, edges on the rows there are."""
    num = ordered.row_number(t.select("ticker", "created_ts", "trade_id", "yes_price_usd"), ["ticker"], ["created_ts", "trade_id"], "pos")
    # One frame of the prices around a row serves both medians: that of the row before is the frame shifted by one row.
    near = ordered.framed(num, ["ticker"], "pos", {"__near": ("collect_list(struct(pos, yes_price_usd AS p))", -half - 1, half)})
    late, early = F.col("__near"), F.col("pos") + half
    med = lambda lo, hi: _median(F.transform(F.filter(late, lambda x: (x["pos"] >= lo) & (x["pos"] <= hi)), lambda x: x["p"]))
    both = near.withColumn("smooth", med(F.col("pos") - half, early)).withColumn("smooth_before", med(F.col("pos") - half - 1, early - 1))
    return both.drop("__near").withColumn("smooth_before", F.when(F.col("pos") > 1, F.col("smooth_before")))


def _median(values: Column) -> Column:
    """Interpolated median of a short list, nulls left out; null if nothing is left."""
    x = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(x)
    at = lambda k: F.get(x, k.cast("int"))
    lo, hi = at(F.floor((n - 1) / 2)), at(F.floor(n / 2))
    return F.when(n > 0, F.when(n % 2 == 1, lo).otherwise(lo + (hi - lo) * 0.5))


def turning_points(t: DataFrame, min_move: float = 0.05, block: int = 100_000) -> DataFrame:
    """Turns of at least ``min_move`` on the smoothed tick line.

    The walk remembers the price of the last accepted turn. Whatever price it enters a block of rows
    with, the first row it accepts is a new low or a new high of the block, and from there on the
    entry no longer matters. Each block is therefore summarised, in parallel, as its successive lows
    and highs with the exit price and the turns that follow each, and the few summaries of a market
    are chained afterwards. Prices are compared as they are; no task ever holds a market's whole tick line.
    """
    line = smoothed(t)
    blk = F.floor(F.col("pos") / block)
    d = _r(F.col("smooth") - F.col("smooth_before"))
    moves = line.where(d != 0).withColumn("dir", F.signum(d).cast("int"))
    flips = ordered.previous(moves, ["ticker"], ["pos"], F.col("dir"), "dir0", chunk=blk)
    # First move of a market sets the level; later rows matter only when the direction flips.
    flips = flips.where(F.col("dir0").isNull() | (F.col("dir") != F.col("dir0")))
    rows = flips.select("ticker", blk.alias("blk"), "pos", "smooth")
    kind = rows.schema["ticker"].dataType.simpleString()

    def summary(part: pa.Table) -> pa.Table:
        lv = np.asarray(part["smooth"])[np.argsort(np.asarray(part["pos"]))]
        exits, turns = np.empty(len(lv)), np.zeros(len(lv), dtype="int64")
        for i, k in _next_far(lv, min_move):
            exits[i], turns[i] = (exits[k], turns[k] + 1) if k < len(lv) else (lv[i], 0)
        low, high = (np.flatnonzero(np.append(True, np.diff(f(lv)) != 0)) for f in (np.minimum.accumulate, np.maximum.accumulate))
        at = np.unique(np.concatenate([low, high]))
        return part.select(["ticker", "blk"]).slice(0, 1).append_column("price", [[lv[at]]]).append_column("exit", [[exits[at]]]).append_column("turns", [[turns[at]]])

    def chain(part: pa.Table) -> pa.Table:
        level, n = None, 0
        part = part.sort_by("blk")
        for price, ends, turns in zip(*(part[c].to_pylist() for c in ("price", "exit", "turns")), strict=True):
            if level is None:  # the first move of a market sets the level and is no turn
                level, n = ends[0], int(turns[0])
                continue
            far = np.flatnonzero(_far(np.asarray(price), level, min_move))
            if len(far):
                level, n = ends[far[0]], n + 1 + int(turns[far[0]])
        return part.select(["ticker"]).slice(0, 1).append_column("n_turns", [[n]])

    # Few bytes a group but a Python call each: a given number of tasks is not coalesced.
    tasks = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = rows.repartition(tasks, "ticker", "blk").groupBy("ticker", "blk").applyInArrow(summary, f"ticker {kind}, blk long, price array<double>, exit array<double>, turns array<long>")
    done = per.repartition(tasks, "ticker").groupBy("ticker").applyInArrow(chain, f"ticker {kind}, n_turns long")
    return t.select("ticker").distinct().join(done, "ticker", "left").na.fill(0, ["n_turns"])


def turning_windows(t: DataFrame, search: DataFrame, step: int = 30, spread: float = 0.06, quiet: int = 8, min_move: float = 0.05, block: int = 100_000) -> DataFrame:
    """Turns inside each market's hot window beside its bounds, duration, ticks, contracts and trade rates (M09 in the window of M08)."""
    hot = cut(hot_window(t, search, step, spread, quiet))
    inside = T.between_join(t, hot.select("ticker", (F.col("start_ts") - 1).alias("after"), "end_ts"), ["ticker"], "created_ts", "after", "end_ts").drop("after", "end_ts")
    turns = turning_points(inside, min_move, block)
    cols = ["ticker", "start_ts", "end_ts", "duration_min", F.col("n_trades").alias("n_ticks"), "contracts", "n_turns", "trades_per_min", "intensity"]
    return hot.join(turns, "ticker", "left").na.fill(0, ["n_turns"]).select(*cols)


def _next_far(price: np.ndarray, min_move: float) -> Iterator[tuple[int, int]]:
    """From the last row to the first: the row, and the next one whose price is more than ``min_move`` off (the number of rows if none).

    The next price above a bound is one of the highs that a walk to the right would set anew; these are kept as a
    falling stack, the lows alike, and searched by halves: n log n in all.
    """
    x = np.rint(price * 1e9).astype(np.int64).tolist()
    d = round(min_move * 1e9)
    high, high_at, low, low_at = [], [], [], []  # highs as negatives, so that both ascend
    for i in range(len(x) - 1, -1, -1):
        v = x[i]
        a, b = bisect_left(high, -(v + d)) - 1, bisect_left(low, v - d) - 1
        yield i, min(high_at[a] if a >= 0 else len(x), low_at[b] if b >= 0 else len(x))
        for kept, at, y in ((high, high_at, -v), (low, low_at, v)):
            while kept and kept[-1] >= y:
                kept.pop()
                at.pop()
            kept.append(y)
            at.append(i)


def _far(price: np.ndarray, level: float, min_move: float) -> np.ndarray:
    return np.round(np.abs(price - level), 9) > min_move


def settlement_tail(t: DataFrame, m: DataFrame, min_prints: int = 5, high: tuple[float, float] = TAIL_HIGH, low: tuple[float, float] = TAIL_LOW) -> DataFrame:
    """The stretch after which every print stays in the terminal band.

    The tail begins after the last out-of-band print. Markets that start in band, end out of it,
    or have few prints have no tail. Two aggregates and one join; no ordering of trades.
    """
    j = t.join(m.select("ticker", "result"), "ticker").where(F.col("result").isin("yes", "no"))
    p, yes = F.col("yes_price_usd"), F.col("result") == "yes"
    within = lambda a, b: F.when(yes, p.between(*a)).otherwise(p.between(*b))
    at = F.struct(F.col("created_ts").alias("ts"), F.col("trade_id").alias("id"))
    edge = j.groupBy("ticker").agg(F.max(F.when(~within(high, low), at)).alias("edge"), _n().alias("n")).where((F.col("n") >= min_prints) & F.col("edge").isNotNull())
    k = j.join(edge, "ticker").withColumn("tail", at > F.col("edge"))
    tail, c = F.col("tail"), F.col("count_contracts")
    flag = lambda cond: F.avg(F.when(tail, F.when(cond, 1.0).otherwise(0.0)))
    g = k.groupBy("ticker", "result").agg(
        F.count_if(~tail).alias("n_pre"),
        F.count_if(tail).alias("n_tail"),
        F.min(F.when(tail, F.col("created_ts"))).alias("resolution_ts"),
        F.max("created_ts").alias("last_ts"),
        F.sum(F.when(tail, c)).alias("tail_contracts"),
        F.avg(F.when(~tail, c)).alias("pre_mean_size"),
        F.avg(F.when(tail, c)).alias("tail_mean_size"),
        flag(within(EXTREME_HIGH, EXTREME_LOW)).alias("extreme_share"),
        flag(F.col("taker_side") == "yes").alias("taker_yes_share"),
    )
    return g.where("n_tail > 0").withColumn("tail_s", F.col("last_ts") - F.col("resolution_ts"))


def tail_by_family(tails: DataFrame, families: DataFrame) -> DataFrame:
    """Medians of the tails per family."""
    j = tails.join(families.select("ticker", "family"), "ticker")
    out = j.groupBy("family").agg(_n().alias("n"), F.sum("tail_contracts").alias("tail_contracts"))
    for col, name in (("tail_s", "median_tail_s"), ("extreme_share", "median_extreme"), ("taker_yes_share", "median_taker_yes")):
        out = out.join(ordered.quantiles(j, ["family"], col, [0.5], [name]), "family")
    return out


def regime(t: DataFrame, kickoffs: DataFrame, min_n: int = 20) -> DataFrame:
    """Trade size and inter-trade time before and during play.

    ``kickoffs``: ticker, kickoff, span_end. Medians come from counts per distinct value.
    """
    j = t.join(kickoffs.select("ticker", "kickoff", "span_end"), "ticker").where(F.col("created_ts") <= F.col("span_end"))
    phased = j.withColumn("phase", F.when(F.col("created_ts") < F.col("kickoff"), "pre").otherwise("in"))
    g = T.gaps(phased, ["ticker", "phase"], "created_ts", "trade_id")
    keys = ["ticker", "phase"]
    size = ordered.quantiles(phased, keys, "count_contracts", [0.5], ["size"])
    gap = ordered.quantiles(g, keys, "gap_s", [0.5], ["gap"])
    n = phased.groupBy(*keys).agg(_n().alias("n"))
    long = n.join(size, keys).join(gap, keys, "left")
    pick = lambda ph, c: F.max(F.when(F.col("phase") == ph, F.col(c)))
    cols = [pick(ph, c).alias(f"{ph}_{c}") for ph in ("pre", "in") for c in ("n", "size", "gap")]
    wide = long.groupBy("ticker").agg(*cols).where((F.col("pre_n") >= min_n) & (F.col("in_n") >= min_n))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return wide.withColumn("size_ratio", ratio("in_size", "pre_size")).withColumn("gap_ratio", ratio("in_gap", "pre_gap"))


# ------------------------------------------------------------------ breaks


def breaks(sources: Mapping[str, tuple[DataFrame, str, str, str]], legs: DataFrame, step: int = MINUTE) -> DataFrame:
    """Largest bar-to-bar break of each match in each source.

    ``legs``: match_id, ticker, lo, hi. Sources are stacked and solved in one pass.
    """
    s = stack_sources(sources, "ticker").join(legs.select("match_id", "ticker", "lo", "hi"), "ticker")
    s = s.where((F.col("src_ts") >= F.col("lo")) & (F.col("src_ts") <= F.col("hi")))
    per = T.biggest_jump(s, ["match_id", "source", "ticker"], "src_ts", "src_tie", "src_value", step)
    top = F.struct(-F.col("jump_mag"), "ticker")
    return per.groupBy("match_id", "source").agg(F.min_by("jump_ts", top).alias("break_ts"), F.min_by("ticker", top).alias("ticker"), F.max("jump_mag").alias("break_mag"))


def break_skew(br: DataFrame, names: Sequence[str], floor: float = 0.15) -> DataFrame:
    """Pairwise and largest time skew of the breaks that clear the floor."""
    at = lambda n: F.max(F.when((F.col("source") == n) & (F.col("break_mag") >= floor), F.col("break_ts")))
    w = br.groupBy("match_id").agg(*[at(n).alias(n) for n in names], F.count_if(F.col("break_mag") >= floor).alias("n_located"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for a, b in pairs:
        w = w.withColumn(f"{a}_vs_{b}_s", F.abs(F.col(a) - F.col(b)))
    cols = [F.col(f"{a}_vs_{b}_s") for a, b in pairs]
    return w.withColumn("max_skew_s", cols[0] if len(cols) == 1 else F.greatest(*cols)).drop(*names)


def break_in(src: DataFrame, windows: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, step: int = MINUTE) -> DataFrame:
    """Largest break inside a series' window (M13). ``windows``: the keys, lo, hi."""
    inside = src.join(windows.select(*keys, "lo", "hi"), list(keys)).where(F.col(ts).between(F.col("lo"), F.col("hi")))
    return T.biggest_jump(inside, keys, ts, tie, value, step)


def largest_move(t: DataFrame, step: int = MINUTE) -> DataFrame:
    """Minute of the largest absolute one-bar move of each market.

    Empty bars repeat the last price, so a move is dated to the bar of the new price.
    """
    return T.biggest_jump(t, ["ticker"], "created_ts", "trade_id", "yes_price_usd", step)


def contrarian(events: DataFrame, t: DataFrame, lo_s: int = 60, hi_s: int = 600) -> DataFrame:
    """Share of flow against the move after each event, with reasons for exclusions.

    ``events``: event_id, ticker, event_ts, pre, post.
    """
    direction = F.when(F.col("post") > F.col("pre"), "up").when(F.col("post") < F.col("pre"), "down")
    ev = events.withColumn("direction", direction)
    src = t.select("ticker", F.col("created_ts").alias("src_ts"), "taker_side", "count_contracts")
    near = _around(ev, src, lo_s, hi_s)
    against = F.when(F.col("direction") == "up", F.col("taker_side") == "no").otherwise(F.col("taker_side") == "yes")
    g = near.groupBy("event_id").agg(_n().alias("n_trades"), F.sum("count_contracts").alias("contracts"), F.sum(F.when(against, F.col("count_contracts")).otherwise(0.0)).alias("contra"))
    out = ev.join(g, "event_id", "left")
    empty = F.coalesce(F.col("contracts"), F.lit(0.0)) <= 0
    reason = F.when(F.col("direction").isNull(), "flat").when(empty, "no_trades")
    return out.select("event_id", "direction", reason.alias("excluded"), F.coalesce("n_trades", F.lit(0)).alias("n_trades"), F.when(reason.isNull(), F.col("contra") / F.col("contracts")).alias("share"))


def contrarian_summary(c: DataFrame) -> DataFrame:
    """Counts of used and excluded events and the quartiles of the share."""
    n = c.agg(
        _n().alias("n_events"), F.count("share").alias("n_used"), F.count_if(F.col("excluded") == "flat").alias("n_flat"), F.count_if(F.col("excluded") == "no_trades").alias("n_no_trades"), F.avg("share").alias("mean")
    )
    names = ["p25", "median", "p75"]
    q = ordered.quantiles(c, [], "share", [0.25, 0.5, 0.75], names).select(F.struct(*names).alias("q")).scalar()
    return n.withColumn("q", q).select("*", "q.*").drop("q")


def _pin(t: DataFrame, hit: Column, spoil: Column) -> DataFrame:
    at = F.struct(F.col("created_ts").alias("ts"), F.col("trade_id").alias("id"))
    last = t.groupBy("ticker").agg(F.max(F.when(spoil, at)).alias("__last"))
    k = t.join(last, "ticker").where(hit & (F.col("__last").isNull() | (at > F.col("__last"))))
    return k.groupBy("ticker").agg(F.min(at)["ts"].alias("pin_ts"))


def pin_high(t: DataFrame, hi: int = 99, lo: int = 97) -> DataFrame:
    """First print at or above ``hi`` cents after the last one below ``lo``."""
    c = F.bround(F.col("yes_price_usd") * 100, 0)
    return _pin(t, c >= hi, c < lo)


def pin_low(t: DataFrame, hi: int = 3, lo: int = 1) -> DataFrame:
    """First print at or below ``hi`` cents after the last one above ``lo``."""
    c = F.bround(F.col("yes_price_usd") * 100, 0)
    return _pin(t, c <= hi, c > lo)


def steps(t: DataFrame, step: int = 2, win_s: int = 10, jump: float = 0.035, merge_s: int = 14, spans: DataFrame | None = None) -> DataFrame:
    """Level shifts: trailing against leading medians on a dense grid, neighbours merged.

    ``spans`` (ticker, lo, hi) names the window of each market, such as a match; without it the window is its whole
    life, whose grid has life / step rows.
    The grid is cut into blocks with a few copied rows at the borders (``ordered.framed``). The
    reported instant is the first tick past the midpoint of the two levels, which always lies
    between ten seconds before the first and one window after the last merged grid point.
    """
    win = max(1, round(win_s / step))
    if spans is not None:
        named = spans.select("ticker", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
        t = t.join(named, "ticker").where(F.col("created_ts").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    spans = t.groupBy("ticker").agg(F.min("created_ts").alias("lo"), F.max("created_ts").alias("hi"))
    bars = T.resample_last(t, ["ticker"], "created_ts", "trade_id", "yes_price_usd", step, "v")
    marks = T.grid(spans, step)
    full = marks.join(bars, ["ticker", "bin_ts"], "left")
    filled = ordered.last_known(full, ["ticker"], ["bin_ts"], F.col("v"), "p", chunk=ordered.time_chunk("bin_ts", step * 4096))
    lo, hi = T.floor_to(F.col("lo"), step), T.floor_to(F.col("hi"), step)
    pos = ((F.col("bin_ts") - lo) / step + 1).cast("long")
    size = ((hi - lo) / step + 1).cast("long")
    x = filled.select("ticker", "bin_ts", "p", pos.alias("pos"), size.alias("size"))
    med = "percentile(p, 0.5D)"
    x = ordered.framed(x, ["ticker"], "pos", {"before": (med, -win, -1), "after": (med, 0, win - 1)})
    d = _r(F.col("after") - F.col("before"))
    cand = x.where((F.col("pos") > win) & (F.col("pos") <= F.col("size") - win) & (F.abs(d) >= jump))
    # Candidates are few and three later passes read them.
    cand = cut(cand.select("ticker", "bin_ts", "before", "after"))
    chunk = ordered.time_chunk("bin_ts", step * 4096)
    prev = ordered.previous(cand, ["ticker"], ["bin_ts"], F.col("bin_ts"), "__p", chunk=chunk)
    fresh = F.when(F.col("__p").isNull() | (F.col("bin_ts") - F.col("__p") > merge_s), 1).otherwise(0)
    isl = ordered.running_sum(prev, ["ticker"], ["bin_ts"], fresh.cast("long"), "step_no", chunk=chunk)
    g = isl.groupBy("ticker", "step_no").agg(
        F.min("bin_ts").alias("t0"), F.max("bin_ts").alias("t1"), F.min_by("before", "bin_ts").alias("before"), F.max_by("after", "bin_ts").alias("after")
    )
    g = g.withColumn("mid", _r((F.col("before") + F.col("after")) / 2)).withColumn("lo", F.col("t0") - win_s).withColumn("hi", F.col("t1") + win_s)
    ticks = t.select("ticker", "created_ts", "yes_price_usd")
    near = T.bucket_range_join(ticks, g, "created_ts", "lo", "hi", on=["ticker"])
    past = F.when(F.col("after") > F.col("before"), F.col("yes_price_usd") >= F.col("mid")).otherwise(F.col("yes_price_usd") <= F.col("mid"))
    first = near.where(past).groupBy("ticker", "step_no").agg(F.min("created_ts").alias("cross"))
    return g.join(first, ["ticker", "step_no"], "left").select("ticker", "step_no", F.coalesce("cross", "t0").alias("step_ts"), "before", "after")


def annotate_steps(st: DataFrame, first_side: str, second_side: str) -> DataFrame:
    """Alternate sides by order; the jump's sign gives the outcome; the last one decides.

    A rise helps the second side: it is a miss of the first or a make of the second.
    """
    w = W.partitionBy("ticker").orderBy("step_no")
    n = F.row_number().over(w)
    first = n % 2 == 1
    rose = F.col("after") > F.col("before")
    out = st.withColumn("n", n).withColumn("side", F.when(first, first_side).otherwise(second_side))
    out = out.withColumn("outcome", F.when(first, F.when(rose, "miss").otherwise("make")).otherwise(F.when(rose, "make").otherwise("miss")))
    last = F.lead("step_no").over(w).isNull()
    return out.withColumn("decisive", last & (F.col("side") == second_side) & (F.col("outcome") == "make"))


# ------------------------------------------------------------------ single-leg detectors


def dense_bars(t: DataFrame, step: int, spans: DataFrame | None = None) -> DataFrame:
    """Filled bars from the first to the last trade of each market, numbered from 0."""
    src = t if spans is None else t.join(spans.select("ticker", "lo", "hi"), "ticker").where(F.col("created_ts").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    bars = T.resample_last(src, ["ticker"], "created_ts", "trade_id", "yes_price_usd", step, "v")
    life = bars.groupBy("ticker").agg(F.min("bin_ts").alias("lo"), F.max("bin_ts").alias("hi"))
    full = T.grid(life, step).join(bars, ["ticker", "bin_ts"], "left")
    w = W.partitionBy("ticker").orderBy("bin_ts").rowsBetween(W.unboundedPreceding, 0)
    out = full.withColumn("price", F.last("v", ignorenulls=True).over(w))
    idx = ((F.col("bin_ts") - F.col("lo")) / step).cast("long")
    return out.select("ticker", "bin_ts", "price", idx.alias("idx"), ((F.col("hi") - F.col("lo")) / step + 1).cast("long").alias("size"))


def spike(t: DataFrame, spans: DataFrame, step: int = 5, tol: int = 3, base_max: int = 36) -> DataFrame:
    """Baseline, onset, peak and resolution of the largest spike in a window."""
    b = dense_bars(t, step, spans).withColumn("c", _r(F.col("price") * 100))
    n_base = F.greatest(F.lit(1), F.least(F.floor(F.col("size") / 3), F.lit(base_max)))
    lv = b.groupBy("ticker", "size").agg(
        F.bround(F.median(F.when(F.col("idx") < n_base, F.col("c"))), 0).alias("base"), F.max_by(F.struct("idx", "c", "bin_ts"), F.struct("c", -F.col("idx"))).alias("peak")
    )
    j = b.join(lv, ["ticker", "size"])
    low = (F.col("idx") < F.col("peak.idx")) & (F.col("c") <= F.col("base") + tol)
    back = (F.col("idx") >= F.col("peak.idx")) & (F.abs(F.col("c") - F.col("base")) <= tol)
    g = j.groupBy("ticker", "base", "peak").agg(
        F.coalesce(F.max(F.when(low, F.col("bin_ts"))) + step, F.min("bin_ts")).alias("onset_ts"),
        F.coalesce(F.min(F.when(back, F.col("bin_ts"))), F.max("bin_ts")).alias("resolved_ts"),
    )
    return g.select("ticker", F.col("base").alias("baseline_c"), "onset_ts", F.col("peak.bin_ts").alias("peak_ts"), F.bround("peak.c", 0).alias("peak_c"), "resolved_ts")


def lead_interval(t: DataFrame, step: int = 5, rise: float = 0.08, fall: float = 0.20) -> DataFrame:
    """From the first large rise to the first larger fall after it."""
    m = T.bar_moves(T.resample_last(t, ["ticker"], "created_ts", "trade_id", "yes_price_usd", step, "v"), ["ticker"], "v").withColumn("d", _r(F.col("diff")))
    start = m.groupBy("ticker").agg(F.min(F.when(F.col("d") > rise, F.col("bin_ts"))).alias("lead_start"))
    j = m.join(start, "ticker")
    end = (F.col("d") < -fall) & (F.col("lead_start").isNull() | (F.col("bin_ts") > F.col("lead_start")))
    return j.groupBy("ticker", "lead_start").agg(F.min(F.when(end, F.col("bin_ts"))).alias("lead_end"))


def _braid(spans: DataFrame, sources: Mapping[str, tuple[DataFrame, str, str, str]], ends_on: str, step: int, back: bool) -> DataFrame:
    """Runs of marks between which no source changes: ticker, __from, __to, a column per source, terminated_at.

    A tick counts from the first mark that is not before it; only the last one of a mark and source is ordered.
    """
    names = list(sources)
    of = lambda n, c: F.when(F.col("source") == n, c)
    at = F.struct("src_ts", "src_tie")
    stacked = stack_sources(sources, "ticker").join(spans.select("ticker", "lo", "hi"), "ticker").where(F.col("src_ts").between(F.col("lo"), F.col("hi")))
    mark = (F.ceil(F.col("src_ts") / F.lit(step)) * F.lit(step)).cast("long")
    # One-field structs keep "the tick's value is null" apart from "no tick here".
    last = [F.max_by(F.struct(F.col("src_value").alias("v")), of(n, at)).alias(f"__{n}") for n in names]
    first = [F.min(of(n, F.struct("src_ts", "src_tie", F.col("src_value").alias("v")))).alias(f"__first_{n}") for n in names]
    end = F.max(of(ends_on, F.col("src_ts"))).alias("__end")
    bars = stacked.groupBy("ticker", mark.alias("bin_ts")).agg(*last, *first, end)
    edges = bars.groupBy("ticker").agg(*[F.min(f"__first_{n}").alias(f"__first_{n}") for n in names], F.max("__end").alias("__end"))
    w = W.partitionBy("ticker").orderBy("bin_ts").rowsBetween(W.unboundedPreceding, 0)
    filled = bars.select("ticker", "bin_ts", *[F.last(f"__{n}", ignorenulls=True).over(w).alias(f"__{n}") for n in names])
    top = (F.ceil(F.col("hi") / F.lit(step)) * F.lit(step)).cast("long") - step
    runs = T.runs_on(filled, spans.select("ticker", "lo", "hi"), ["ticker"], step, T.floor_to(F.col("lo"), step), top).join(edges, "ticker", "left")
    # A run that goes on after the last quote is cut there.
    live = F.coalesce(T.floor_to(F.col("__end"), step), F.col("__to"))
    halves = F.array(
        F.struct(F.col("__from").alias("a"), F.least(F.col("__to"), live).alias("b"), F.lit(True).alias("on")),
        F.struct(F.greatest(F.col("__from"), live + step).alias("a"), F.col("__to").alias("b"), F.lit(False).alias("on")),
    )
    cut_at = runs.withColumn("__h", F.explode(F.filter(halves, lambda h: h["a"] <= h["b"])))
    value = lambda n: F.when(F.col("__h.on"), F.col(f"__{n}.v")) if n == ends_on else F.coalesce(f"__{n}.v", *([f"__first_{n}.v"] if back else []))
    ended = F.when(F.col("__end") < F.col("hi"), F.col("__end")).alias("terminated_at")
    return cut_at.select("ticker", F.col("__h.a").alias("__from"), F.col("__h.b").alias("__to"), *[value(n).alias(n) for n in names], ended)


def braid(spans: DataFrame, sources: Mapping[str, tuple[DataFrame, str, str, str]], ends_on: str, step: int = MINUTE) -> DataFrame:
    """Sources on one minute clock, leading gaps filled back, one source ending at its last quote.

    ``spans``: ticker, lo, hi. Columns: one per source, null where it has nothing.
    """
    runs = braid_runs(spans, sources, ends_on, step)
    return T.grid(runs, step, "__from", "__to").select("ticker", "bin_ts", *sources, "terminated_at")


def braid_runs(spans: DataFrame, sources: Mapping[str, tuple[DataFrame, str, str, str]], ends_on: str, step: int = MINUTE) -> DataFrame:
    """The braid with one row for equal marks in a row, and how many they are, ``n_bins``."""
    runs = _braid(spans, sources, ends_on, step, back=True)
    return runs.withColumn("n_bins", ((F.col("__to") - F.col("__from")) / step + 1).cast("long"))


def braid_summary(runs: DataFrame, a: str, other: str) -> DataFrame:
    """Legs, mean absolute gap in points, and how many legs ended early (M22), from the runs of the braid."""
    gap, n = F.abs(F.col(a) - F.col(other)), F.col("n_bins")
    per = runs.groupBy("ticker").agg(F.sum(gap * n).alias("g"), F.coalesce(F.sum(F.when(gap.isNotNull(), n)), F.lit(0)).alias("n"), F.max("terminated_at").alias("e"))
    mean = F.try_divide(F.sum("g"), F.sum("n")) * 100
    return per.agg(_n().alias("n_legs"), mean.alias("mean_abs_gap_pp"), F.count("e").alias("n_terminated"))


def braid_live(spans: DataFrame, sources: Mapping[str, tuple[DataFrame, str, str, str]], ends_on: str, step: int = MINUTE) -> DataFrame:
    """The unpadded form: nothing is filled back."""
    runs = _braid(spans, sources, ends_on, step, back=False)
    return T.grid(runs, step, "__from", "__to").select("ticker", "bin_ts", *sources)


def braid_spikes(b: DataFrame, a: str, other: str, floor: float = 0.15) -> DataFrame:
    """Widest gap of each leg where it reaches the floor, and the leg's mean gap."""
    gap = _r(F.col(a) - F.col(other))
    g = b.withColumn("gap", gap).where("gap is not null").groupBy("ticker").agg(
        F.max_by(F.struct("bin_ts", "gap"), F.struct(F.abs("gap"), -F.col("bin_ts"))).alias("m"), F.avg(F.abs("gap")).alias("mean_abs_gap")
    )
    return g.select("ticker", F.col("m.bin_ts").alias("spike_ts"), F.col("m.gap").alias("gap"), "mean_abs_gap").where(F.abs("gap") >= floor)


def lanes(sources: Mapping[str, tuple[DataFrame, str, str, str]], anchors: DataFrame, lo_s: int, hi_s: int) -> DataFrame:
    """Ticks of several venues on one clock around an instant; the closest trade is flagged.

    ``anchors``: ticker, anchor_ts.
    """
    s = stack_sources(sources, "ticker").join(anchors.select("ticker", "anchor_ts").distinct(), "ticker")
    rel = F.col("src_ts") - F.col("anchor_ts")
    s = s.where(rel.between(lo_s, hi_s)).withColumn("offset_s", rel)
    best = s.groupBy("ticker", "anchor_ts", "source").agg(F.min_by("src_tie", F.struct(F.abs("offset_s"), "src_ts", "src_tie")).alias("__b"))
    out = s.join(best, ["ticker", "anchor_ts", "source"]).withColumn("is_event", F.col("src_tie") == F.col("__b"))
    return out.select("ticker", "anchor_ts", "source", "src_ts", "offset_s", F.col("src_value").alias("price"), F.col("src_tie").alias("row_id"), "is_event")


def leg_extract(t: DataFrame, legs: DataFrame, before_s: int, after_s: int = 0, stride: int = 1) -> DataFrame:
    """Ticks of chosen legs in a window ending at each leg's own last trade, thinned evenly."""
    mine = t.join(legs.select("ticker"), "ticker", "left_semi")
    last = mine.groupBy("ticker").agg(F.max("created_ts").alias("last_ts"))
    win = mine.join(last, "ticker").where(F.col("created_ts").between(F.col("last_ts") - before_s, F.col("last_ts") + after_s))
    return win.withColumn("stride", F.lit(1)).withColumn("n_raw", F.lit(None).cast("long")) if stride == 1 else T.every_nth(win, ["ticker"], "created_ts", "trade_id", stride)


def glide(t: DataFrame, anchors: DataFrame, minutes: int = 22) -> DataFrame:
    """Price at an instant and some minutes before it (M26). ``anchors``: ticker, anchor_ts."""
    at = T.at_offsets(anchors, t, ["ticker"], "anchor_ts", "created_ts", "yes_price_usd", [-minutes * 60, 0], "trade_id")
    pick = lambda o: F.max(F.when(F.col("offset_s") == o, F.bround(F.col("price") * 100, 0)))
    return at.groupBy("ticker", "anchor_ts").agg(pick(-minutes * 60).alias("start_c"), pick(0).alias("end_c"))


def minute_medians(t: DataFrame, step: int = MINUTE) -> DataFrame:
    """Upper-middle price in cents per bar, numbered from the market's first bar."""
    cents = F.round(F.col("yes_price_usd") * 100).cast("long")
    first = t.groupBy("ticker").agg(F.min("created_ts").alias("t0"))
    lv = t.join(first, "ticker").groupBy("ticker", F.floor((F.col("created_ts") - F.col("t0")) / step).alias("b"), cents.alias("c")).agg(_n().alias("k"))
    # Whole cents: at most 101 levels per bar, so a bar's list is short.
    items = F.array_sort(F.collect_list(F.struct("c", "k")))
    g = lv.groupBy("ticker", "b").agg(items.alias("i"), F.sum("k").alias("n"))
    seek = F.aggregate(
        "i",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("hit")),
        lambda a, x: F.struct(
            (a["seen"] + x["k"]).alias("seen"), F.when(a["hit"].isNull() & (a["seen"] + x["k"] > F.floor(F.col("n") / 2)), x["c"]).otherwise(a["hit"]).alias("hit")
        ),
    )
    return g.select("ticker", "b", seek["hit"].alias("med"))


def cliffs(t: DataFrame, step: int = MINUTE, mult: float = 6.0, floor: float = 3.0, skip: int = 10, fallback: float = 8.0) -> DataFrame:
    """First and second price cliff against the tape's own noise.

    Threshold: ``max(floor, mult * sd)`` of bar-to-bar median moves without the two largest
    (a fixed fallback under three moves). The first cliff is the earliest bar whose neighbours
    drop by more; the second is the largest drop at least ``skip`` bars later.
    """
    m = minute_medians(t, step)
    w = W.partitionBy("ticker").orderBy("b")
    nb = lambda fn, c: fn(c).over(w)
    x = m.withColumn("pb", nb(F.lag, "b")).withColumn("pm", nb(F.lag, "med")).withColumn("nb", nb(F.lead, "b")).withColumn("nm", nb(F.lead, "med"))
    has_p, has_n = F.col("pb") == F.col("b") - 1, F.col("nb") == F.col("b") + 1
    x = x.select("ticker", "b", F.when(has_p, F.col("med") - F.col("pm")).alias("d"), F.when(has_p & has_n, F.col("pm") - F.col("nm")).alias("drop"))
    # Windows over a whole market keep the order of its bars: one sort serves all of them, and nothing is joined back.
    every = W.partitionBy("ticker")
    size = F.when(F.col("d").isNotNull(), F.struct(F.abs("d").alias("a"), (-F.col("b")).alias("b")))
    x = x.withColumn("__s", size).withColumn("__1", F.max("__s").over(every))
    x = x.withColumn("__2", F.max(F.when(F.col("__s") != F.col("__1"), F.col("__s"))).over(every))
    rest = (F.col("__s") != F.col("__1")) & (F.col("__s") != F.col("__2"))
    x = x.withColumn("__n", F.count("d").over(every)).withColumn("__sd", F.stddev_pop(F.when(rest, F.col("d"))).over(every))
    z = x.withColumn("threshold_c", F.when(F.col("__n") < 3, fallback).otherwise(F.greatest(F.lit(floor), F.lit(mult) * F.col("__sd"))))
    z = z.withColumn("first_bar", F.min(F.when(F.col("drop") > F.col("threshold_c"), F.col("b"))).over(every))
    later = (F.col("b") >= F.col("first_bar") + skip) & (F.col("drop") > 0)
    g = z.groupBy("ticker", "threshold_c", "first_bar").agg(
        F.max(F.when(later, F.col("drop"))).alias("dd"), F.max_by("b", F.when(later, F.struct("drop", -F.col("b")))).alias("bb")
    )
    return g.select("ticker", F.col("threshold_c"), "first_bar", F.when(F.col("dd") >= F.col("threshold_c"), F.col("bb")).alias("second_bar"))


def friction_band(t: DataFrame, anchors: DataFrame, band: int, settle: tuple[int, int] = (120, 300), step: int = 10, jump: int = 8) -> DataFrame:
    """How long a price stays near its settled level after an instant, and when it breaks out.

    ``anchors``: ticker, anchor_ts. Level and bar medians are upper-middle prices in cents.
    """
    rel = F.col("created_ts") - F.col("anchor_ts")
    cents = F.round(F.col("yes_price_usd") * 100).cast("long")
    j = t.join(anchors.select("ticker", "anchor_ts").distinct(), "ticker").withColumn("rel", rel).withColumn("c", cents).where(F.col("rel") >= settle[0])

    def upper(df: DataFrame, keys: list[str], out: str) -> DataFrame:
        lv = df.groupBy(*keys, "c").agg(_n().alias("k"))
        arr = F.array_sort(F.collect_list(F.struct("c", "k")))
        g = lv.groupBy(*keys).agg(arr.alias("i"), F.sum("k").alias("n"))
        cum = F.aggregate(
            "i",
            F.struct(F.lit(0).cast("long").alias("s"), F.lit(None).cast("long").alias("h")),
            lambda a, x: F.struct((a["s"] + x["k"]).alias("s"), F.when(a["h"].isNull() & (a["s"] + x["k"] > F.floor(F.col("n") / 2)), x["c"]).otherwise(a["h"]).alias("h")),
        )
        return g.select(*keys, cum["h"].alias(out))

    level = upper(j.where(F.col("rel") <= settle[1]), ["ticker", "anchor_ts"], "level_c")
    bars = upper(j.withColumn("b", F.floor(F.col("rel") / step)), ["ticker", "anchor_ts", "b"], "med")
    w = W.partitionBy("ticker", "anchor_ts").orderBy("b")
    k = bars.withColumn("pm", F.lag("med").over(w)).join(level, ["ticker", "anchor_ts"])
    inside = F.abs(F.col("med") - F.col("level_c")) <= band
    cliff = (F.col("b") * step > settle[1]) & (F.abs(F.col("med") - F.col("pm")) >= jump)
    return k.groupBy("ticker", "anchor_ts", "level_c").agg(
        F.coalesce((F.max(F.when(inside, F.col("b"))) + 1) * step, F.lit(settle[0])).alias("band_end_s"), F.min(F.when(cliff, F.col("b") * step)).alias("breakout_s")
    )


def annotation_times(shocks: DataFrame, t: DataFrame) -> DataFrame:
    """Last trade of each deciding leg, in hours after the shock, never below zero.

    ``shocks``: shock_id, shock_ts, ticker.
    """
    last = t.groupBy("ticker").agg(F.max("created_ts").alias("last_ts"))
    return shocks.join(last, "ticker").select("shock_id", "ticker", "last_ts", F.greatest(F.lit(0.0), (F.col("last_ts") - F.col("shock_ts")) / 3600).alias("hours_after"))
