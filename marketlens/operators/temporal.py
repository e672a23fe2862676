"""As-of joins, grids, fills, interval work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions import ordered

MINUTE, HOUR, DAY = 60, 3600, 86400


def floor_to(ts: Column, step: float) -> Column:
    """Start of the step that holds ``ts`` (a floor; a rounding cast would shift bins)."""
    return (F.floor(ts / F.lit(step)) * F.lit(step)).cast("long")


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


# ------------------------------------------------------------------ as-of family


def asof(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    cols: dict[str, str],
    tie: str | None = None,
    forward: bool = False,
    how: str = "left",
    chunk_s: float = HOUR,
) -> DataFrame:
    """Latest right row of the key at or before each left row.

    Both sides are stacked, ordered by time with sources before targets at equal time, and the
    source struct is carried forward; nothing is paired. ``cols`` maps right columns to output
    names. ``tie`` breaks equal source times. ``forward=True`` looks for the first source at or
    after the target instead. ``how="inner"`` drops targets without a source.
    """
    sign = -1 if forward else 1
    packed = F.struct(*[F.col(c).alias(n) for c, n in cols.items()])
    target = F.lit(1)
    tie_col = F.col(tie) if tie else F.lit(0)
    if forward and tie:
        # The first of equal times is wanted, whatever the tie's type: keep only that one.
        first = F.min_by(F.struct(*[F.col(c) for c in right.columns]), F.struct(F.col(tie)))
        right = right.groupBy(*on, F.col(right_ts).alias("__at")).agg(first.alias("__r")).select("__r.*")
        tie_col = F.lit(0)
    src = right.select(
        *on,
        (F.col(right_ts) * sign).cast("double").alias("__ts"),
        F.lit(0).alias("__side"),
        tie_col.alias("__tie"),
        packed.alias("__src"),
    )
    tie_type = src.schema["__tie"].dataType
    dst = left.select(
        *on,
        (F.col(left_ts) * sign).cast("double").alias("__ts"),
        target.alias("__side"),
        F.lit(None).cast(tie_type).alias("__tie"),
        F.struct(*[F.col(c) for c in left.columns]).alias("__row"),
    )
    both = src.unionByName(dst, allowMissingColumns=True)
    filled = ordered.last_known(
        both,
        on,
        ["__ts", "__side", "__tie"],
        F.col("__src"),
        "__hit",
        chunk=ordered.time_chunk("__ts", chunk_s),
    ).where(F.col("__side") == 1)
    if how == "inner":
        filled = filled.where(F.col("__hit").isNotNull())
    return filled.select(
        *[F.col("__row")[c].alias(c) for c in left.columns],
        *[F.col("__hit")[n].alias(n) for n in cols.values()],
    )


def value_at(
    points: DataFrame,
    src: DataFrame,
    on: Sequence[str],
    ts: str,
    src_ts: str,
    value: str,
    out: str,
    tie: str | None = None,
) -> DataFrame:
    """Last value at or before each point, null when there is none."""
    return asof(points, src, on, ts, src_ts, {value: out}, tie)


def segments(intervals: DataFrame, event: str, start: str, end: str, on: Sequence[str] = ()) -> DataFrame:
    """Cut windows so that each instant (of a key) belongs to the window that started last.

    A point's window is the latest start at or before it; the point then has to lie inside that
    window's end. A window therefore owns ``[start, min(end, next start - 1)]``.
    """
    nxt = ordered.following(intervals, on, [start, event], F.col(start), "__next", chunk=ordered.time_chunk(start, DAY))
    return nxt.select(
        *on,
        F.col(event),
        F.col(start).alias("seg_start"),
        F.least(F.col(end), F.coalesce(F.col("__next") - 1, F.col(end))).alias("seg_end"),
    ).where(F.col("seg_end") >= F.col("seg_start"))


def bucket_range_join(
    points: DataFrame,
    ranges: DataFrame,
    ts: str,
    lo: str,
    hi: str,
    on: Sequence[str] = (),
    width: int = HOUR,
    how: str = "inner",
) -> DataFrame:
    """Points inside ``[lo, hi]`` ranges through an equi-key on a time bucket.

    Each range is copied to the buckets it touches; each point sits in one bucket. Spark picks
    a broadcast join when the measured size of the ranges allows it and an AQE-split sort-merge
    join otherwise.
    """
    spread = ranges.withColumn(
        "__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    )
    p = points.withColumn("__b", F.floor(F.col(ts) / width))
    cond = [p["__b"] == spread["__b"], p[ts] >= spread[lo], p[ts] <= spread[hi]]
    for k in on:
        cond.append(p[k] == spread[k])
    drop = [spread["__b"], *[spread[k] for k in on]]
    out = p.join(spread, cond, how)
    for d in drop:
        out = out.drop(d)
    return out.drop("__b")


def asof_interval(
    points: DataFrame,
    intervals: DataFrame,
    ts: str,
    event: str = "event",
    start: str = "win_start",
    end: str = "win_end",
    mode: str = "latest",
    on: Sequence[str] = (),
) -> DataFrame:
    """Point-in-window attribution, without a key or inside the keys ``on``.

    ``latest`` keeps one row per point, with the window that started last or null (of two that start together, the
    one with the larger id); ``all`` fans out to every window that covers the point and keeps uncovered points with
    null. Sums over windows need no fan-out: see ``volume.window_sums``.
    """
    if mode == "all":
        ranges = intervals.select(*on, event, F.col(start).alias("seg_start"), F.col(end).alias("seg_end"))
    else:
        ranges = segments(intervals, event, start, end, on)
    return bucket_range_join(points, ranges, ts, "seg_start", "seg_end", on, how="left").drop(
        "seg_start", "seg_end"
    )


def last_by(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """``value`` at the greatest ``order`` of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*_cols(order))).alias(out))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest whole row per key (J11), as a combinable aggregate and not a window."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*_cols(rest)), F.struct(*_cols(order))).alias("__r"))
    return top.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def nearest(
    a: DataFrame,
    b: DataFrame,
    on: Sequence[str],
    a_ts: str,
    b_ts: str,
    window_s: float | Column,
    cols: dict[str, str],
    open_back: bool = False,
) -> DataFrame:
    """Time-nearest ``b`` row within ``window_s`` of each ``a`` row, the earlier one on a tie.

    Both sides are stacked and the source before and the source after each target are read in one
    ordered pass, so no pairs are built. ``open_back`` leaves out a candidate exactly ``window_s``
    earlier. ``window_s`` may be a column of ``a``.
    """
    names = list(cols.values())
    src = b.select(
        *on, F.col(b_ts).cast("double").alias("__ts"), F.lit(0).alias("__side"), F.struct(F.col(b_ts).alias("__t"), *[F.col(c).alias(n) for c, n in cols.items()]).alias("__src")
    )
    row = F.struct(*[F.col(c) for c in a.columns])
    limit = window_s if isinstance(window_s, Column) else F.lit(window_s)
    dst = a.select(*on, F.col(a_ts).cast("double").alias("__ts"), F.lit(1).alias("__side"), limit.cast("double").alias("__lim"), row.alias("__row"))
    both = src.unionByName(dst, allowMissingColumns=True)
    hit = ordered.known_around(both, on, ["__ts", "__side"], F.col("__src"), "__b", "__f").where(F.col("__side") == 1)
    d_back, d_forw = F.col("__ts") - F.col("__b.__t"), F.col("__f.__t") - F.col("__ts")
    lim = F.col("__lim")
    ok_b = F.coalesce((d_back < lim) if open_back else (d_back <= lim), F.lit(False))
    ok_f = F.coalesce(d_forw <= lim, F.lit(False))
    pick = F.when(ok_b & (~ok_f | (d_back <= d_forw)), F.col("__b")).when(ok_f, F.col("__f"))
    return hit.withColumn("__pick", pick).select(*[F.col("__row")[c].alias(c) for c in a.columns], *[F.col("__pick")[n].alias(n) for n in names])


def flag_nearest(df: DataFrame, keys: Sequence[str], ts: str, tie: str, anchors: DataFrame, anchor_ts: str, out: str = "is_anchor") -> DataFrame:
    """Flag the row of each key that is closest to the key's anchor instant."""
    dist = df.join(anchors.select(*keys, F.col(anchor_ts).alias("__a")), list(keys))
    best = dist.groupBy(*keys).agg(
        F.min_by(tie, F.struct(F.abs(F.col(ts) - F.col("__a")), F.col(ts), F.col(tie))).alias("__best")
    )
    return (
        df.join(best, list(keys), "left")
        .withColumn(out, F.coalesce(F.col(tie) == F.col("__best"), F.lit(False)))
        .drop("__best")
    )


def between_join(t: DataFrame, spans: DataFrame, on: Sequence[str], ts: str, lo: str, hi: str) -> DataFrame:
    """Rows of each key with ``lo < ts <= hi``."""
    return t.join(spans, list(on)).where((F.col(ts) > F.col(lo)) & (F.col(ts) <= F.col(hi)))


# ------------------------------------------------------------------ grids and fills


def resample_last(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, step: float, out: str | None = None) -> DataFrame:
    """Last value per left-closed, left-labelled bin."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, floor_to(F.col(ts), step).alias("bin_ts"))
        .agg(F.max_by(value, F.struct(F.col(ts), F.col(tie))).alias(out or value))
    )


def per_second(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str) -> DataFrame:
    """Last value per key and second."""
    return resample_last(df, keys, ts, tie, value, 1)


def per_minute_last(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str) -> DataFrame:
    """Last value per key and minute."""
    return resample_last(df, keys, ts, tie, value, MINUTE)


def grid(spans: DataFrame, step: int, lo: str = "lo", hi: str = "hi", out: str = "bin_ts", slice_steps: int = 4096) -> DataFrame:
    """Every multiple of ``step`` in ``[floor(lo), floor(hi)]``.

    Spans are cut into slices first, so no single array grows with the length of a span.
    """
    wide = step * slice_steps
    first, last = floor_to(F.col(lo), step), floor_to(F.col(hi), step)
    sliced = spans.withColumn("__s", F.explode(F.sequence(floor_to(first, wide), floor_to(last, wide), F.lit(wide).cast("long"))))
    a = F.greatest(F.col("__s"), first)
    b = F.least(F.col("__s") + F.lit(wide - step), last)
    return sliced.withColumn(out, F.explode(F.sequence(a, b, F.lit(step).cast("long")))).drop("__s")


def ffill(df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str | None = None, bfill: bool = False) -> DataFrame:
    """Forward fill in time order; ``bfill`` also fills the leading gap.

    Back filling shows the first later value to earlier rows, so it is off by default.
    """
    out = out or value
    filled = ordered.last_known(df, keys, [ts], F.col(value), out, chunk=ordered.time_chunk(ts, DAY))
    if not bfill:
        return filled
    firsts = df.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(ts))).alias("__first"))
    return filled.join(firsts, list(keys), "left").withColumn(out, F.coalesce(F.col(out), F.col("__first"))).drop("__first")


def runs_on(bars: DataFrame, spans: DataFrame, keys: Sequence[str], step: int, first: Column, last: Column) -> DataFrame:
    """Each span of a key cut into runs of marks with one value: ``__from`` to ``__to``, ``step`` apart.

    ``bars``: the keys, ``bin_ts`` and the values that hold from that mark on. Marks before the first bar make a run
    without values. A key has at most span / step bars, so they are ordered in one window; no mark is.
    """
    w = W.partitionBy(*_cols(keys)).orderBy("bin_ts")
    runs = bars.withColumn("__next", F.lead("bin_ts").over(w)).withColumnRenamed("bin_ts", "__at")
    heads = bars.groupBy(*keys).agg(F.min("bin_ts").alias("__next"))
    both = spans.join(runs, list(keys)).unionByName(spans.join(heads, list(keys), "left"), allowMissingColumns=True)
    begin, end = F.greatest(F.col("__at"), first), F.least(F.col("__next") - step, last)
    return both.withColumn("__from", begin).withColumn("__to", end).where("__from <= __to").drop("__at", "__next")


def on_grid(src: DataFrame, spans: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, step: int, out: str = "value", terminate: bool = False) -> DataFrame:
    """Value at or before each grid mark of the key's span.

    Rows count from the first mark that is not before them. Only these bars are shuffled; the marks are written out
    afterwards. ``terminate=True`` (T05) stops carrying at the key's last real quote: later marks are null,
    and ``terminated_at`` holds that instant on every row of the key.
    """
    known = src.where(F.col(ts).isNotNull())
    mark = (F.ceil(F.col(ts) / F.lit(step)) * F.lit(step)).cast("long")
    bars = known.groupBy(*keys, mark.alias("bin_ts")).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(F.col(ts), F.col(tie))).alias("__bar"))
    runs = runs_on(bars, spans, keys, step, floor_to(F.col("lo"), step), floor_to(F.col("hi"), step))
    filled = grid(runs, step, "__from", "__to").select(*spans.columns, "bin_ts", F.col("__bar.v").alias(out))
    if not terminate:
        return filled
    ends = src.groupBy(*keys).agg(F.max(ts).alias("terminated_at"))
    joined = filled.join(ends, list(keys), "left")
    return joined.withColumn(out, F.when(F.col("bin_ts") <= F.col("terminated_at"), F.col(out)))


def offset_bin(df: DataFrame, ts: str, anchor: str, width: int, out: str = "offset_bin") -> DataFrame:
    """Bin number counted from an anchor instant, negative before it."""
    return df.withColumn(out, F.floor((F.col(ts) - F.col(anchor)) / F.lit(width)))


def at_offsets(anchors: DataFrame, src: DataFrame, on: Sequence[str], anchor_ts: str, src_ts: str, value: str, offsets_s: Sequence[int], tie: str | None = None, out: str = "price") -> DataFrame:
    """Value at fixed offsets around each anchor."""
    marks = anchors.withColumn("offset_s", F.explode(F.array(*[F.lit(int(o)).cast("long") for o in offsets_s])))
    marks = marks.withColumn("mark_ts", F.col(anchor_ts) + F.col("offset_s"))
    return asof(marks, src, on, "mark_ts", src_ts, {value: out}, tie)


def bar_moves(bars: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Bar-to-bar difference, a day of bars in a chunk, so a long life at a fine step is not one task."""
    before = ordered.previous(bars, keys, ["bin_ts"], F.col(value), "__before", chunk=ordered.time_chunk("bin_ts", DAY))
    return before.withColumn("diff", F.col(value) - F.col("__before")).drop("__before")


def biggest_jump(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, step: int) -> DataFrame:
    """Largest absolute move between consecutive bins, the earliest on a tie."""
    moves = bar_moves(resample_last(df, keys, ts, tie, value, step), keys, value).where("diff is not null")
    mag = F.round(F.abs("diff"), 9)
    return moves.groupBy(*keys).agg(
        F.max_by("bin_ts", F.struct(mag, -F.col("bin_ts"))).alias("jump_ts"),
        F.max(mag).alias("jump_mag"),
        F.count(F.lit(1)).alias("n_moves"),
    )


# ------------------------------------------------------------------ intervals


def merge_intervals(iv: DataFrame, keys: Sequence[str] = (), start: str = "win_start", end: str = "win_end") -> DataFrame:
    """Union of overlapping or touching intervals: one row per island."""
    day = ordered.time_chunk(start, DAY)
    seen = ordered.running_max(iv, keys, [start, end], F.col(end), "__seen", chunk=day, before=True)
    fresh = F.when(F.col("__seen").isNull() | (F.col(start) > F.col("__seen")), 1).otherwise(0)
    tagged = ordered.running_sum(seen, keys, [start, end], fresh.cast("long"), "island", chunk=day)
    return tagged.groupBy(*keys, "island").agg(
        F.min(start).alias("island_start"),
        F.max(end).alias("island_end"),
        F.count(F.lit(1)).alias("n_merged"),
    ).withColumn("covered_s", F.col("island_end") - F.col("island_start"))


def hour_overlap(iv: DataFrame, tz: str = "UTC", start: str = "win_start", end: str = "win_end") -> DataFrame:
    """Seconds of each interval inside each clock hour, by local weekday (Sunday 0) and hour."""
    h = iv.withColumn("hour_ts", F.explode(F.sequence(floor_to(F.col(start), HOUR), floor_to(F.col(end), HOUR), F.lit(HOUR).cast("long"))))
    secs = F.least(F.col(end), F.col("hour_ts") + HOUR) - F.greatest(F.col(start), F.col("hour_ts"))
    local = F.from_utc_timestamp(F.timestamp_seconds("hour_ts"), tz)
    return (
        h.withColumn("seconds", secs)
        .where("seconds > 0")
        .withColumn("dow", F.dayofweek(local) - 1)
        .withColumn("hour", F.hour(local))
    )


def blocks(df: DataFrame, keys: Sequence[str], ts: str, tie: str, default_s: int = 60) -> DataFrame:
    """Each row's block ends where the next row begins; the last lasts ``default_s``."""
    nxt = ordered.following(df, keys, [ts, tie], F.col(ts), "__next")
    return nxt.withColumn("block_end", F.coalesce(F.col("__next"), F.col(ts) + default_s)).drop("__next")


def gaps(df: DataFrame, keys: Sequence[str], ts: str, tie: str, out: str = "gap_s") -> DataFrame:
    """Seconds since the previous row of the key."""
    prev = ordered.previous(df, keys, [ts, tie], F.col(ts), "__prev")
    return prev.withColumn(out, F.col(ts) - F.col("__prev")).drop("__prev")


def largest_gap(df: DataFrame, keys: Sequence[str], ts: str, tie: str, after: str | None = None) -> DataFrame:
    """Start and end of the longest silence, optionally only after an instant."""
    src = df if after is None else df.where(F.col(ts) >= F.col(after))
    nxt = ordered.following(src, keys, [ts, tie], F.col(ts), "__next").where("__next is not null")
    gap = F.col("__next") - F.col(ts)
    top = nxt.groupBy(*keys).agg(F.max(F.struct(gap.alias("gap_s"), (-F.col(ts)).alias("neg"))).alias("m"))
    return top.select(*keys, (-F.col("m.neg")).alias("gap_start"), (-F.col("m.neg") + F.col("m.gap_s")).alias("gap_end"), F.col("m.gap_s"))


def every_nth(df: DataFrame, keys: Sequence[str], ts: str, tie: str, n: int) -> DataFrame:
    """Every n-th row in order, with the stride and the raw count."""
    raw = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_raw"))
    numbered = ordered.row_number(df, keys, [ts, tie], "__rn")
    kept = numbered.where((F.col("__rn") - 1) % n == 0)
    return kept.join(raw, list(keys)).withColumn("stride", F.lit(n)).drop("__rn")


def even_index(i: Column, total: Column, n: int, rounding: str = "trunc") -> Column:
    """True when 0-based index ``i`` is one of ``n`` evenly spaced ones in ``total`` rows.

    Integer arithmetic only. The ``j``-th pick is ``j*(total-1)/(n-1)``, truncated or rounded.
    """
    span, m = total - 1, F.lit(n - 1)
    if rounding == "trunc":
        j = F.ceil(i * m / span)
        pick = F.floor(j * span / m)
    else:
        j = F.ceil((2 * i - 1) * m / (2 * span))
        pick = F.floor((2 * j * span + m) / (2 * m))
    return (total <= n) | ((pick == i) & (j <= n - 1))


def even_points(df: DataFrame, keys: Sequence[str], ts: str, tie: str, n: int, rounding: str = "trunc") -> DataFrame:
    """At most ``n`` evenly spaced rows per key, first and last included."""
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_raw"))
    numbered = ordered.row_number(df, keys, [ts, tie], "__rn").join(total, list(keys))
    return numbered.where(even_index(F.col("__rn") - 1, F.col("n_raw"), n, rounding)).drop("__rn")


def stage_windows(stages: DataFrame, keys: Sequence[str], end: str, first_start: int) -> DataFrame:
    """Each stage starts where the one before ended (T19). Stages are a handful per key."""
    w = W.partitionBy(*_cols(keys)).orderBy(end)
    return stages.withColumn("stage_start", F.lag(end, 1, first_start).over(w))


def rest_days(days: DataFrame, keys: Sequence[str] = (), day: str = "day") -> DataFrame:
    """The days between a key's first and last match day that are none themselves."""
    span = days.groupBy(*keys).agg(F.min(day).alias("__a"), F.max(day).alias("__b")).where("__a is not null")
    every = span.select(*keys, F.explode(F.sequence("__a", "__b")).alias(day))
    return every.join(days.select(*keys, day), [*keys, day], "left_anti")


def neighbour_days(days: DataFrame, rest: DataFrame, keys: Sequence[str] = (), day: str = "day") -> DataFrame:
    """Nearest earlier and later match day of each rest day of a key; days as epoch-day numbers."""
    src = days.select(*keys, F.col(day).alias("__d"))
    both = asof(rest, src, keys, day, "__d", {"__d": "prev_day"}, chunk_s=366)
    return asof(both, src, keys, day, "__d", {"__d": "next_day"}, forward=True, chunk_s=366)


def period_bands(df: DataFrame, start: str, restart: str, half_s: int = 2700, stoppage_s: int = 300, extra_s: int = 900) -> DataFrame:
    """First half, break, second half and extra time from two observed boundaries."""
    half_end = F.least(F.col(start) + half_s + stoppage_s, F.col(restart))
    full_end = F.col(restart) + half_s + stoppage_s
    edges = [
        ("first", F.col(start), half_end),
        ("break", half_end, F.col(restart)),
        ("second", F.col(restart), full_end),
        ("extra", full_end, full_end + 2 * extra_s),
    ]
    bands = F.array(
        *[F.struct(F.lit(n).alias("band"), lo.alias("band_start"), hi.alias("band_end")) for n, lo, hi in edges]
    )
    return df.withColumn("__b", F.explode(bands)).select(*df.columns, "__b.*")


def price_life(candles: DataFrame, trades: DataFrame, markets: DataFrame, n: int = 600, step: int = MINUTE) -> DataFrame:
    """Minute price line of each market's life.

    Per minute: last trade price, else the midpoint of a two-sided quote in (0, 1]; markets with
    no usable candle fall back to their trades. Filled forward then back; on settled markets the
    run after the last minute with volume is trimmed; clipped to [0, 1]; at most ``n`` points.

    ``candles``: ticker, end_ts, last_price, bid, ask, volume. ``markets``: ticker, settled.
    """
    two_sided = (F.col("bid") > 0) & (F.col("bid") <= 1) & (F.col("ask") > 0) & (F.col("ask") <= 1)
    rung = F.coalesce(F.col("last_price"), F.when(two_sided, (F.col("bid") + F.col("ask")) / 2))
    bars = candles.groupBy("ticker", floor_to(F.col("end_ts"), step).alias("bin_ts")).agg(
        F.avg(rung).alias("price"), F.sum("volume").alias("volume")
    )
    usable = bars.where("price is not null").select("ticker").distinct()
    spare = (
        trades.groupBy("ticker", floor_to(F.col("created_ts"), step).alias("bin_ts"))
        .agg(F.max_by("yes_price_usd", F.struct("created_ts", "trade_id")).alias("price"), F.sum("count_contracts").alias("volume"))
        .join(usable, "ticker", "left_anti")
        .withColumn("source", F.lit("trades"))
    )
    bars = bars.join(usable, "ticker", "left_semi").withColumn("source", F.lit("candles"))
    line = bars.unionByName(spare).join(markets.select("ticker", "settled"), "ticker")
    life = line.groupBy("ticker").agg(
        F.min("bin_ts").alias("lo"),
        F.when(F.first("settled"), F.coalesce(F.max(F.when(F.col("volume") > 0, F.col("bin_ts"))), F.max("bin_ts")))
        .otherwise(F.max("bin_ts"))
        .alias("hi"),
        F.first("source").alias("source"),
    )
    marks = grid(life, step)
    priced = marks.join(line.select("ticker", "bin_ts", "price"), ["ticker", "bin_ts"], "left")
    # A market has life / step marks, so both fills are key windows.
    w = W.partitionBy("ticker").orderBy("bin_ts")
    back = F.last("price", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    forth = F.first("price", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    around = priced.withColumn("__p", F.coalesce(back, forth))
    price = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__p")))
    # The grid is dense, so a mark's number follows from its time.
    i = ((F.col("bin_ts") - F.col("lo")) / step).cast("long")
    total = ((F.col("hi") - F.col("lo")) / step + 1).cast("long")
    numbered = around.select("ticker", "source", "bin_ts", price.alias("price"), i.alias("__i"), total.alias("n_raw"))
    return numbered.where(even_index(F.col("__i"), F.col("n_raw"), n)).drop("__i")
