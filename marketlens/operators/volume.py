"""Volume anatomy: arrival, concentration, populations of fixed-dollar grains.

Trades carry ``ticker, series_ticker, created_ts, trade_id, yes_price_usd, count_contracts,
taker_side``. One contract is one dollar of notional.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marketlens.functions import ordered
from marketlens.operators import temporal as T
from marketlens.session import cut

DAY = 86400
#: Dollars are added up as integer ten-thousandths, so sums do not depend on task order.
SCALE = 10_000


def dollars_of(c: str = "count_contracts") -> Column:
    return F.sum(F.round(F.col(c) * SCALE).cast("long")) / F.lit(float(SCALE))


def _n() -> Column:
    return F.count(F.lit(1))


# ------------------------------------------------------------------ arrival


def daily(t: DataFrame) -> DataFrame:
    """Contracts and trades per UTC day."""
    return t.groupBy(F.floor(F.col("created_ts") / DAY).alias("day")).agg(dollars_of().alias("contracts"), _n().alias("n_trades"))


def pulse(t: DataFrame, tz: str = "UTC") -> DataFrame:
    """Hour by weekday in a zone, Sunday 0."""
    local = F.from_utc_timestamp(F.timestamp_seconds("created_ts"), tz)
    return t.groupBy((F.dayofweek(local) - 1).alias("dow"), F.hour(local).alias("hour")).agg(dollars_of().alias("contracts"), _n().alias("n_trades"))


def pulse_grid(p: DataFrame) -> DataFrame:
    """One row per weekday with 24 hour columns; empty cells are zero."""
    g = p.groupBy("dow").pivot("hour", list(range(24))).agg(F.sum("contracts"))
    return g.select("dow", *[F.coalesce(F.col(str(h)), F.lit(0.0)).alias(f"h{h:02d}") for h in range(24)])


def family_daily(t: DataFrame, ref: DataFrame) -> DataFrame:
    """Daily contracts by family."""
    return (
        t.join(ref.select("ticker", "family"), "ticker")
        .groupBy(F.floor(F.col("created_ts") / DAY).alias("day"), "family")
        .agg(dollars_of().alias("contracts"), _n().alias("n_trades"))
    )


def market_totals(t: DataFrame) -> DataFrame:
    """Dollars, trades, first and last trade per market."""
    return t.groupBy("ticker").agg(
        dollars_of().alias("dollars"), _n().alias("n_trades"), F.min("created_ts").alias("first_ts"), F.max("created_ts").alias("last_ts")
    )


def series_totals(t: DataFrame) -> DataFrame:
    """Series totals with distinct markets.

    Markets are totalled first: the distinct count is then a plain count of a far smaller frame.
    """
    per_market = t.groupBy("series_ticker", "ticker").agg(
        F.sum(F.round(F.col("count_contracts") * SCALE).cast("long")).alias("s"), _n().alias("n"), F.min("created_ts").alias("a"), F.max("created_ts").alias("b")
    )
    return per_market.groupBy("series_ticker").agg(
        (F.sum("s") / float(SCALE)).alias("dollars"), F.sum("n").alias("n_trades"), _n().alias("n_markets"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts")
    )


def never_traded(catalog: DataFrame, traded: DataFrame, key: str) -> DataFrame:
    """Listed markets without a trade: count and share."""
    marked = catalog.select(key).join(traded.select(key).distinct().withColumn("__t", F.lit(1)), key, "left")
    return marked.agg(_n().alias("n_listed"), F.count_if(F.col("__t").isNull()).alias("n_never")).withColumn(
        "share_never", F.col("n_never") / F.col("n_listed")
    )


def window_sums(t: DataFrame, ranges: DataFrame, on: Sequence[str] = (), start: str = "win_start", end: str = "win_end", ts: str = "created_ts") -> DataFrame:
    """Contracts and trades with ``start <= ts <= end`` for each range of its key, whatever the ranges share.

    A range's volume is the running sum of its key at the end less that just before the start. Both are as-of
    lookups on one row per key and second, so a range costs two lookups however many trades it covers or ranges
    overlap it; no pair of a trade and a range is built. Dollars are summed as integers of a ten-thousandth. A range
    without trades has 0 and 0. Ranges with null bounds keep null sums; ranges that are equal throughout are one.
    """
    unit = F.round(F.col("count_contracts") * 10000).cast("long")
    seconds = t.groupBy(*on, F.col(ts).alias("__s")).agg(F.sum(unit).alias("__m"), _n().alias("__n"))
    run = ordered.running_sum(seconds, on, ["__s"], F.col("__m"), "__cm", chunk=ordered.time_chunk("__s", DAY))
    run = ordered.running_sum(run, on, ["__s"], F.col("__n"), "__cn", chunk=ordered.time_chunk("__s", DAY))
    ends = F.array(F.struct(F.lit(-1).alias("sign"), (F.col(start) - 1).alias("at")), F.struct(F.lit(1).alias("sign"), F.col(end).alias("at")))
    marks = ranges.select(F.struct(*ranges.columns).alias("__range"), *on, F.explode(ends).alias("__e")).select("__range", *on, F.col("__e.sign").alias("__sign"), F.col("__e.at").alias("__at"))
    hit = T.asof(marks, run, on, "__at", "__s", {"__cm": "__cm", "__cn": "__cn"})
    known = F.col("__at").isNotNull()
    copies = F.count(F.lit(1)) / 2
    total = lambda c: F.when(F.min(known), F.sum(F.col("__sign") * F.coalesce(F.col(c), F.lit(0))) / copies)
    both = hit.groupBy("__range").agg((total("__cm") / 10000).alias("contracts"), total("__cn").cast("long").alias("n_trades"))
    return both.select("__range.*", "contracts", "n_trades")


def window_split(t: DataFrame, windows: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Inside or outside any match window (V07): the sums of the windows' islands, and the rest of the tape.

    A side without trades has no row.
    """
    inside = window_sums(t, T.merge_intervals(windows, on), on, "island_start", "island_end")
    inside = inside.agg(F.sum(F.round(F.col("contracts") * 10000).cast("long")).alias("m"), F.sum("n_trades").alias("n")).na.fill(0)
    side = lambda flag, m, n: F.struct(F.lit(flag).alias("in_window"), m.alias("m"), n.alias("n"))
    moved = inside.select(F.explode(F.array(side(True, F.col("m"), F.col("n")), side(False, -F.col("m"), -F.col("n")))).alias("r")).select("r.*")
    every = t.agg(F.sum(F.round(F.col("count_contracts") * 10000).cast("long")).alias("m"), _n().alias("n")).select(F.lit(False).alias("in_window"), "m", "n")
    both = moved.unionByName(every).groupBy("in_window").agg(F.sum("m").alias("m"), F.sum("n").alias("n_trades"))
    return both.where("n_trades > 0").select("in_window", (F.col("m") / 10000).alias("contracts"), "n_trades")


def window_volume(t: DataFrame, windows: DataFrame, on: Sequence[str] = (), mode: str = "latest") -> DataFrame:
    """Volume per match window.

    ``latest``: an overlap belongs to the later start. ``all``: each window has all it covers, overlaps in each of
    them. Both sum by ``window_sums``, the first over the disjoint parts that the windows own. Windows without a trade
    have no row.
    """
    if mode == "all":
        sums = window_sums(t, windows.select(*on, "event", "win_start", "win_end"), on)
    else:
        sums = window_sums(t, T.segments(windows, "event", "win_start", "win_end", on), on, "seg_start", "seg_end")
    return sums.where("n_trades > 0").select("event", "contracts", "n_trades")


# ------------------------------------------------------------------ cumulative series


def _running(day_frame: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    # Day-level rows: one per calendar day and key.
    return ordered.running_sum(day_frame, keys, ["day"], F.col(value), out, chunk=F.floor(F.col("day") / 366))


def crossover(day_family: DataFrame, a: str, b: str) -> DataFrame:
    """First day the running total of ``a`` passes ``b``, and the first single day it does.

    ``day_family``: day, family, contracts.
    """
    wide = day_family.groupBy("day").agg(
        F.sum(F.when(F.col("family") == a, F.col("contracts")).otherwise(0.0)).alias("a"),
        F.sum(F.when(F.col("family") == b, F.col("contracts")).otherwise(0.0)).alias("b"),
    )
    cum = _running(_running(wide, [], "a", "cum_a"), [], "b", "cum_b")
    ahead = F.round(F.col("cum_a"), 4) > F.round(F.col("cum_b"), 4)
    return cum.agg(F.min(F.when(ahead, F.col("day"))).alias("cumulative_day"), F.min(F.when(F.col("a") > F.col("b"), F.col("day"))).alias("daily_day"))


def dense_cumulative(day_bucket: DataFrame, buckets: Sequence[str]) -> DataFrame:
    """Running totals per bucket over every calendar day, missing days counting zero.

    ``day_bucket``: day, bucket, contracts. ``buckets`` is the short fixed list of names.
    """
    span = day_bucket.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    cells = days.withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in buckets])))
    per = day_bucket.groupBy("day", "bucket").agg(F.sum("contracts").alias("contracts"))
    full = cells.join(per, ["day", "bucket"], "left").withColumn("contracts", F.coalesce("contracts", F.lit(0.0)))
    return _running(full, ["bucket"], "contracts", "cumulative")


def cumulative_pct(day_frame: DataFrame) -> DataFrame:
    """Running total and its share of the whole per day."""
    total = day_frame.agg(F.sum("contracts")).scalar()
    return _running(day_frame, [], "contracts", "cumulative").withColumn("cum_pct", F.col("cumulative") / total * 100)


def day_against_baseline(day_frame: DataFrame, day: int, lo: int, hi: int) -> DataFrame:
    """A day's contracts beside the mean of its neighbourhood without it."""
    near = F.col("day").between(lo, hi) & (F.col("day") != day)
    return day_frame.agg(
        F.max(F.when(F.col("day") == day, F.col("contracts"))).alias("contracts"), F.avg(F.when(near, F.col("contracts"))).alias("baseline")
    )


# ------------------------------------------------------------------ concentration


def value_steps(totals: DataFrame, value: str = "dollars") -> DataFrame:
    """Distinct totals in rising order: how many items and how much lies below each one.

    Columns: x, c (items at x), n_before, x_before (their sum). Equal values are merged first, so
    the ordered pass sees distinct values only, and it runs in value chunks. The merged values are
    written once: the tape behind ``totals`` is scanned a single time.
    """
    steps = cut(totals.groupBy(F.col(value).alias("x")).agg(_n().alias("c")))
    chunk = ordered.value_chunk("x")
    a = ordered.running_sum(steps, [], ["x"], F.col("c"), "n_upto", chunk)
    b = ordered.running_sum(a, [], ["x"], F.col("c") * F.round(F.col("x") * SCALE).cast("long"), "u_upto", chunk)
    return b.select(
        "x",
        "c",
        (F.col("n_upto") - F.col("c")).alias("n_before"),
        (F.col("u_upto") / float(SCALE) - F.col("c") * F.col("x")).alias("x_before"),
    )


def _gini_parts(totals: DataFrame, value: str) -> DataFrame:
    s = value_steps(totals, value)
    c, x = F.col("c").cast("double"), F.col("x")
    ranked = x * (c * F.col("n_before") + c * (c + 1) / 2)
    return s.agg(F.sum(ranked).alias("s"), F.sum(c * x).alias("t"), F.sum(c).alias("n"), F.min("x").alias("lo"))


def gini(totals: DataFrame, value: str = "dollars") -> DataFrame:
    """Gini coefficient in its closed form over ranks."""
    n, s, t = F.col("n"), F.col("s"), F.col("t")
    return _gini_parts(totals, value).select(n.cast("long").alias("n"), (2 * s / (n * t) - (n + 1) / n).alias("gini"))


def gini_trapezoid(totals: DataFrame, value: str = "dollars") -> DataFrame:
    """Gini by trapezoids between the Lorenz points.

    The first point is the smallest market, not the origin, so the value is a little above V12's.
    """
    n, s, t, lo = F.col("n"), F.col("s"), F.col("t"), F.col("lo")
    heights = (n + 1) - s / t
    return _gini_parts(totals, value).select(n.cast("long").alias("n"), (1 - (2 * heights - lo / t - 1) / n).alias("gini"))


def lorenz(totals: DataFrame, n_points: int, value: str = "dollars") -> DataFrame:
    """Ascending Lorenz curve at ``n_points`` evenly spaced ranks."""
    totals = cut(totals.select(value))
    steps = value_steps(totals, value)
    size = totals.agg(_n().alias("n"), F.sum(value).alias("t"))
    j = F.explode(F.sequence(F.lit(0), F.lit(n_points - 1)))
    picks = size.withColumn("j", j).select(
        "n", "t", F.when(F.col("n") <= n_points, F.col("j")).otherwise(F.floor(F.col("j") * (F.col("n") - 1) / F.lit(n_points - 1))).cast("long").alias("i")
    )
    picks = picks.where("i < n").distinct()
    hit = T.asof(picks, steps, [], "i", "n_before", {"x": "x", "n_before": "nb", "x_before": "xb"}, chunk_s=1_000_000)
    cum = F.col("xb") + (F.col("i") - F.col("nb") + 1) * F.col("x")
    return hit.select(F.col("i").alias("idx"), ((F.col("i") + 1) / F.col("n")).alias("share_markets"), (cum / F.col("t")).alias("share_volume"))


def top_shares(totals: DataFrame, ns: Sequence[int], value: str = "dollars") -> DataFrame:
    """Share of the largest N for each N, and of the lower half, in one aggregate."""
    totals = cut(totals.select(value))
    steps = value_steps(totals, value)
    n_all = totals.agg(_n()).scalar()
    above = n_all - F.col("n_before") - F.col("c")  # items larger than x
    taken = lambda k: F.greatest(F.lit(0), F.least(F.col("c"), F.lit(k) - above)) * F.col("x")
    half = F.floor(n_all / 2)
    low = F.greatest(F.lit(0), F.least(F.col("c"), half - F.col("n_before"))) * F.col("x")
    row = steps.agg(
        F.sum(F.col("c") * F.col("x")).alias("t"), F.sum(F.col("c")).alias("n"), F.sum(low).alias("low"), *[F.sum(taken(k)).alias(f"k{k}") for k in ns]
    )
    parts = [F.struct(F.lit(f"top_{k}").alias("slice"), F.when(F.col("n") >= k, F.col(f"k{k}") / F.col("t") * 100).alias("share_pct")) for k in ns]
    parts.append(F.struct(F.lit("lower_half").alias("slice"), (F.col("low") / F.col("t") * 100).alias("share_pct")))
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("share_pct is not null")


def rank_of(totals: DataFrame, subjects: DataFrame, group: Column, names: Sequence[str], value: str = "dollars") -> DataFrame:
    """How many markets of each named group each subject stands above and below.

    ``subjects``: ticker. Per group the distinct values carry a running count, and a subject looks
    its own value up with an as-of join; rank = 1 + sum of ``n_above`` over all groups.
    """
    totals = cut(totals.select("ticker", F.col(value), group.alias("grp")))
    steps = totals.groupBy("grp", F.col(value).alias("x")).agg(_n().alias("c"))
    steps = ordered.running_sum(steps, ["grp"], ["x"], F.col("c"), "n_upto", ordered.value_chunk("x"))
    sizes = totals.groupBy("grp").agg(_n().alias("n_group"))
    look = totals.join(subjects.select("ticker"), "ticker", "left_semi").select(
        "ticker", F.col(value).alias("sv"), F.explode(F.array(*[F.lit(n) for n in names])).alias("grp")
    )
    hit = T.asof(look, steps, ["grp"], "sv", "x", {"x": "hx", "c": "hc", "n_upto": "le"}, chunk_s=1_000_000)
    le = F.coalesce("le", F.lit(0))
    same = F.when(F.col("hx") == F.col("sv"), F.col("hc")).otherwise(0)
    return hit.join(sizes, "grp").select(
        "ticker", "grp", (F.col("n_group") - le).alias("n_above"), (le - same).alias("n_below"), "n_group"
    )


def core_series(totals: DataFrame, ref: DataFrame, k: int = 3) -> DataFrame:
    """Share and leg count of the k largest series, and the Gini inside them."""
    totals = cut(totals)
    with_series = totals.join(ref.select("ticker", "series_ticker"), "ticker")
    per = with_series.groupBy("series_ticker").agg(F.sum("dollars").alias("d"), _n().alias("legs"))
    top = per.orderBy(F.desc("d"), "series_ticker").limit(k)
    grand = totals.agg(F.sum("dollars")).scalar()
    head = top.agg((F.sum("d") / grand * 100).alias("core_share_pct"), F.sum("legs").alias("core_legs"))
    inner = gini_trapezoid(with_series.join(top.select("series_ticker"), "series_ticker", "left_semi")).select(F.col("gini").alias("gini_within"))
    return head.withColumn("gini_within", inner.scalar())


# ------------------------------------------------------------------ buckets and sizes


def bucket_stats(t: DataFrame, bucket: Column) -> DataFrame:
    """Contracts, share, trades and taker-yes share per named bucket."""
    g = t.groupBy(bucket.alias("bucket")).agg(
        dollars_of().alias("contracts"), _n().alias("n_trades"), F.avg(F.when(F.col("taker_side") == "yes", 1.0).otherwise(0.0)).alias("taker_yes_share")
    )
    total = t.agg(dollars_of()).scalar()
    return g.withColumn("share", F.col("contracts") / total)


def size_stats(t: DataFrame, block: float) -> DataFrame:
    """Median, mean and block-trade count per market."""
    med = ordered.quantiles(t, ["ticker"], "count_contracts", [0.5], ["median_size"])
    rest = t.groupBy("ticker").agg(
        dollars_of().alias("dollars"), _n().alias("n_trades"), F.count_if(F.col("count_contracts") >= block).alias("n_blocks")
    ).withColumn("mean_size", F.col("dollars") / F.col("n_trades"))
    return rest.join(med, "ticker")


def multiples(totals: DataFrame, base: str = "ticker", value: str = "dollars", by: str = "match_id") -> DataFrame:
    """Each leg's total as a multiple of the smallest leg of its match."""
    lows = totals.groupBy(by).agg(F.min(value).alias("__lo"))
    return totals.join(lows, by).withColumn("multiple", F.col(value) / F.col("__lo")).drop("__lo")


def around_dates(day_frame: DataFrame, dates: DataFrame, days: int = 3) -> DataFrame:
    """Mean daily volume within ±days of each date, with the sources of that date.

    ``dates``: day, source. Each date meets at most ``2*days+1`` calendar days by equi-join.
    """
    names = dates.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))
    near = names.withColumn("d", F.explode(F.sequence(F.col("day") - days, F.col("day") + days)))
    vol = day_frame.select(F.col("day").alias("d"), "contracts")
    return near.join(vol, "d", "left").groupBy("day", "sources").agg(F.avg("contracts").alias("mean_contracts"))


def window_multiple(day_frame: DataFrame, busy: tuple[int, int], quiet: tuple[int, int]) -> DataFrame:
    """Mean daily volume of one window over another's."""
    mean = lambda w: F.avg(F.when(F.col("day").between(*w), F.col("contracts")))
    return day_frame.agg(mean(busy).alias("busy"), mean(quiet).alias("quiet")).withColumn("multiple", F.col("busy") / F.col("quiet"))


# ------------------------------------------------------------------ clock and schedule


def schedule_residual(t: DataFrame, windows: DataFrame, tz: str, band: tuple[int, int]) -> DataFrame:
    """Money by local hour against a null model that pays per scheduled second."""
    money = pulse(t, tz).groupBy("hour").agg(F.sum("contracts").alias("money"))
    credit = T.hour_overlap(windows, tz).groupBy("hour").agg(F.sum("seconds").alias("credit_s"))
    hours = t.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    both = hours.join(money, "hour", "left").join(credit, "hour", "left").na.fill(0)
    tm, tc = both.agg(F.sum("money")).scalar(), both.agg(F.sum("credit_s")).scalar()
    both = both.withColumn("credit", F.col("credit_s") * tm / tc)
    return both.select("hour", "money", "credit", F.col("hour").between(*band).alias("waking"))


def waking_residual(hours: DataFrame) -> DataFrame:
    """Share of money over share of credit inside the waking band."""
    return hours.agg((F.sum(F.when(F.col("waking"), F.col("money"))) / F.sum(F.when(F.col("waking"), F.col("credit")))).alias("waking_residual"))


def tilt(t: DataFrame, windows: DataFrame, spans: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Window money share over clock coverage (V23); ``spans`` (lo, hi) are the times that the windows could cover."""
    split = window_split(t, windows, on).agg(F.sum(F.when(F.col("in_window"), F.col("contracts"))).alias("w"), F.sum("contracts").alias("t"))
    cover = T.merge_intervals(windows, on).agg(F.sum("covered_s")).scalar() / spans.agg(F.sum(F.col("hi") - F.col("lo"))).scalar()
    return split.select((F.col("w") / F.col("t")).alias("money_share"), cover.alias("coverage")).withColumn("tilt", F.col("money_share") / F.col("coverage"))


def rest_ratios(day_frame: DataFrame, match_days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the nearest match days over each rest day's volume, per key."""
    near = T.neighbour_days(match_days, T.rest_days(match_days, keys), keys)
    vol = day_frame.select(*keys, "day", "contracts")
    look = lambda c: vol.select(*keys, F.col("day").alias(c), F.col("contracts").alias(f"v_{c}"))
    j = near.join(look("prev_day"), [*keys, "prev_day"], "left").join(look("next_day"), [*keys, "next_day"], "left").join(vol, [*keys, "day"], "left")
    sides = (F.coalesce("v_prev_day", F.lit(0.0)) + F.coalesce("v_next_day", F.lit(0.0))) / 2
    return j.where("contracts > 0").select(*keys, "day", (sides / F.col("contracts")).alias("ratio"))


def rate_curve(t: DataFrame, width_s: int) -> DataFrame:
    """Trades and mean size per bucket since the market's first trade."""
    first = t.groupBy("ticker").agg(F.min("created_ts").alias("t0"))
    b = T.offset_bin(t.join(first, "ticker"), "created_ts", "t0", width_s)
    return b.groupBy("ticker", "offset_bin").agg(_n().alias("n_trades"), F.avg("count_contracts").alias("mean_size"))


def rate_step(t: DataFrame, anchors: DataFrame) -> DataFrame:
    """Trades per second in the hour before and after an instant, and the peak minute.

    ``anchors``: ticker, anchor_ts.
    """
    per_min = t.groupBy("ticker", F.floor(F.col("created_ts") / 60).alias("m")).agg(_n().alias("n"))
    peak = per_min.groupBy("ticker").agg(F.max("n").alias("peak_n"))
    rel = F.col("created_ts") - F.col("anchor_ts")
    sides = t.join(anchors.select("ticker", "anchor_ts").distinct(), "ticker").groupBy("ticker", "anchor_ts").agg(
        F.count_if((rel >= -3600) & (rel < 0)).alias("n_before"), F.count_if((rel >= 0) & (rel < 3600)).alias("n_after")
    )
    return sides.join(peak, "ticker").select(
        "ticker",
        "anchor_ts",
        "n_before",
        "n_after",
        F.when(F.col("n_before") > 0, F.col("n_after") / F.col("n_before")).alias("step_multiple"),
        (F.col("peak_n") / 60).alias("peak_rate_per_s"),
    )


# ------------------------------------------------------------------ populations


def grain_population(t: DataFrame, grain: int, closing: str = "next", chunk_s: int = 3600) -> DataFrame:
    """One row per fixed-dollar grain of each market's own tape.

    The market's running dollars decide the bucket: ``ceil(running / grain) - 1``. The trade that
    crosses a boundary falls into the next bucket, so numbers can skip; ``closing="inclusive"``
    keeps it in the bucket it closes. Markets below one grain have no rows. The running sum is in
    integer units and split in time chunks, so it is exact and a single hot market is spread.
    """
    unit = F.round(F.col("count_contracts") * SCALE).cast("long")
    base = t.select("ticker", "created_ts", "trade_id", unit.alias("u"), "yes_price_usd", "taker_side")
    whole = base.groupBy("ticker").agg(F.sum("u").alias("__total")).where(F.col("__total") >= grain * SCALE)
    base = base.join(whole.select("ticker"), "ticker", "left_semi")
    run = ordered.running_sum(base, ["ticker"], ["created_ts", "trade_id"], F.col("u"), "cum", chunk=ordered.time_chunk("created_ts", chunk_s))
    g = F.lit(grain * SCALE)
    at = F.col("cum") if closing == "next" else F.col("cum") - F.col("u") + 1
    bucket = F.expr(f"CAST((__at + {grain * SCALE - 1}) DIV {grain * SCALE} AS BIGINT)") - 1
    run = run.withColumn("__at", at).withColumn("bucket", bucket)
    u = F.col("u")
    # A bucket of zero-dollar trades alone has no mean: NaN, as 0/0 of doubles is.
    per_unit = lambda c: F.when(F.col("__u") == 0, F.lit(float("nan"))).otherwise(F.try_divide(c, "__u"))
    return (
        run.groupBy("ticker", "bucket")
        .agg(
            F.sum(u).alias("__u"),
            F.max("created_ts").alias("birth_ts"),
            F.sum(u * F.col("yes_price_usd")).alias("__pv"),
            F.sum(F.when(F.col("taker_side") == "yes", u).otherwise(0)).alias("__yes"),
            _n().alias("n_trades"),
        )
        .select(
            "ticker",
            "bucket",
            (F.col("__u") / float(SCALE)).alias("dollars"),
            "birth_ts",
            per_unit("__pv").alias("vwap_yes"),
            per_unit("__yes").alias("frac_yes"),
            "n_trades",
        )
    )


def dot_attributes(pop: DataFrame, meta: DataFrame) -> DataFrame:
    """Price band (half-even cents), majority side, family, fate and flags per dot.

    ``meta``: ticker, family_idx, fate_idx, flags, market_idx; absent markets default to zero.
    """
    cents = F.bround(F.coalesce("vwap_yes", F.lit(0.5)) * 100, 0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return pop.join(meta, "ticker", "left").select(
        "ticker",
        "bucket",
        "birth_ts",
        "dollars",
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), cents)).cast("int").alias("price_band"),
        F.when(F.coalesce("frac_yes", F.lit(0.5)) >= 0.5, 1).otherwise(0).alias("side"),
        zero("family_idx"),
        zero("fate_idx"),
        zero("flags"),
        "market_idx",
    )


def _ticker_chunk(df: DataFrame, prefix: int = 16) -> Column:
    """Ranges in ticker order: of numbers, or of the first characters of a text."""
    text = isinstance(df.schema["ticker"].dataType, StringType)
    return F.substring("ticker", 1, prefix) if text else F.floor(F.col("ticker") / 10_000)


def market_index(totals: DataFrame, grain: float, prefix: int = 16) -> DataFrame:
    """0-based index of the qualifying markets in ticker order, shared by all grains.

    The ordered pass is chunked by ranges of a numeric ticker, or by the first ``prefix`` characters of a text.
    """
    q = totals.where(F.col("dollars") >= grain).select("ticker")
    out = ordered.row_number(q, [], ["ticker"], "__rn", chunk=_ticker_chunk(q, prefix))
    return out.select("ticker", (F.col("__rn") - 1).alias("market_idx"))


def strata(totals: DataFrame, meta: DataFrame, grain: float) -> DataFrame:
    """Markets and dollars below one grain by family."""
    j = totals.where(F.col("dollars") < grain).join(meta.select("ticker", "family_idx"), "ticker", "left")
    return j.groupBy(F.coalesce("family_idx", F.lit(0)).alias("family_idx")).agg(_n().alias("n_markets"), F.sum("dollars").alias("dollars"))


def census(totals: DataFrame, grain: float) -> DataFrame:
    """Whole-tape totals and the below-grain remainder."""
    low = F.col("dollars") < grain
    return totals.agg(
        F.sum("dollars").alias("total_usd"),
        F.sum("n_trades").alias("total_trades"),
        F.count_if(low).alias("below_markets"),
        F.coalesce(F.sum(F.when(low, F.col("dollars"))), F.lit(0.0)).alias("below_usd"),
    )


def lower_half(totals: DataFrame, grain: float = 0) -> DataFrame:
    """Tag the lower half, by dollars, of the qualifying markets (V30): rank <= floor(n / 2)."""
    q = cut(totals.where(F.col("dollars") >= grain))
    n = q.agg(_n()).scalar()
    # Rank below a value from counts per value, position inside it by ranges of the ticker: no value is one task.
    inside = ordered.row_number(q, ["dollars"], ["ticker"], "__pos", chunk=_ticker_chunk(q))
    below = value_steps(q, "dollars").select(F.col("x").alias("dollars"), "n_before")
    ranked = inside.join(below, "dollars").withColumn("rank", F.col("n_before") + F.col("__pos")).drop("n_before", "__pos")
    return ranked.withColumn("in_lower_half", F.col("rank") <= F.floor(n / 2))


def top_markets(totals: DataFrame, n: int) -> DataFrame:
    """The n largest markets."""
    return totals.orderBy(F.desc("dollars"), "ticker").limit(n)


def pre_cutoff(t: DataFrame, legs: DataFrame, cutoff: int) -> DataFrame:
    """Contracts and last price before a cutoff, and the price over the model's odds.

    ``legs``: ticker, model_pct.
    """
    early = t.where(F.col("created_ts") < cutoff).join(legs, "ticker")
    g = early.groupBy("ticker", "model_pct").agg(dollars_of().alias("contracts"), F.max_by("yes_price_usd", F.struct("created_ts", "trade_id")).alias("last_price"))
    return g.withColumn("price_ratio", F.when(F.col("model_pct") > 0, F.col("last_price") * 100 / F.col("model_pct")))


def book_devig(t: DataFrame, legs: DataFrame, by: str = "match_id") -> DataFrame:
    """Last price of every leg as a share of its book's sum."""
    last = t.groupBy("ticker").agg(F.max_by("yes_price_usd", F.struct("created_ts", "trade_id")).alias("last_price"))
    j = last.join(legs.select("ticker", by), "ticker")
    total = F.sum("last_price").over(W.partitionBy(by))
    return j.withColumn("book_sum", total).withColumn("share", F.when(total > 0, F.col("last_price") / total))


def new_book(listing: DataFrame, t: DataFrame, previous_settle: Column) -> DataFrame:
    """First trade, first price, trades and dollars of each listed market, and the listing gap.

    ``listing``: ticker, listed_ts.
    """
    g = t.groupBy("ticker").agg(
        F.min("created_ts").alias("first_ts"), F.min_by("yes_price_usd", F.struct("created_ts", "trade_id")).alias("first_price"), _n().alias("n_trades"), dollars_of().alias("dollars")
    )
    return listing.join(g, "ticker", "left").withColumn("gap_s", F.col("listed_ts") - previous_settle)


def final_bucket(t: DataFrame, width_s: int = 1800) -> DataFrame:
    """Trades, plain mean and volume-weighted mean in the bucket of each market's last trade."""
    ends = t.groupBy("ticker").agg(T.floor_to(F.max("created_ts"), width_s).alias("lo"))
    late = t.join(ends, "ticker").where((F.col("created_ts") >= F.col("lo")) & (F.col("created_ts") < F.col("lo") + width_s))
    w = F.sum("count_contracts")
    return late.groupBy("ticker", "lo").agg(
        _n().alias("n_trades"), F.avg("yes_price_usd").alias("mean_price"), F.when(w == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.sum(F.col("yes_price_usd") * F.col("count_contracts")), w)).alias("vwap")
    )


def daily_mean(t: DataFrame) -> DataFrame:
    """Plain mean price per market and day."""
    return t.groupBy("ticker", F.floor(F.col("created_ts") / DAY).alias("day")).agg(_n().alias("n_trades"), F.avg("yes_price_usd").alias("mean_price"))


def climb(t: DataFrame, spans: DataFrame, step: int = 60) -> DataFrame:
    """Two legs on one minute clock with progress percent.

    ``spans``: match_id, ticker, leg, lo, hi.
    """
    on = T.on_grid(t, spans, ["ticker"], "created_ts", "trade_id", "yes_price_usd", step, "price")
    minute = F.floor((F.col("bin_ts") - T.floor_to(F.col("lo"), step)) / step)
    n = F.floor((T.floor_to(F.col("hi"), step) - T.floor_to(F.col("lo"), step)) / step)
    return on.groupBy("match_id", minute.alias("minute"), (minute / F.greatest(n, F.lit(1)) * 100).alias("progress_pct")).agg(
        F.max(F.when(F.col("leg") == "tie", F.col("price"))).alias("tie_price"), F.max(F.when(F.col("leg") == "team1", F.col("price"))).alias("team1_price")
    )


def family_breakdown(markets: DataFrame, family: str, value: Column) -> DataFrame:
    """Series, markets and volume per family."""
    return markets.groupBy(family).agg(F.countDistinct("series").alias("n_series"), _n().alias("n_markets"), F.sum(value).alias("volume"))


def arrival_rank(pop: DataFrame, bucket: str) -> DataFrame:
    """0-based arrival position of each dot in its bucket."""
    r = ordered.row_number(pop, [bucket], ["birth_ts", "ticker", "bucket"], "__rn", chunk=ordered.time_chunk("birth_ts"))
    return r.withColumn("arrival_rank", F.col("__rn") - 1).drop("__rn")


def rank_intervals(pop: DataFrame) -> DataFrame:
    """Markets by rising dot count with the share interval each one covers."""
    per = cut(pop.groupBy("ticker").agg(_n().alias("c")))
    # Dot counts are few values, and most markets share one: each is cut by ticker.
    chunk = F.struct(F.col("c").alias("v"), _ticker_chunk(per).alias("t"))
    total = per.agg(F.sum("c")).scalar()
    r = ordered.running_sum(per, [], ["c", "ticker"], F.col("c"), "upto", chunk)
    return r.select("ticker", F.col("c").alias("n_dots"), ((F.col("upto") - F.col("c")) / total).alias("lo_frac"), (F.col("upto") / total).alias("hi_frac"))


def cell_quantile(counts: DataFrame, value: str, p: float) -> DataFrame:
    """Value at sorted index ``floor(p * n)`` of the non-zero counts; no interpolation."""
    pos = cut(counts.where(F.col(value) > 0).select(value))
    steps = value_steps(pos, value)
    n = pos.agg(_n()).scalar()
    k = F.least(n - 1, F.floor(n * p))
    return steps.where((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("c"))).select(F.col("x").alias("cell_value"))
