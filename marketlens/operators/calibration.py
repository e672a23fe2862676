"""Calibration and scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.functions import ordered
from marketlens.operators import temporal as T
from marketlens.session import cut

#: Fixed values of the scoring rules and the divergence screen.
LOG_CLIP = 1e-4
GAP_FLOOR = 0.0015
GAP_THRESHOLD = 0.05
SUSTAIN_STEPS = 30


def _n() -> Column:
    return F.count(F.lit(1))


#: Inverse prices are summed in units of 1e-12.
_UNIT = 1e12


def devig_async(q: DataFrame, market: Sequence[str], outcome: str, ms: str = "created_ms", tie: str = "quote_id", price: str = "price_decimal", active: str = "active") -> DataFrame:
    """De-vig quotes whose outcomes move at different instants.

    The overround at a quote's own millisecond is the sum of the latest known inverse prices over the outcomes of
    its market that are active then, and the quote's probability is its own inverse price over that sum. Adds
    ``overround_at_ts`` and ``prob_devig`` (null while the outcome is inactive). A price of 0 or less is not live. No
    quote is lost: null markets and outcomes stand for themselves, and a quote without a time gets nulls.
    """
    # Linear in quotes: each outcome's change of inverse price, summed along its market. Integers keep the sums exact.
    chunk = ordered.time_chunk(ms, 3_600_000)
    # Null markets and outcomes are markets and outcomes: their rows come back by filled keys.
    m, o = [f"__m{i}" for i in range(len(market))], "__o"
    filled = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    q = q.withColumns({**{k: filled(c) for k, c in zip(m, market, strict=True)}, o: filled(outcome)})
    live = F.when(F.col(active) & (F.col(price) > 0), F.round(F.try_divide(F.lit(_UNIT), F.col(price))).cast("long"))
    state = q.groupBy(*m, o, ms).agg(F.max_by(F.struct(live.alias("x")), F.col(tie)).alias("__s")).withColumn("__x", F.col("__s.x"))
    moved = ordered.previous(state, [*m, o], [ms], F.coalesce("__x", F.lit(0)), "__before", chunk=chunk)
    step = moved.groupBy(*m, ms).agg(F.sum(F.coalesce("__x", F.lit(0)) - F.coalesce("__before", F.lit(0))).alias("__d"))
    over = ordered.running_sum(step, m, [ms], F.col("__d"), "__over", chunk=chunk).drop("__d")
    out = q.join(state.drop("__s"), [*m, o, ms], "left").join(over, [*m, ms], "left").select(*[c for c in q.columns if c not in (*m, o)], "__x", "__over")
    out = out.withColumn("overround_at_ts", F.col("__over") / _UNIT)
    return out.withColumn("prob_devig", F.when(F.col("__over") > 0, F.col("__x") / F.col("__over"))).drop("__x", "__over")


def stack_sources(sources: Mapping[str, tuple[DataFrame, str, str, str]], key: str) -> DataFrame:
    """Sources in one long frame. Values: ``(frame, ts column, value column, tie column)``.

    Ties keep their type; where sources differ in it, all become strings.
    """
    mixed = len({df.schema[tie].dataType.simpleString() for df, _, _, tie in sources.values()}) > 1
    as_is = lambda tie: F.col(tie).cast("string") if mixed else F.col(tie)
    parts = [
        df.select(F.col(key), F.lit(name).alias("source"), F.col(ts).cast("long").alias("src_ts"), F.col(val).cast("double").alias("src_value"), as_is(tie).alias("src_tie"))
        for name, (df, ts, val, tie) in sources.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def horizon_panel(targets: DataFrame, sources: Mapping[str, tuple[DataFrame, str, str, str]], key: str = "ticker", ts: str = "target_ts") -> DataFrame:
    """Price of every source at every target instant, with staleness in minutes.

    All sources are stacked and answered by one as-of pass, then spread to columns
    ``<source>_price`` and ``<source>_stale_min``.
    """
    names = list(sources)
    long = targets.withColumn("source", F.explode(F.array(*[F.lit(n) for n in names])))
    hit = T.asof(long, stack_sources(sources, key), [key, "source"], ts, "src_ts", {"src_value": "__v", "src_ts": "__t"}, "src_tie")
    cols = targets.columns
    aggs = []
    for n in names:
        mine = F.col("source") == n
        aggs.append(F.max(F.when(mine, F.col("__v"))).alias(f"{n}_price"))
        aggs.append(F.max(F.when(mine, (F.col(ts) - F.col("__t")) / 60)).alias(f"{n}_stale_min"))
    return hit.groupBy(*cols).agg(*aggs)


def panel_long(panel: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Panel columns ``<source>_price`` as rows (source, price)."""
    rows = F.array(*[F.struct(F.lit(n).alias("source"), F.col(f"{n}_price").alias("price")) for n in names])
    return panel.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def brier(p: Column, o: Column) -> Column:
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.avg((clipped - o) * (clipped - o))


def log_score(p: Column, o: Column) -> Column:
    c = F.greatest(F.lit(LOG_CLIP), F.least(F.lit(1 - LOG_CLIP), p))
    return F.avg(-(o * F.ln(c) + (1 - o) * F.ln(1 - c)))


def scores(obs: DataFrame, by: Sequence[str], cluster: str | None = None) -> DataFrame:
    """Brier and log score per group and source.

    ``obs``: source, price, outcome. ``effective_n`` counts independent clusters (legs of one
    match are coupled); ``degenerate`` marks groups with a single outcome value.
    """
    ok = obs.where(F.col("price").isNotNull() & F.col("outcome").isNotNull())
    p, o = F.col("price"), F.col("outcome").cast("double")
    eff = F.countDistinct(cluster) if cluster else _n()
    return ok.groupBy(*by, "source").agg(
        _n().alias("n"),
        eff.alias("effective_n"),
        brier(p, o).alias("brier"),
        log_score(p, o).alias("logscore"),
        F.avg(p).alias("mean_price"),
        F.avg(o).alias("mean_outcome"),
        (F.min(o) == F.max(o)).alias("degenerate"),
    )


def score_all(panels: Mapping[str, DataFrame], by: Sequence[str], cluster: str | None = None) -> DataFrame:
    """Scores of several books in one table."""
    parts = [scores(df, by, cluster).withColumn("book", F.lit(name)) for name, df in panels.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def curve(obs: DataFrame, by: Sequence[str], n_bins: int = 10, price: str = "price", outcome: str = "outcome") -> DataFrame:
    """Quantile calibration curve.

    Edges are exact interpolated quantiles with duplicates dropped; bins are closed on the right
    and equal prices always share a bin. Observations are first counted per distinct price, so
    the edge step and the binning work on price levels, not on rows.
    """
    ok = obs.where((F.col(price) > 0) & (F.col(price) < 1) & F.col(outcome).isNotNull())
    lv = cut(ok.groupBy(*by, F.col(price).alias("p")).agg(_n().alias("c"), F.sum(F.col(outcome).cast("double")).alias("hits")))
    names = [f"e{i}" for i in range(n_bins + 1)]
    q = ordered.quantiles(lv, by, "p", [i / n_bins for i in range(n_bins + 1)], names, F.col("c"))
    big = lv.groupBy(*by).agg(F.sum("c").alias("total")).where(F.col("total") >= n_bins)
    edges = q.select(*by, F.array_distinct(F.array(*names)).alias("e"))
    lv = lv.join(big.select(*by), list(by), "left_semi") if by else lv
    inner = F.slice("e", 2, F.size("e") - 2)
    binned = lv.join(edges.select(*by, "e"), list(by)) if by else lv.withColumn("e", edges.select("e").scalar())
    idx = F.size(F.filter(inner, lambda x: x < F.col("p")))
    w = F.col("c")
    g = binned.withColumn("bin", idx).groupBy(*by, "bin").agg(
        F.sum(w).alias("n"),
        (F.sum(w * F.col("p")) / F.sum(w)).alias("mean_predicted"),
        (F.sum("hits") / F.sum(w)).alias("realized"),
        F.min("p").alias("min_p"),
        F.max("p").alias("max_p"),
    )
    return g.withColumn("gap_pp", (F.col("mean_predicted") - F.col("realized")) * 100)


def curve_summary(c: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean absolute gap and the worst bin of each curve."""
    size = F.struct(F.round(F.abs("gap_pp"), 9), -F.col("bin"))
    return c.groupBy(*by).agg(
        F.avg(F.abs("gap_pp")).alias("mean_abs_gap_pp"),
        F.max_by("gap_pp", size).alias("worst_gap_pp"),
        F.max_by(F.concat(F.format_number("min_p", 2), F.lit("-"), F.format_number("max_p", 2)), size).alias("worst_range"),
        F.sum("n").alias("n_total"),
    )


def gap_series(sources: Mapping[str, tuple[DataFrame, str, str, str]], spans: DataFrame, key: str, step: int = 60, floor: float = GAP_FLOOR) -> DataFrame:
    """Two sources forward-filled on each key's grid, and their gap.

    ``spans``: key, lo, hi and any columns to keep. A quote counts from the bin that holds it;
    nothing before the span is carried in. Gaps under the floor are zero.
    """
    runs = gap_runs(sources, spans, key, step, floor)
    return T.grid(runs, step, "__from", "__to").select(*spans.columns, "bin_ts", "a", "b", "gap")


def gap_runs(sources: Mapping[str, tuple[DataFrame, str, str, str]], spans: DataFrame, key: str, step: int = 60, floor: float = GAP_FLOOR) -> DataFrame:
    """The series with one row for the marks ``__from`` to ``__to`` between two quotes, and how many they are, ``n_bins``.

    Only bins with a quote are ordered: a key has at most span / step of them, whatever its quotes.
    """
    a, b = list(sources)
    first, top = T.floor_to(F.col("lo"), step), T.floor_to(F.col("hi"), step)
    inside = stack_sources(sources, key).join(spans.select(key, "lo", "hi"), key)
    inside = inside.where((F.col("src_ts") >= first) & (F.col("src_ts") <= F.col("hi")))
    at = F.struct("src_ts", "src_tie")
    last = lambda n: F.max_by("src_value", F.when((F.col("source") == n) & F.col("src_value").isNotNull(), at))
    bars = inside.groupBy(key, T.floor_to(F.col("src_ts"), step).alias("bin_ts")).agg(last(a).alias("__a"), last(b).alias("__b"))
    w = W.partitionBy(key).orderBy("bin_ts").rowsBetween(W.unboundedPreceding, 0)
    filled = bars.select(key, "bin_ts", F.last("__a", ignorenulls=True).over(w).alias("a"), F.last("__b", ignorenulls=True).over(w).alias("b"))
    gap = F.round(F.col("a") - F.col("b"), 9)
    runs = T.runs_on(filled, spans, [key], step, first, top).where("a is not null and b is not null")
    runs = runs.withColumn("gap", F.when(F.abs(gap) >= floor, gap).otherwise(0.0))
    return runs.withColumn("n_bins", ((F.col("__to") - F.col("__from")) / step + 1).cast("long"))


def episodes(runs: DataFrame, key: str, outcome: str = "outcome", threshold: float = GAP_THRESHOLD, min_steps: int = SUSTAIN_STEPS) -> DataFrame:
    """Stretches of a wide gap that last (C07), from the runs of a gap series.

    A key has at most as many runs as bins with a quote, and its runs follow each other without a hole, so a stretch
    starts where the run before is not wide.
    """
    runs = _as_runs(runs)
    w = W.partitionBy(key).orderBy("__from")
    wide = F.abs(F.col("gap")) >= threshold
    fresh = F.when(wide & ~F.coalesce(F.lag(wide).over(w), F.lit(False)), 1).otherwise(0)
    run = runs.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).where(wide)
    run = _each_mark(run)
    o = F.col(outcome)
    g = run.groupBy(key, "__run").agg(
        F.min("__from").alias("start_ts"),
        F.max("__to").alias("end_ts"),
        _n().alias("steps"),
        F.avg("gap").alias("mean_gap"),
        F.max(F.abs("gap")).alias("max_gap"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg((F.col("a") - o) * (F.col("a") - o)).alias("mse_a"),
        F.avg((F.col("b") - o) * (F.col("b") - o)).alias("mse_b"),
    )
    return g.where(F.col("steps") >= min_steps).withColumn("closer", F.when(F.col("mse_a") < F.col("mse_b"), "a").otherwise("b")).drop("__run")


def _as_runs(series: DataFrame) -> DataFrame:
    """A series of single marks as runs of one mark each."""
    if "n_bins" in series.columns:
        return series
    return series.withColumn("__from", F.col("bin_ts")).withColumn("__to", F.col("bin_ts")).withColumn("n_bins", F.lit(1).cast("long"))


def _each_mark(runs: DataFrame) -> DataFrame:
    """A row per mark again, for means that add marks one by one in their order; nothing is sorted or shuffled for it."""
    return runs.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_bins")))).drop("__i")


def gap_summary(runs: DataFrame, key: str) -> DataFrame:
    """Largest and mean absolute gap per leg (C08), from the runs of a gap series or from the series itself."""
    return _each_mark(_as_runs(runs)).groupBy(key).agg(F.max(F.abs("gap")).alias("max_gap"), F.avg(F.abs("gap")).alias("mean_gap"), _n().alias("n_steps"))


def poll_gaps(polls: DataFrame, src: DataFrame, on: Sequence[str], poll_ts: str, src_ts: str, value: str, tie: str) -> DataFrame:
    """Market price at each poll's publication against the poll (C09), in points."""
    hit = T.value_at(polls, src, on, poll_ts, src_ts, value, "price", tie)
    return hit.withColumn("gap_pp", (F.col("price") - F.col("poll_prob")) * 100)


def strength_shares(panel: DataFrame, stage: str) -> DataFrame:
    """Price, model and rating strength as shares of their stage's group.

    ``panel``: stage, price, model, rating. Strength is ``10^(rating/400)``.
    """
    w = W.partitionBy(stage)
    s = panel.withColumn("strength", F.pow(F.lit(10.0), F.col("rating") / 400))
    share = lambda c: F.col(c) / F.sum(c).over(w)
    out = s.withColumn("rating_share", share("strength")).withColumn("price_share", share("price")).withColumn("model_share", share("model"))
    return (
        out.withColumn("gap_model_pp", (F.col("price") - F.col("model")) * 100)
        .withColumn("gap_rating_share_pp", (F.col("price_share") - F.col("rating_share")) * 100)
        .withColumn("gap_model_share_pp", (F.col("price_share") - F.col("model_share")) * 100)
        .drop("strength")
    )


def error_attribution(obs: DataFrame, by: str, top: int = 5) -> DataFrame:
    """Squared error per match and the share of the largest few (C11)."""
    per = obs.where("price is not null").groupBy(by).agg(F.sum((F.col("price") - F.col("outcome")) * (F.col("price") - F.col("outcome"))).alias("sq_error"), F.max("stale_min").alias("stale_min"))
    head = per.orderBy(F.desc(F.round("sq_error", 9)), by).limit(top)
    total = per.agg(F.sum("sq_error")).scalar()
    return head.withColumn("share", F.col("sq_error") / total)


def latency_ladder(lat: DataFrame, by: str, value: str, cluster: str) -> DataFrame:
    """Median latency per source and the count of independent matches."""
    med = ordered.quantiles(lat, [by], value, [0.5], ["median_s"])
    n = lat.where(F.col(value).isNotNull()).groupBy(by).agg(_n().alias("n"), F.countDistinct(cluster).alias("effective_n"))
    return n.join(med, by)


def stage_strip(stages: DataFrame, key: str, end: str, first_start: int) -> DataFrame:
    """Chained stage windows with each stage's model value and gap."""
    return T.stage_windows(stages, [key], end, first_start).withColumn("gap_pp", (F.col("price") - F.col("model")) * 100)


def recap(panel: DataFrame, stage: str, team: str, a: str, b: str, value: str) -> DataFrame:
    """Two teams side by side per stage."""
    pick = lambda t: F.max(F.when(F.col(team) == t, F.col(value)))
    return panel.groupBy(stage).agg(pick(a).alias("a"), pick(b).alias("b")).withColumn("lead", F.col("a") - F.col("b"))
