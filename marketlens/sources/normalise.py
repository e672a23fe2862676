"""Parse, flatten, select and merge raw records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.operators import temporal as T
from marketlens.sources.tables import CANDLE_GROUPS, CANDLE_STATS

TAIL_PAD_S = 3600
TERMINAL = ("closed", "finalized", "settled")

_POINT = "struct<createdAt:string,price:double,limit:double,active:boolean>"
ODDS_SCHEMA = (
    "fixture_meta struct<fixtureId:string,participant1Name:string,participant2Name:string,startTime:string,tournamentId:bigint>,"
    "response struct<bookmakers:map<string,struct<markets:map<string,struct<outcomes:map<string,struct<players:map<string,array<"
    + _POINT
    + ">>>>>>>>>"
)


def number(c: str) -> Column:
    """Number from fixed-point text, null when it does not parse."""
    return F.expr(f"try_cast({c} AS DOUBLE)")


def iso_epoch(c: str) -> Column:
    return F.unix_seconds(F.try_to_timestamp(F.col(c)))


def flatten_odds(raw: DataFrame, body: str = "body") -> DataFrame:
    """Nested odds documents to one row per price point.

    Bookmaker, market, outcome and player are maps; each level is one generator.
    """
    d = raw.select(F.from_json(body, ODDS_SCHEMA).alias("d"))
    meta = F.col("d.fixture_meta")
    d = d.select(meta.alias("m"), F.explode("d.response.bookmakers").alias("bookmaker", "b"))
    d = d.select("m", "bookmaker", F.explode("b.markets").alias("market_id", "k"))
    d = d.select("m", "bookmaker", "market_id", F.explode("k.outcomes").alias("outcome_id", "o"))
    d = d.select("m", "bookmaker", "market_id", "outcome_id", F.explode("o.players").alias("player_id", "pts"))
    d = d.select("m", "bookmaker", "market_id", "outcome_id", "player_id", F.explode("pts").alias("p"))
    return d.select(
        F.col("m.fixtureId").alias("fixture_id"),
        F.col("m.participant1Name").alias("participant1"),
        F.col("m.participant2Name").alias("participant2"),
        F.col("m.startTime").alias("fixture_start_time"),
        F.col("m.tournamentId").alias("tournament_id"),
        "bookmaker",
        "market_id",
        "outcome_id",
        "player_id",
        F.col("p.createdAt").alias("created_at"),
        F.col("p.price").alias("price_decimal"),
        F.col("p.limit").alias("limit"),
        F.col("p.active").alias("active"),
    )


#: Fields of an event and of a market, as (field, column, kind). Flags default to false, times become epochs,
#: lists are JSON text inside JSON and become clean JSON.
EVENT_FIELDS = (
    ("id", "event_id", "text"), ("slug", "event_slug", "text"), ("ticker", "event_ticker", "text"), ("title", "event_title", "text"),
    ("category", "event_category", "text"), ("closed", "event_closed", "flag"), ("active", "event_active", "flag"),
    ("archived", "event_archived", "flag"), ("volume", "event_volume", "number"), ("liquidity", "event_liquidity", "number"),
    ("openInterest", "event_open_interest", "number"), ("negRisk", "event_neg_risk", "flag"), ("createdAt", "event_created_at_ts", "time"),
    ("startDate", "event_start_date_ts", "time"), ("endDate", "event_end_date_ts", "time"), ("closedTime", "event_closed_time_ts", "time"),
)
MARKET_FIELDS = (
    ("id", "market_id", "text"), ("slug", "market_slug", "text"), ("question", "question", "text"), ("groupItemTitle", "group_item_title", "text"),
    ("outcomes", "outcomes_json", "list"), ("outcomePrices", "outcome_prices_json", "list"), ("clobTokenIds", "token_ids_json", "list"),
    ("volume", "volume", "number"), ("liquidity", "liquidity", "number"), ("volume24hr", "volume_24hr", "number"), ("volume1wk", "volume_1wk", "number"),
    ("volume1mo", "volume_1mo", "number"), ("volume1yr", "volume_1yr", "number"), ("active", "active", "flag"), ("closed", "closed", "flag"),
    ("archived", "archived", "flag"), ("restricted", "restricted", "flag"), ("createdAt", "created_at_ts", "time"), ("updatedAt", "updated_at_ts", "time"),
    ("startDate", "start_date_ts", "time"), ("endDate", "end_date_ts", "time"), ("closedTime", "closed_time_ts", "time"),
)
_JSON_TYPES = {"flag": "boolean"}


def _fields(fields: Sequence[tuple[str, str, str]]) -> str:
    return ",".join(f"{f}:{_JSON_TYPES.get(kind, 'string')}" for f, _, kind in fields)


EVENT_SCHEMA = ", ".join(f"{f} {_JSON_TYPES.get(kind, 'string')}" for f, _, kind in EVENT_FIELDS) + f", markets array<struct<{_fields(MARKET_FIELDS)}>>"


def flatten_events(raw: DataFrame, body: str = "body", knockout_from: str | None = None) -> DataFrame:
    """Events with nested markets to one row per market; empty events keep one row.

    Flags of a market are null where the event has none. Family and tier follow with ``entities.classify`` and ``priority_bands``.
    """
    e = raw.select(F.from_json(body, EVENT_SCHEMA).alias("e"))
    m = e.select("e", F.explode_outer("e.markets").alias("m"))
    listed = lambda c: F.coalesce(F.from_json(F.coalesce(F.col(c), F.lit("[]")), "array<string>"), F.array().cast("array<string>"))
    some = F.col("m").isNotNull()
    day = F.regexp_extract("e.slug", r"(\d{4}-\d{2}-\d{2})", 1)

    def column(side: str, field: str, name: str, kind: str) -> Column:
        c = f"{side}.{field}"
        if kind == "flag":
            out = F.coalesce(F.col(c), F.lit(False))
            out = out if side == "e" else F.when(some, out)
        elif kind == "list":
            out = F.when(some, F.to_json(listed(c)))
        else:
            out = {"number": number, "time": iso_epoch, "text": F.col}[kind](c)
        return out.alias(name)

    out = m.select(
        *[column("e", *f) for f in EVENT_FIELDS],
        F.when(day != "", day).alias("match_date"),
        *[column("m", *f) for f in MARKET_FIELDS],
        F.when(some, F.size(listed("m.clobTokenIds"))).otherwise(0).alias("n_tokens"),
    )
    if knockout_from is not None:
        out = out.withColumn("is_knockout", F.coalesce(F.col("match_date") >= knockout_from, F.lit(False)))
    return out


def normalise_trades(raw: DataFrame, segment: str) -> DataFrame:
    """Keep the raw strings, add float twins, epoch and the source segment."""
    return (
        raw.withColumn("count_contracts", number("count_fp"))
        .withColumn("yes_price_usd", number("yes_price_dollars"))
        .withColumn("no_price_usd", number("no_price_dollars"))
        .withColumn("created_ts", iso_epoch("created_time"))
        .withColumn("source_segment", F.lit(segment))
    )


def flatten_candles(raw: DataFrame) -> DataFrame:
    """Nested price and quote groups to columns; groups or stats may be missing."""
    have = {g: set(raw.schema[g].dataType.names) if g in raw.columns else set() for g in CANDLE_GROUPS}
    series = F.col("series_ticker") if "series_ticker" in raw.columns else F.lit(None).cast("string").alias("series_ticker")
    cols = [series, F.col("ticker"), F.col("end_period_ts")]
    cols += ["volume_fp", number("volume_fp").alias("volume_contracts"), "open_interest_fp", number("open_interest_fp").alias("open_interest_contracts")]
    for g in CANDLE_GROUPS:
        for st in CANDLE_STATS:
            field = f"{st}_dollars"
            text = F.col(f"{g}.{field}") if field in have[g] else F.lit(None).cast("string")
            cols.append(text.alias(f"{g}_{field}"))
            cols.append((number(f"{g}.{field}") if field in have[g] else F.lit(None).cast("double")).alias(f"{g}_{st}_usd"))
    return raw.select(*cols)


def normalise_markets(raw: DataFrame, numbers: Mapping[str, str]) -> DataFrame:
    """Complex values to JSON text, fixed-point strings to doubles.

    ``numbers`` maps a new numeric column to its string column.
    """
    cols = []
    for f in raw.schema.fields:
        nested = f.dataType.typeName() in ("struct", "array", "map")
        cols.append(F.to_json(f.name).alias(f.name) if nested else F.col(f.name))
    return raw.select(*cols, *[number(src).alias(new) for new, src in numbers.items()])


def select_series(
    series: DataFrame,
    prefixes: Sequence[str],
    phrases: Sequence[str],
    explicit: DataFrame,
    deny_exact: DataFrame,
    deny_prefix: Mapping[str, str],
    deny_suffix: Mapping[str, str],
) -> DataFrame:
    """Three independent ways in, then a denylist.

    Adds ``matched_by`` (prefix, title_text, explicit_include) and ``excluded_reason``. Exact lists
    are frames (``ticker`` and ``ticker, reason``) and are joined, never inlined.
    """
    t, title = F.col("ticker"), F.lower("title")
    any_of = lambda tests: F.greatest(F.lit(False), *tests) if tests else F.lit(False)
    s = series.join(explicit.select("ticker").distinct().withColumn("__x", F.lit(True)), "ticker", "left")
    s = s.join(deny_exact.select("ticker", F.col("reason").alias("__r")), "ticker", "left")
    by = (
        F.when(any_of([t.startswith(p) for p in prefixes]), "prefix")
        .when(any_of([F.contains(title, F.lit(p)) for p in phrases]), "title_text")
        .when(F.col("__x"), "explicit_include")
    )
    reason = F.col("__r")
    tests = [F.when(t.startswith(p), r) for p, r in deny_prefix.items()] + [F.when(t.endswith(p), r) for p, r in deny_suffix.items()]
    return s.withColumn("matched_by", by).where("matched_by is not null").withColumn("excluded_reason", F.coalesce(reason, *tests)).drop("__x", "__r")


def apply_scope(df: DataFrame, scope: DataFrame, key: str = "ticker") -> DataFrame:
    """Scope flag and note from a short table, applied to old rows too."""
    j = df.drop("in_scope", "scope_note").join(scope.select(key, F.col("note").alias("scope_note")), key, "left")
    return j.withColumn("in_scope", F.col("scope_note").isNull()).withColumn("scope_note", F.coalesce("scope_note", F.lit("")))


def merge_new(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add only keys not yet present; nothing is changed or removed."""
    fresh = new.join(old.select(*key).distinct(), list(key), "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def merge_dedupe(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Old and new rows, the last load of each key kept (S13); an aggregate, combined map-side."""
    both = old.withColumn("__load", F.lit(0)).unionByName(new.withColumn("__load", F.lit(1)), allowMissingColumns=True)
    return T.latest(both, key, ["__load", *order]).drop("__load")


def normalise_history(lines: DataFrame, codes: DataFrame, line: str = "value", code: str = "team_code") -> DataFrame:
    """Tab-separated match lines to team-perspective rows.

    ``lines`` carries the line and the code of the team whose file it is; ``codes``: code, name.
    The rating change is stated for side 1 and flips for side 2. A zero month or day means only
    the year is known: 1 January is used and flagged. Lines under 16 fields, or about neither
    side, are dropped.
    """
    f = F.split(line, "\t")
    g = lambda i: F.element_at("f", i + 1)
    num = lambda c, t: F.expr(f"try_cast({c} AS {t})")
    x = lines.where(F.length(F.trim(line)) > 0).withColumn("f", f).where(F.size("f") >= 16)
    first = g(3) == F.col(code)
    x = x.where(first | (g(4) == F.col(code))).withColumn("is_team1", first)
    side = lambda a, b: F.when(F.col("is_team1"), g(a)).otherwise(g(b))
    x = x.select(
        code,
        "is_team1",
        F.concat_ws("-", g(0), g(1), g(2)).alias("match_date"),
        g(0).alias("y"),
        g(1).alias("m"),
        g(2).alias("d"),
        side(4, 3).alias("opponent_code"),
        side(5, 6).alias("s_own"),
        side(6, 5).alias("s_opp"),
        g(7).alias("tournament_code"),
        F.nullif(g(8), F.lit("")).alias("host_code"),
        side(10, 11).alias("rating"),
        side(14, 15).alias("rank"),
        g(9).alias("chg"),
    )
    x = x.withColumn("team_score", num("s_own", "INT")).withColumn("opponent_score", num("s_opp", "INT"))
    whole = (F.col("m").cast("int") > 0) & (F.col("d").cast("int") > 0)
    day = F.make_date(F.col("y").cast("int"), F.when(whole, F.col("m").cast("int")).otherwise(1), F.when(whole, F.col("d").cast("int")).otherwise(1))
    chg = num("chg", "DOUBLE")
    a, b = F.col("team_score"), F.col("opponent_score")
    x = x.select(
        code,
        "match_date",
        F.when(whole, "exact").otherwise("year_only").alias("date_precision"),
        (F.unix_date(day).cast("long") * 86400).alias("match_epoch_utc"),
        "opponent_code",
        "is_team1",
        "team_score",
        "opponent_score",
        F.when(a > b, "W").when(a < b, "L").when(a == b, "D").alias("result"),
        "tournament_code",
        "host_code",
        num("rating", "DOUBLE").alias("rating_after"),
        F.when(F.col("is_team1"), chg).otherwise(-chg).alias("rating_change"),
        num("rank", "INT").alias("rank_after"),
    )
    names = codes.select(F.col("code").alias("opponent_code"), F.col("name").alias("__n"))
    return x.join(names, "opponent_code", "left").withColumn("opponent", F.coalesce("__n", "opponent_code")).drop("__n")


def normalise_opinion(raw: DataFrame, percent: str = "value_pct", dates: Sequence[str] = ("field_start_date", "field_end_date", "publish_date")) -> DataFrame:
    """Percent to probability, date columns to epochs."""
    epochs = {f"{c}_epoch": F.unix_date(F.try_to_date(F.col(c))).cast("long") * 86400 for c in dates}
    return raw.withColumn("value_prob", F.col(percent) / 100).withColumns(epochs)


def model_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per team and metric."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value_pct")) for m in metrics])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").withColumn("value_prob", F.col("value_pct") / 100)


def futures_devig(odds: DataFrame, by: str, american: str = "american_odds") -> DataFrame:
    """American odds to decimal and implied probability, then a proportional de-vig per stage."""
    a = F.col(american)
    dec = F.when(a > 0, 1 + a / 100.0).when(a < 0, 1 + 100.0 / F.abs(a))
    d = odds.withColumn("decimal_odds", dec).withColumn("implied_raw", 1 / F.col("decimal_odds"))
    over = d.groupBy(by).agg(F.sum("implied_raw").alias("overround"))
    return d.join(over, by).withColumn("implied_devig", F.when(F.col("overround") > 0, F.col("implied_raw") / F.col("overround")))


def priority_bands(m: DataFrame, winner: str, game: str, advance: str, per_match_family: str, limit: int | None = None) -> DataFrame:
    """Four bands: winner book, knockout games, other per-match, the rest; by volume inside.

    A match is a knockout when the catalog lists an advance market for it.
    ``m``: ticker, series_ticker, match_key, family, volume.
    """
    ko = m.where(F.col("series_ticker") == advance).select("match_key").distinct().withColumn("__ko", F.lit(True))
    j = m.join(ko, "match_key", "left")
    band = (
        F.when(F.col("series_ticker") == winner, 1)
        .when(F.col("series_ticker").isin(game, advance) & F.col("__ko"), 2)
        .when(F.col("family") == per_match_family, 3)
        .otherwise(4)
    )
    q = j.withColumn("band", band).where(F.coalesce("volume", F.lit(0.0)) > 0).drop("__ko")
    if limit is None:
        return q
    return q.orderBy("band", F.desc("volume"), "ticker").limit(limit)


def band_summary(q: DataFrame) -> DataFrame:
    """Markets and volume per band."""
    return q.groupBy("band").agg(F.count(F.lit(1)).alias("n_markets"), F.sum("volume").alias("volume"))


def lifetimes(m: DataFrame, now: int, pad_s: int = TAIL_PAD_S, since: int | None = None, terminal: Sequence[str] = TERMINAL) -> DataFrame:
    """Active life of each market.

    Only a terminal status makes the close time trustworthy; it then gets a tail pad for late
    settlement prints. Otherwise life ends now. ``m``: open_ts, close_ts, status.
    """
    now_c = F.lit(now).cast("long")
    o, c = F.coalesce("open_ts", now_c), F.coalesce("close_ts", now_c)
    end = F.least(F.when(F.col("status").isin(*terminal), c + pad_s).otherwise(c), now_c)
    end = F.greatest(end, o)
    start = o if since is None else F.least(F.greatest(o, F.lit(since).cast("long")), end)
    return m.withColumn("life_start", start).withColumn("life_end", end)


#: Fixed volume tiers: name and lower edge.
TIERS = (("0", 0), ("1-999", 1), ("1k-100k", 1_000), ("100k-1M", 100_000), ("1M-10M", 1_000_000), ("10M+", 10_000_000))


def tier_of(v: Column) -> Column:
    out = F.lit(TIERS[0][0])
    for name, lo in TIERS[1:]:
        out = F.when(v >= lo, name).otherwise(out)
    return out


def extrapolate_trades(m: DataFrame, samples: DataFrame, per_page: int = 1000, candle_minutes: int = 5000) -> DataFrame:
    """Estimate trades and request counts from a sample of contracts per trade.

    The mean ratio of a market's volume tier is used, or the volume-weighted mean of all samples
    where its tier has none. ``m``: volume, life_start, life_end. ``samples``: volume, ratio.
    """
    ok = samples.where(F.col("ratio").isNotNull())
    tiers = ok.groupBy(tier_of(F.col("volume")).alias("tier")).agg(F.avg("ratio").alias("tier_ratio"))
    overall = ok.agg(F.sum(F.col("ratio") * F.col("volume")) / F.sum("volume")).scalar()
    v = F.coalesce("volume", F.lit(0.0))
    j = m.withColumn("tier", tier_of(v)).join(tiers, "tier", "left").withColumn("ratio", F.coalesce("tier_ratio", overall)).drop("tier_ratio")
    est = F.when(v > 0, v / F.col("ratio")).otherwise(0.0)
    minutes = (F.col("life_end") - F.col("life_start")) / 60
    candles = F.when(v <= 0, 0).when(minutes <= 0, 1).otherwise(F.ceil(minutes / candle_minutes))
    return j.withColumn("est_trades", est).withColumn("trade_requests", F.ceil(F.col("est_trades") / per_page)).withColumn("candle_requests", candles)
