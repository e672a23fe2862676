"""Queries for scans, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlens.operators import temporal as T
from marketlens.plans import views as v
from marketlens.plans.registry import query, shape
from marketlens.session import shared_folder
from marketlens.sources import normalise as N
from marketlens.sources import tables as tb
from marketlens.sources import versions

DAY = 86400


def _folder(s) -> str:
    """A new folder for written tables inside the shared one."""
    return f"{shared_folder(s)}/marketlens-{uuid.uuid4().hex}"


@query("s01_tape_scan", v.sql(v.TAPE) + "SELECT trade_id, ticker, series_ticker, created_ts, strftime(to_timestamp(created_ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM tape")
def _(s, d):
    t = v.tape(s, d).withColumn("created_at", F.date_format(F.timestamp_seconds("created_ts"), "yyyy-MM-dd HH:mm:ss"))
    return t.select("trade_id", "ticker", "series_ticker", "created_ts", "created_at")


@query(
    "s02_pruned_scan",
    v.sql(v.TAPE) + "SELECT trade_id, ticker, created_ts FROM tape WHERE series_ticker = 2 AND created_ts BETWEEN 1704672000 AND 1705276800 AND ticker IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def _(s, d):
    names = v.table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("ticker"))
    return tb.scan(v.tape(s, d), 2, names, 1704672000, 1705276800).select("trade_id", "ticker", "created_ts")


def _candles(s, d):
    """Hourly candles of the tape; an hour without a purchase has no close, one without a view no bid.

    Of several prints in one second the first counts, at the open and at the close.
    """
    t = v.tape(s, d)
    at, last = F.struct("created_ts", "trade_id"), F.struct("created_ts", v.falling(t, "trade_id"))
    buy, see = F.col("event_type") == "purchase", F.col("event_type") == "view"
    price = lambda f, c: f(F.when(c, F.col("cents")))
    txt = lambda c: F.format_string("%d.%02d", F.floor(c / 100).cast("int"), (c % 100).cast("int"))
    g = t.groupBy("ticker", (T.floor_to(F.col("created_ts"), 3600) + 3600).alias("end_period_ts")).agg(
        F.min_by("cents", F.when(buy, at)).alias("o"), price(F.max, buy).alias("h"), price(F.min, buy).alias("l"), F.max_by("cents", F.when(buy, last)).alias("c"),
        F.max_by("cents", F.when(see, last)).alias("bid"), F.sum(F.when(buy, F.col("count_contracts"))).alias("vol"), F.count(F.lit(1)).alias("oi"),
    )
    st = lambda **k: F.struct(*[F.when(x.isNotNull(), txt(x)).alias(n) for n, x in k.items()])
    return g.select(
        "ticker", "end_period_ts", F.format_string("%.2f", "vol").alias("volume_fp"), F.col("oi").cast("string").alias("open_interest_fp"),
        st(open_dollars=F.col("o"), high_dollars=F.col("h"), low_dollars=F.col("l"), close_dollars=F.col("c")).alias("price"), st(close_dollars=F.col("bid")).alias("yes_bid"),
    )


CANDLES = """cd AS (SELECT ticker, created_ts // 3600 * 3600 + 3600 AS end_period_ts, arg_min(cents, created_ts) FILTER (WHERE event_type = 'purchase') AS o, max(cents) FILTER (WHERE event_type = 'purchase') AS h, min(cents) FILTER (WHERE event_type = 'purchase') AS l,
 arg_max(cents, created_ts) FILTER (WHERE event_type = 'purchase') AS c, arg_max(cents, created_ts) FILTER (WHERE event_type = 'view') AS bid, sum(count_contracts) FILTER (WHERE event_type = 'purchase') AS vol, count(*) AS oi FROM tape GROUP BY 1, 2)"""


@query("s03_candles_with_close", v.sql(v.TAPE, CANDLES) + "SELECT ticker, end_period_ts, c / 100e0 AS price_close_usd FROM cd WHERE c IS NOT NULL")
def _(s, d):
    return N.flatten_candles(_candles(s, d)).where("price_close_usd is not null").select("ticker", "end_period_ts", "price_close_usd")


@query(
    "s04_finest_fidelity",
    v.sql(v.TAPE)
    + """, p AS (SELECT trade_id, ticker AS token_id, CASE WHEN ticker % 3 > 0 AND event_type = 'error' THEN 1 ELSE 60 END AS fidelity, ticker % 3 AS priority_tier FROM tape)
SELECT trade_id, token_id, fidelity FROM p WHERE priority_tier IN (0, 1) QUALIFY fidelity = min(fidelity) OVER (PARTITION BY token_id)""",
)
def _(s, d):
    fid = F.when((F.col("ticker") % 3 > 0) & (F.col("event_type") == "error"), 1).otherwise(60)
    p = v.tape(s, d).select("trade_id", F.col("ticker").alias("token_id"), fid.alias("fidelity"), (F.col("ticker") % 3).alias("priority_tier"))
    return tb.finest(p.where(F.col("priority_tier").isin(0, 1))).select("trade_id", "token_id", "fidelity")


def _odds_docs(s, d):
    """Every quote as a nested odds document with two price points."""
    q = v.quotes(s, d)
    pt = lambda up: F.struct(F.timestamp_millis("created_ms").cast("string").alias("createdAt"), (F.col("price_decimal") + up).alias("price"), F.lit(100.0).alias("limit"), F.col("active").alias("active"))
    lvl = lambda name, key, inner: F.struct(F.create_map(key.cast("string"), inner).alias(name))
    players = lvl("players", F.lit("0"), F.array(pt(0.0), pt(1.0)))
    outcomes = lvl("outcomes", F.col("outcome_id"), players)
    mk = lvl("markets", F.lit("101"), outcomes)
    body = F.struct(
        F.struct(F.col("quote_id").cast("string").alias("fixtureId"), F.lit("A").alias("participant1Name"), F.lit("B").alias("participant2Name")).alias("fixture_meta"),
        F.struct(F.create_map(F.concat(F.lit("bk"), F.col("bookmaker").cast("string")), mk).alias("bookmakers")).alias("response"),
    )
    return q.select(F.to_json(body).alias("body"))


@query(
    "s05_flatten_odds",
    v.sql(v.QUOTES)
    + """SELECT quote_id::VARCHAR AS fixture_id, 'bk' || bookmaker AS bookmaker, outcome_id::VARCHAR AS outcome_id, round(price_decimal + up, 9) AS price_decimal, active FROM quotes, (VALUES (0e0), (1e0)) u(up)""",
)
def _(s, d):
    x = N.flatten_odds(_odds_docs(s, d))
    return shape(x, {"fixture_id": None, "bookmaker": None, "outcome_id": None, "price_decimal": 9, "active": None})


def _event_docs(s, d):
    p = v.table(s, d, "part")
    mk = lambda i: F.struct(
        F.concat_ws("-", F.col("p_partkey").cast("string"), F.lit(str(i))).alias("id"), F.col("p_name").alias("question"), F.to_json(F.array(F.lit("a"), F.lit("b"))).alias("clobTokenIds"), F.lit(f"{i}.5").alias("volume")
    )
    n = F.col("p_partkey") % 3
    ms = F.when(n == 1, F.array(mk(0))).when(n == 2, F.array(mk(0), mk(1)))
    slug = F.concat(F.lit("match-2026-07-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"))
    return p.select(F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), slug.alias("slug"), F.col("p_type").alias("title"), F.col("p_retailprice").cast("string").alias("volume"), ms.alias("markets"))).alias("body"))


@query(
    "s06_flatten_events",
    """WITH m AS (SELECT *, unnest(CASE p_partkey % 3 WHEN 0 THEN [NULL] WHEN 1 THEN [0] ELSE [0, 1] END) AS i FROM part)
SELECT p_partkey::VARCHAR AS event_id, p_partkey || '-' || i AS market_id, CASE WHEN i IS NULL THEN 0 ELSE 2 END AS n_tokens, i + 0.5e0 AS volume, '2026-07-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS match_date, p_partkey % 28 + 1 >= 15 AS is_knockout FROM m""",
)
def _(s, d):
    x = N.flatten_events(_event_docs(s, d), knockout_from="2026-07-15")
    return x.select("event_id", "market_id", "n_tokens", "volume", "match_date", "is_knockout")


def _raw_trades(s, d):
    e = v.events(s, d)
    k = F.regexp_extract("props", "([0-9]+)", 1)
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 37 == 0, "n/a").otherwise(F.format_string("%.2f", "value")).alias("count_fp"),
        F.concat(F.lit("0."), F.lpad(k, 2, "0")).alias("yes_price_dollars"),
        F.lit(None).cast("string").alias("no_price_dollars"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_time"),
    )


@query(
    "s07_normalise_trades",
    v.sql(v.TAPE)
    + """SELECT trade_id AS event_id, CASE WHEN trade_id % 37 = 0 THEN 'n/a' ELSE printf('%.2f', count_contracts) END AS count_fp, CASE WHEN trade_id % 37 > 0 THEN count_contracts END AS count_contracts, yes_price_usd, created_ts, 'historical' AS source_segment FROM tape""",
)
def _(s, d):
    x = N.normalise_trades(_raw_trades(s, d), "historical")
    return x.select("event_id", "count_fp", "count_contracts", "yes_price_usd", "created_ts", "source_segment")


@query(
    "s08_flatten_candles",
    v.sql(v.TAPE, CANDLES)
    + """SELECT ticker, end_period_ts, o / 100e0 AS price_open_usd, h / 100e0 AS price_high_usd, l / 100e0 AS price_low_usd, c / 100e0 AS price_close_usd, bid / 100e0 AS yes_bid_close_usd, NULL::DOUBLE AS yes_ask_close_usd, round(vol, 2) AS volume_contracts, oi::DOUBLE AS open_interest_contracts FROM cd""",
)
def _(s, d):
    x = N.flatten_candles(_candles(s, d))
    return x.select("ticker", "end_period_ts", "price_open_usd", "price_high_usd", "price_low_usd", "price_close_usd", "yes_bid_close_usd", "yes_ask_close_usd", "volume_contracts", "open_interest_contracts")


@query("s09_normalise_markets", """SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS meta, p_retailprice AS last_price_usd FROM part""")
def _(s, d):
    raw = v.table(s, d, "part").select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("meta"), F.col("p_retailprice").cast("string").alias("last_price_dollars"))
    return N.normalise_markets(raw, {"last_price_usd": "last_price_dollars"}).select("p_partkey", "meta", "last_price_usd")


@query(
    "s10_select_series",
    """WITH s AS (SELECT p_partkey, p_brand || '-' || p_partkey AS ticker, p_name AS title FROM part),
m AS (SELECT *, CASE WHEN ticker LIKE 'Brand#2%' THEN 'prefix' WHEN title LIKE '%ring%' THEN 'title_text' WHEN p_partkey % 50 = 0 THEN 'explicit_include' END AS matched_by FROM s)
SELECT ticker, matched_by, CASE WHEN p_partkey % 101 = 0 THEN 'listed' WHEN ticker LIKE 'Brand#23%' THEN 'other event' WHEN ticker LIKE '%7' THEN 'copy' END AS excluded_reason FROM m WHERE matched_by IS NOT NULL""",
)
def _(s, d):
    p = v.table(s, d, "part")
    t = F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))
    ser = p.select("p_partkey", t.alias("ticker"), F.col("p_name").alias("title"))
    deny = ser.where("p_partkey % 101 = 0").select("ticker", F.lit("listed").alias("reason"))
    x = N.select_series(ser, ["Brand#2"], ["ring"], ser.where("p_partkey % 50 = 0"), deny, {"Brand#23": "other event"}, {"7": "copy"})
    return x.select("ticker", "matched_by", "excluded_reason")


@query("s11_apply_scope", "SELECT p_partkey AS ticker, p_size <> 7 AS in_scope, CASE WHEN p_size = 7 THEN 'size ' || p_size ELSE '' END AS scope_note FROM part")
def _(s, d):
    p = v.table(s, d, "part").select(F.col("p_partkey").alias("ticker"), "p_size")
    scope = p.where("p_size = 7").select("ticker", F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("note"))
    return N.apply_scope(p, scope).select("ticker", "in_scope", "scope_note")


def _batch(s, d, i, again=None):
    """Batch i of the tape; it re-sends a tenth of the batch before with a changed size."""
    t = v.tape(s, d).select("trade_id", "ticker", "created_ts", "count_contracts")
    own = t.where(F.col("trade_id") % 3 == i).withColumn("batch", F.lit(i))
    if i == 0:
        return own
    resent = t.where((F.col("trade_id") % 3 == i - 1) & (F.col("trade_id") % 10 == 0)).withColumn("batch", F.lit(i)).withColumn("count_contracts", F.col("count_contracts") + 1)
    return own.unionByName(resent)


@query("s12_merge_new", v.sql(v.TAPE) + "SELECT trade_id, count_contracts, trade_id % 3 AS batch FROM tape".replace("trade_id % 3 AS batch", "(trade_id % 3)::INT AS batch"))
def _(s, d):
    one = N.merge_new(_batch(s, d, 0), _batch(s, d, 1), ["trade_id"])
    return N.merge_new(one, _batch(s, d, 2), ["trade_id"]).select("trade_id", "count_contracts", "batch")


@query(
    "s13_merge_dedupe",
    v.sql(v.TAPE)
    + "SELECT trade_id, round(count_contracts + CASE WHEN trade_id % 10 = 0 AND trade_id % 3 < 2 THEN 1 ELSE 0 END, 4) AS count_contracts, (trade_id % 3 + CASE WHEN trade_id % 10 = 0 AND trade_id % 3 < 2 THEN 1 ELSE 0 END)::INT AS batch FROM tape",
)
def _(s, d):
    one = N.merge_dedupe(_batch(s, d, 0), _batch(s, d, 1), ["trade_id"], ["batch"])
    return shape(N.merge_dedupe(one, _batch(s, d, 2), ["trade_id"], ["batch"]), {"trade_id": "long", "count_contracts": 4, "batch": "int"})


@query(
    "s13_versioned_merge",
    v.sql(v.TAPE)
    + """SELECT trade_id, round(count_contracts + CASE WHEN trade_id % 10 = 0 AND trade_id % 3 < 2 THEN 1 ELSE 0 END, 4) AS count_contracts,
  (trade_id % 3 + CASE WHEN trade_id % 10 = 0 AND trade_id % 3 < 2 THEN 1 ELSE 0 END)::INT AS batch, 3 AS version FROM tape""",
)
def _(s, d):
    """Three loads, each sent twice: the second time changes nothing."""
    root = f"{_folder(s)}/table"
    for i in (0, 1, 0, 2, 2):
        at = versions.merge(_batch(s, d, i), root, f"batch-{i}", ["trade_id"], ["batch"])
    table = versions.read(s, root).withColumn("version", F.lit(at))
    return shape(table, {"trade_id": "long", "count_contracts": 4, "batch": "int", "version": "int"})


@query("s14_snapshot", v.sql(v.TAPE) + "SELECT count(*) AS n_rows, max(created_ts) AS max_ts, min(created_ts) AS min_ts FROM tape")
def _(s, d):
    return tb.snapshot(v.tape(s, d), f"{_folder(s)}/snapshot", "created_ts")


def _lines(s, d):
    """Orders as rating-history lines: customer nation against another one."""
    o = v.table(s, d, "orders")
    c = v.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    j = o.join(c, "o_custkey")
    me, other = F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.concat(F.lit("N"), ((F.col("c_nationkey") + 3) % 30).cast("string"))
    home = F.col("o_orderkey") % 2 == 0
    ts = F.col("o_orderdate").cast("timestamp")
    zero = F.col("o_orderkey") % 50 == 0
    fields = [
        F.date_format(ts, "yyyy"), F.when(zero, "00").otherwise(F.date_format(ts, "MM")), F.date_format(ts, "dd"), F.when(home, me).otherwise(other), F.when(home, other).otherwise(me),
        (F.col("o_orderkey") % 4).cast("string"), (F.col("o_orderkey") % 3).cast("string"), F.lit("F"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("US"), (F.col("o_orderkey") % 7).cast("string"),
        F.lit("1500"), F.lit("1400"), F.lit("0"), F.lit("0"), (F.col("o_orderkey") % 9).cast("string"), F.lit("x"),
    ]
    return j.select("o_orderkey", F.array_join(F.array(*fields), "\t").alias("value"), me.alias("team_code"))


@query(
    "s15_rating_history",
    """WITH x AS (SELECT o_orderkey AS k, o_orderdate AS dt, c_nationkey AS n, (c_nationkey + 3) % 30 AS o, o_orderkey % 2 = 0 AS home FROM orders JOIN customer ON c_custkey = o_custkey),
y AS (SELECT *, CASE WHEN home THEN k % 4 ELSE k % 3 END AS a, CASE WHEN home THEN k % 3 ELSE k % 4 END AS b FROM x)
SELECT 'N' || n AS team_code, 'N' || o AS opponent_code, coalesce(n_name, 'N' || o) AS opponent, home AS is_team1, CASE WHEN k % 50 = 0 THEN 'year_only' ELSE 'exact' END AS date_precision,
 (epoch(CASE WHEN k % 50 = 0 THEN date_trunc('year', dt) ELSE dt END) // 86400 * 86400)::BIGINT AS match_epoch_utc, a::INT AS team_score, b::INT AS opponent_score, CASE WHEN a > b THEN 'W' WHEN a < b THEN 'L' ELSE 'D' END AS result,
 CASE WHEN k % 5 > 0 THEN 'US' END AS host_code, CASE WHEN home THEN 1500e0 ELSE 1400e0 END AS rating_after, (CASE WHEN home THEN k % 7 ELSE -(k % 7) END)::DOUBLE AS rating_change, CASE WHEN home THEN k % 9 END::INT AS rank_after
FROM y LEFT JOIN nation ON n_nationkey = o""",
)
def _(s, d):
    codes = v.table(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"))
    x = N.normalise_history(_lines(s, d), codes)
    return x.select(
        "team_code", "opponent_code", "opponent", "is_team1", "date_precision", "match_epoch_utc", "team_score", "opponent_score", "result", "host_code", "rating_after", (F.col("rating_change") + 0.0).alias("rating_change"), "rank_after"
    )


@query(
    "s16_opinion_tables",
    """SELECT o_orderkey, round(o_totalprice / 1000, 6) AS value_pct, round(o_totalprice / 1000 / 100, 8) AS value_prob, CASE WHEN o_orderkey % 6 > 0 THEN epoch(o_orderdate)::BIGINT END AS publish_date_epoch FROM orders""",
)
def _(s, d):
    o = v.table(s, d, "orders")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    raw = o.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("value_pct"), F.when(F.col("o_orderkey") % 6 > 0, day).otherwise("unknown").alias("publish_date"))
    return shape(N.normalise_opinion(raw, dates=["publish_date"]), {"o_orderkey": "long", "value_pct": 6, "value_prob": 8, "publish_date_epoch": "long"})


@query(
    "s16_model_long",
    "SELECT p_partkey, metric, CASE metric WHEN 'p_size' THEN p_size::DOUBLE ELSE p_retailprice END AS value_pct, round(CASE metric WHEN 'p_size' THEN p_size::DOUBLE ELSE p_retailprice END / 100, 8) AS value_prob FROM part, (VALUES ('p_size'), ('p_retailprice')) m(metric)",
)
def _(s, d):
    x = N.model_long(v.table(s, d, "part"), ["p_partkey"], ["p_size", "p_retailprice"])
    return shape(x, {"p_partkey": "long", "metric": None, "value_pct": None, "value_prob": 8})


@query(
    "s17_futures_devig",
    """WITH a AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 4 = 0 THEN -(110 + p_size * 10) ELSE 100 + p_size * 20 END AS am FROM part),
d AS (SELECT *, CASE WHEN am > 0 THEN 1 + am / 100e0 ELSE 1 + 100e0 / abs(am) END AS dec FROM a)
SELECT p_partkey, round(dec, 9) AS decimal_odds, round(1 / dec, 9) AS implied_raw, round(sum(1 / dec) OVER (PARTITION BY p_type), 8) AS overround, round(1 / dec / sum(1 / dec) OVER (PARTITION BY p_type), 9) AS implied_devig FROM d""",
)
def _(s, d):
    am = F.when(F.col("p_partkey") % 4 == 0, -(110 + F.col("p_size") * 10)).otherwise(100 + F.col("p_size") * 20)
    x = N.futures_devig(v.table(s, d, "part").select("p_partkey", "p_type", am.alias("american_odds")), "p_type")
    return shape(x, {"p_partkey": "long", "decimal_odds": 9, "implied_raw": 9, "overround": 8, "implied_devig": 9})


def _band_input(s, d):
    t = v.table(s, d, "lineitem").groupBy("l_partkey").agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100).alias("volume"))
    p = v.table(s, d, "part")
    ser = F.when(F.col("p_brand") == "Brand#1", "WINNER").when(F.col("p_size") == 9, "ADVANCE").when(F.col("p_brand") == "Brand#2", "GAME").otherwise(F.col("p_type"))
    return p.join(t, p["p_partkey"] == t["l_partkey"], "left").select(F.col("p_partkey").alias("ticker"), ser.alias("series_ticker"), (F.col("p_partkey") % 40).alias("match_key"), F.col("p_type").alias("family"), "volume")


BANDS = """bi AS (SELECT p_partkey AS ticker, CASE WHEN p_brand = 'Brand#1' THEN 'WINNER' WHEN p_size = 9 THEN 'ADVANCE' WHEN p_brand = 'Brand#2' THEN 'GAME' ELSE p_type END AS series_ticker, p_partkey % 40 AS match_key, p_type AS family,
  (SELECT sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100e0 FROM lineitem WHERE l_partkey = p_partkey) AS volume FROM part),
bd AS (SELECT *, CASE WHEN series_ticker = 'WINNER' THEN 1 WHEN series_ticker IN ('GAME', 'ADVANCE') AND match_key IN (SELECT match_key FROM bi WHERE series_ticker = 'ADVANCE') THEN 2 WHEN family = 'ECONOMY' THEN 3 ELSE 4 END AS band FROM bi WHERE volume > 0)"""


@query("s18_priority_bands", v.sql(BANDS) + "SELECT ticker, band, volume FROM bd ORDER BY band, volume DESC, ticker LIMIT 600")
def _(s, d):
    return N.priority_bands(_band_input(s, d), "WINNER", "GAME", "ADVANCE", "ECONOMY", 600).select("ticker", "band", "volume")


@query("s18_band_summary", v.sql(BANDS) + "SELECT band, count(*) AS n_markets, round(sum(volume), 2) AS volume FROM bd GROUP BY 1")
def _(s, d):
    x = N.band_summary(N.priority_bands(_band_input(s, d), "WINNER", "GAME", "ADVANCE", "ECONOMY"))
    return shape(x, {"band": None, "n_markets": "long", "volume": 2})


NOW = 1706000000


def _lives(s, d, since=None):
    m = v.markets(s, d).select("ticker", "status", "open_ts", F.col("settle_ts").alias("close_ts"), F.col("tape_dollars").alias("volume"))
    return N.lifetimes(m, NOW, since=since)


LIVES = f"""lv AS (SELECT ticker, tape_dollars AS volume, open_ts AS o, greatest(least(CASE WHEN status = 'finalized' THEN settle_ts + 3600 ELSE settle_ts END, {NOW}), open_ts) AS e FROM markets)"""


@query("s19_lifetimes", v.sql(v.TAPE, v.MARKETS, LIVES) + "SELECT ticker, least(greatest(o, 1704300000), e) AS life_start, e AS life_end FROM lv")
def _(s, d):
    return _lives(s, d, 1704300000).select("ticker", "life_start", "life_end")


@query(
    "s20_extrapolate_trades",
    v.sql(v.TAPE, v.MARKETS, LIVES)
    + """, v AS (SELECT ticker, volume * CASE ticker % 4 WHEN 0 THEN 1000 WHEN 1 THEN 30 WHEN 2 THEN 0.1 ELSE 0 END AS volume, o, e FROM lv),
t AS (SELECT *, CASE WHEN volume < 1 THEN '0' WHEN volume < 1000 THEN '1-999' WHEN volume < 100000 THEN '1k-100k' WHEN volume < 1000000 THEN '100k-1M' WHEN volume < 10000000 THEN '1M-10M' ELSE '10M+' END AS tier FROM v),
s AS (SELECT tier, volume, (ticker % 9 + 1)::DOUBLE AS ratio FROM t WHERE ticker % 5 = 0 AND ticker % 4 IN (1, 2)), r AS (SELECT tier, avg(ratio) AS tr FROM s GROUP BY 1)
SELECT ticker, t.tier, round(coalesce(tr, (SELECT sum(ratio * volume) / sum(volume) FROM s)), 8) AS ratio, round(CASE WHEN volume > 0 THEN volume / coalesce(tr, (SELECT sum(ratio * volume) / sum(volume) FROM s)) ELSE 0 END, 5) AS est_trades,
 CAST(ceil(CASE WHEN volume > 0 THEN volume / coalesce(tr, (SELECT sum(ratio * volume) / sum(volume) FROM s)) ELSE 0 END / 1000) AS BIGINT) AS trade_requests,
 CAST(CASE WHEN volume <= 0 THEN 0 WHEN e - o <= 0 THEN 1 ELSE ceil((e - o) / 60 / 5000) END AS BIGINT) AS candle_requests FROM t LEFT JOIN r USING (tier)""",
)
def _(s, d):
    k = F.col("ticker") % 4
    factor = F.when(k == 0, 1000.0).when(k == 1, 30.0).when(k == 2, 0.1).otherwise(0.0)
    m = _lives(s, d).withColumn("volume", F.col("volume") * factor)
    samples = m.where("ticker % 5 = 0 and ticker % 4 in (1, 2)").select("volume", (F.col("ticker") % 9 + 1).cast("double").alias("ratio"))
    return shape(N.extrapolate_trades(m, samples), {"ticker": None, "tier": None, "ratio": 8, "est_trades": 5, "trade_requests": "long", "candle_requests": "long"})


@query(
    "s23_sinks",
    v.sql(v.TAPE) + "SELECT fmt, series_ticker, count(*) AS n, round(sum(count_contracts), 4) AS dollars FROM tape, (VALUES ('csv'), ('json'), ('parquet')) f(fmt) GROUP BY 1, 2",
)
def _(s, d):
    t = v.tape(s, d).select("trade_id", "ticker", "series_ticker", "created_ts", "count_contracts")
    root, parts = _folder(s), []
    for fmt in ("parquet", "csv", "json"):
        path = f"{root}/sink-{fmt}"
        tb.write_table(t, path, fmt, ["series_ticker"], ["ticker"])
        back = s.read.format(fmt).schema("trade_id long, ticker long, created_ts long, count_contracts double, series_ticker long")
        parts.append(back.option("header", True).load(path).withColumn("fmt", F.lit(fmt)))
    g = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("fmt", "series_ticker")
    return shape(g.agg(F.count(F.lit(1)).alias("n"), F.sum("count_contracts").alias("dollars")), {"fmt": None, "series_ticker": "long", "n": "long", "dollars": 4})


@query(
    "s24_json_records",
    v.sql(v.TAPE)
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY created_ts, trade_id) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM tape)
SELECT ticker, created_ts, '{"ticker":' || ticker || ',"created_ts":' || created_ts || ',"trade_id":' || trade_id || ',"cents":' || cents || '}' AS record FROM r WHERE n <= 20 OR EXISTS (SELECT 1 FROM range(20) g(j) WHERE (j * (n - 1)) // 19 = i)""",
)
def _(s, d):
    t = v.tape(s, d).select("ticker", "created_ts", "trade_id", (F.col("cents") + 0.2).alias("cents"))
    x = tb.to_records(t, ["ticker"], "created_ts", "trade_id", {"cents": 0}, 20)
    # Rounded cents print as 12.0; the record keeps whole numbers.
    return x.withColumn("record", F.regexp_replace("record", r"\.0}", "}"))
