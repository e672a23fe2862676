"""Queries for entity resolution and derived attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import entities as E
from marketlens.operators import quality as Q
from marketlens.plans import views as v
from marketlens.plans.registry import query, shape

DAY = 86400


def _code(c):
    return F.concat(F.lit("N"), F.lpad(c.cast("string"), 2, "0"))


def _keys(s, d):
    """Event keys in the market's own format, one per trade: PREFIX-24MMMDDC1C2."""
    e = v.events(s, d)
    c1, c2 = _code(F.col("user_id") % 25), _code((F.col("user_id") + 7) % 25)
    date = F.upper(F.date_format("ts", "MMMdd"))
    return e.select("event_id", F.concat(F.lit("GAME-24"), date, c1, c2).alias("event_ticker"))


KEYS = """keys AS (SELECT event_id, 'GAME-24' || upper(strftime(ts, '%b%d')) || 'N' || lpad((user_id % 25)::VARCHAR, 2, '0') || 'N' || lpad(((user_id + 7) % 25)::VARCHAR, 2, '0') AS event_ticker FROM events)"""


@query(
    "e01_parse_event_key",
    v.sql(KEYS) + "SELECT event_id, 'GAME' AS prefix, substr(event_ticker, 8, 5) AS date_part, substr(event_ticker, 13, 3) AS code1, substr(event_ticker, 16, 3) AS code2 FROM keys",
)
def _(s, d):
    return E.parse_event(_keys(s, d)).select("event_id", "prefix", "date_part", "code1", "code2")


def _names(s, d):
    return v.table(s, d, "nation").select(_code(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"), F.concat(F.lit("V-"), "n_name").alias("venue"))


@query(
    "e02_crosswalk",
    v.sql(KEYS)
    + """SELECT event_id, a.n_name AS team1_name, b.n_name AS team2_name, 'V-' || a.n_name AS team1_venue, 'V-' || b.n_name AS team2_venue FROM keys
LEFT JOIN nation a ON 'N' || lpad(a.n_nationkey::VARCHAR, 2, '0') = substr(event_ticker, 13, 3) LEFT JOIN nation b ON 'N' || lpad(b.n_nationkey::VARCHAR, 2, '0') = substr(event_ticker, 16, 3)""",
)
def _(s, d):
    x = E.crosswalk(E.parse_event(_keys(s, d)), _names(s, d), ["name", "venue"])
    return x.select("event_id", "team1_name", "team2_name", "team1_venue", "team2_venue")


def _pairs(s, d):
    """Customer and supplier nations as pairs of the orders; the venue lists some of them turned."""
    li = v.table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    sup = v.table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("q"))
    o = v.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = v.table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("p"))
    return li.join(sup, "l_suppkey").join(o, "l_orderkey").join(c, "c_custkey").select("l_orderkey", "l_linenumber", "p", "q")


PAIRS = """prs AS (SELECT l_orderkey, l_linenumber, c_nationkey AS p, s_nationkey AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
ven AS (SELECT p AS b1, q AS b2, min(l_orderkey) AS id FROM prs GROUP BY 1, 2)"""


@query(
    "e03_either_order_pairs",
    v.sql(PAIRS)
    + """SELECT l_orderkey, l_linenumber, coalesce(x.id, y.id) AS venue_id, coalesce(x.id, y.id) IS NOT NULL AS venue_id_found FROM prs
LEFT JOIN ven x ON x.b1 = p AND x.b2 = q LEFT JOIN ven y ON y.b1 = q AND y.b2 = p""",
)
def _(s, d):
    a = _pairs(s, d)
    b = a.select(F.col("p").alias("b1"), F.col("q").alias("b2"), F.col("l_orderkey").alias("id"))
    return E.match_pairs(a, b, "p", "q", "b1", "b2", "id", "venue_id").select("l_orderkey", "l_linenumber", "venue_id", "venue_id_found")


def _legs(s, d):
    """Regulation and advance legs of each order: lines 1, 2 and the rest are sides 1, 2 and tie."""
    li = v.table(s, d, "lineitem")
    side = F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_linenumber") == 2, 2).otherwise(0)
    code = F.concat(F.lit("S"), side.cast("string"))
    reg = li.select(F.col("l_orderkey").alias("match_id"), F.lit("regulation").alias("kind"), code.alias("code"), side.alias("side"), F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("result"))
    adv = li.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("match_id"), F.lit("advance").alias("kind"), code.alias("code"), side.alias("side"), F.when(F.col("l_linestatus") == "F", "yes").otherwise("no").alias("result"))
    return reg.unionByName(adv)


RESULTS = """res AS (SELECT match_id, regulation, advance, CASE WHEN regulation IS NULL THEN 'scheduled' ELSE 'finalized' END AS status, coalesce(regulation = 'TIE', false) AS beyond_regulation FROM (
 SELECT l_orderkey AS match_id, CASE WHEN bool_or(l_linenumber > 2 AND l_returnflag = 'R') THEN 'TIE' WHEN bool_or(l_linenumber = 1 AND l_returnflag = 'R') THEN 'S1' WHEN bool_or(l_linenumber = 2 AND l_returnflag = 'R') THEN 'S2' END AS regulation,
 CASE WHEN bool_or(l_linenumber = 1 AND l_linestatus = 'F') THEN 'S1' WHEN bool_or(l_linenumber = 2 AND l_linestatus = 'F') THEN 'S2' END AS advance FROM lineitem GROUP BY 1))"""


@query("e04_match_results", v.sql(RESULTS) + "SELECT * FROM res")
def _(s, d):
    return E.match_results(_legs(s, d))


@query("q12_result_mismatch", v.sql(RESULTS) + "SELECT match_id, regulation, advance FROM res WHERE regulation <> 'TIE' AND advance IS NOT NULL AND regulation <> advance")
def _(s, d):
    return Q.result_mismatch(E.match_results(_legs(s, d))).select("match_id", "regulation", "advance")


@query(
    "e05_entity_map",
    v.sql(RESULTS)
    + """SELECT o_orderkey AS match_id, regulation, advance, v.id AS venue_id, f.id AS fixture_id, v.id IS NULL OR f.id IS NULL AS unmappable FROM orders LEFT JOIN res ON res.match_id = o_orderkey
LEFT JOIN (SELECT l_orderkey AS m, min(l_partkey) AS id FROM lineitem WHERE l_quantity > 25 GROUP BY 1) v ON v.m = o_orderkey LEFT JOIN (SELECT l_orderkey AS m, min(l_suppkey) AS id FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) f ON f.m = o_orderkey""",
)
def _(s, d):
    li = v.table(s, d, "lineitem")
    m = v.table(s, d, "orders").select(F.col("o_orderkey").alias("match_id"))
    ven = li.where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.min("l_partkey").alias("venue_id"))
    fix = li.where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.min("l_suppkey").alias("fixture_id"))
    return E.entity_map(m, E.match_results(_legs(s, d)), ven, fix).select("match_id", "regulation", "advance", "venue_id", "fixture_id", "unmappable")


@query(
    "e06_override_join",
    """SELECT c_custkey, n_regionkey FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'NATION_0' ELSE c_mktsegment END AS k FROM customer) LEFT JOIN nation ON n_name = k""",
)
def _(s, d):
    c = v.table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"))
    n = v.table(s, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    over = v.table(s, d, "nation").where("n_nationkey = 0").select(F.lit("BUILDING").alias("name"), F.col("n_name").alias("use"))
    return E.override_join(c, n, "name", over).select("c_custkey", "n_regionkey")


@query(
    "e07_normalised_names",
    """SELECT a.p_partkey, count(b.p_partkey) AS n_same FROM part a LEFT JOIN part b
 ON list_sort(string_split(lower(a.p_name), ' ')) = list_sort(string_split(lower(b.p_name), ' ')) AND b.p_size < 5 GROUP BY 1""",
)
def _(s, d):
    p = v.table(s, d, "part")
    a = p.select("p_partkey", F.array_join(F.reverse(F.split(F.upper("p_name"), " ")), " ").alias("a_name"))
    b = p.where("p_size < 5").select(E.normal_name(F.col("p_name")).alias("b_name")).groupBy("b_name").agg(F.count(F.lit(1)).alias("n"))
    alias = v.table(s, d, "region").select(F.col("r_name").alias("name"), F.lower("r_name").alias("alias"))
    j = E.norm_name_join(a, b, "a_name", "b_name", alias)
    return j.select("p_partkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_same"))


@query("e08_market_ref", "SELECT c_custkey AS ticker, n_nationkey AS series_ticker, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2".replace("n_nationkey AS", "c_nationkey AS"))
def _(s, d):
    m = v.table(s, d, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_nationkey").alias("series_ticker"))
    n = v.table(s, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("series_ticker"), "n_name", "n_regionkey")
    return E.market_ref(m, n).select("ticker", "series_ticker", "n_name", "n_regionkey")


_RULES = (("metal", ("steel", "brass", "ring")), ("tiny", ("small", "mini")), ("colour", ("red", "blue", "green")))


@query(
    "e09_classify",
    """SELECT p_partkey, CASE WHEN p_name LIKE '%steel%' OR p_name LIKE '%brass%' OR p_name LIKE '%ring%' THEN 'metal' WHEN p_name LIKE '%small%' OR p_name LIKE '%mini%' THEN 'tiny'
 WHEN p_name LIKE '%red%' OR p_name LIKE '%blue%' OR p_name LIKE '%green%' THEN 'colour' ELSE 'other' END AS family FROM part""",
)
def _(s, d):
    return E.classify(v.table(s, d, "part"), "p_name", _RULES).select("p_partkey", "family")


@query(
    "e10_family_code",
    """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN p_brand = 'Brand#1' THEN 1 WHEN p_brand = 'Brand#2' THEN 2 ELSE 3 END WHEN p_type = 'STANDARD' THEN 0 WHEN p_type = 'PROMO' THEN 4 ELSE 8 END AS family_code FROM part""",
)
def _(s, d):
    x = E.family_enum(
        v.table(s, d, "part"), "p_type", "p_brand", {"STANDARD": "winner_futures", "PROMO": "group"}, "ECONOMY", {"Brand#1": "match_3way", "Brand#2": "advancement"}, "spread_total_score"
    )
    return x.select("p_partkey", "family_code")


@query(
    "e11_team_index",
    """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 10 > 0 THEN coalesce(n_nationkey + 1, 0) ELSE 0 END AS team_idx
FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 30""",
)
def _(s, d):
    c = v.table(s, d, "customer")
    tail = F.when(F.col("c_custkey") % 10 == 0, "TIE").otherwise(_code(F.col("c_custkey") % 30))
    t = c.select("c_custkey", F.col("c_mktsegment").alias("series"), F.concat_ws("-", "c_mktsegment", F.lit("24"), tail).alias("ticker"))
    keyed = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_mktsegment").alias("series"))
    codes = v.table(s, d, "nation").select(_code(F.col("n_nationkey")).alias("code"), (F.col("n_nationkey") + 1).alias("idx"))
    return E.team_index(t, "ticker", "series", keyed, codes).select("c_custkey", "team_idx")


@query(
    "e12_fate",
    """SELECT o_orderkey, f AS fate, CASE f WHEN 'settled_no' THEN 0 WHEN 'settled_yes' THEN 1 WHEN 'voided' THEN 2 ELSE 3 END AS fate_code FROM (
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'settled_yes' WHEN 1 THEN 'settled_no' ELSE 'voided' END WHEN o_orderstatus = 'P' THEN 'voided' ELSE 'alive_at_freeze' END AS f FROM orders)""",
)
def _(s, d):
    o = v.table(s, d, "orders")
    st = F.when(F.col("o_orderstatus") == "F", "finalized").when(F.col("o_orderstatus") == "P", "closed").otherwise("active")
    rs = F.when(F.col("o_orderkey") % 3 == 0, "yes").when(F.col("o_orderkey") % 3 == 1, "no").otherwise("scalar")
    return E.fate(o.select("o_orderkey", st.alias("status"), rs.alias("result"))).select("o_orderkey", "fate", "fate_code")


def _matches(s, d):
    """Two sides and a regulation result per order."""
    r = E.match_results(_legs(s, d))
    return r.select("match_id", "regulation", "advance", F.lit("S1").alias("code1"), F.lit("S2").alias("code2"), F.lit("TIE").alias("code0"))


def _leg_rows(s, d):
    cols = {"team1": {"code": "code1"}, "team2": {"code": "code2"}, "tie": {"code": "code0"}}
    return E.legs(_matches(s, d), cols)


_LEG_SQL = "lg AS (SELECT match_id, unnest(['team1', 'team2', 'tie']) AS leg, unnest(['S1', 'S2', 'TIE']) AS code, regulation FROM res)"


@query("e13_legs", v.sql(RESULTS, _LEG_SQL) + "SELECT match_id, leg, code, (regulation = code)::INT AS outcome FROM lg")
def _(s, d):
    return _leg_rows(s, d).select("match_id", "leg", "code", "outcome")


@query(
    "e14_horizon_targets",
    v.sql(RESULTS, _LEG_SQL)
    + """SELECT match_id, leg, h.n AS horizon, (epoch(o_orderdate) - h.s)::BIGINT AS target_ts FROM lg JOIN orders ON o_orderkey = match_id, (VALUES ('T-24h', 86400), ('T-1h', 3600), ('T-5min', 300)) h(n, s)""",
)
def _(s, d):
    o = v.table(s, d, "orders").select(F.col("o_orderkey").alias("match_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("resolved"))
    x = E.targets(_leg_rows(s, d).join(o, "match_id"), {"T-24h": DAY, "T-1h": 3600, "T-5min": 300}, "resolved")
    return x.select("match_id", "leg", "horizon", "target_ts")


ELIMS = """el AS (SELECT match_id, CASE advance WHEN 'S1' THEN 'S2' ELSE 'S1' END AS loser, epoch(l_shipdate)::BIGINT AS elim_ts FROM res
  JOIN lineitem ON l_orderkey = match_id AND l_linenumber = CASE advance WHEN 'S1' THEN 2 ELSE 1 END WHERE advance IS NOT NULL)"""


def _elims(s, d):
    li = v.table(s, d, "lineitem").where("l_linenumber <= 2")
    m = li.select(F.col("l_orderkey").alias("match_id"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("code"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("settle_ts"))
    return E.eliminations(_matches(s, d), m)


@query("e15_eliminations", v.sql(RESULTS, ELIMS) + "SELECT match_id, loser, elim_ts FROM el")
def _(s, d):
    return _elims(s, d).select("match_id", "loser", "elim_ts")


@query(
    "e16_team_props",
    """WITH x AS (SELECT c_custkey, 'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS loser FROM customer WHERE c_acctbal < 0)
SELECT loser AS team, p_partkey AS ticker, c_custkey AS elim_ts FROM x JOIN part ON p_type IN ('ECONOMY', 'PROMO') AND 'N' || lpad((p_partkey % 25)::VARCHAR, 2, '0') = loser""",
)
def _(s, d):
    el = v.table(s, d, "customer").where("c_acctbal < 0").select(_code(F.col("c_nationkey")).alias("loser"), F.col("c_custkey").alias("elim_ts"))
    m = v.table(s, d, "part").select(F.concat_ws("-", "p_type", F.concat(F.lit("24"), _code(F.col("p_partkey") % 25))).alias("event_ticker"), F.col("p_partkey").alias("ticker"))
    return E.team_props(el, ["ECONOMY", "PROMO"], m, "24")


@query(
    "e17_resolution_time",
    "SELECT o_orderkey, (CASE WHEN o_orderkey % 4 = 0 THEN epoch(o_orderdate) + 3600 ELSE epoch(o_orderdate) END)::BIGINT AS resolution_ts FROM orders",
)
def _(s, d):
    ts = F.col("o_orderdate").cast("timestamp")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    o = v.table(s, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 == 0, iso(ts + F.expr("INTERVAL 1 HOUR"))).when(F.col("o_orderkey") % 4 == 1, "not yet").alias("settlement_ts"),
        iso(ts).alias("close_time"),
    )
    return E.resolution(o).select("o_orderkey", "resolution_ts")


_LAST = "lst AS (SELECT ticker, arg_max(yes_price_usd, created_ts) AS p FROM tape GROUP BY 1)"


@query(
    "e18_winners",
    v.sql(v.TAPE, v.MARKETS, _LAST)
    + """, g AS (SELECT match_id, min(leg) FILTER (WHERE status = 'finalized' AND result = 'yes') AS a, min(leg) FILTER (WHERE p >= 0.8) AS b, string_agg(DISTINCT leg, '/' ORDER BY leg) AS c FROM markets JOIN lst USING (ticker) GROUP BY 1)
SELECT match_id, coalesce(a, b, c) AS winner, CASE WHEN a IS NOT NULL THEN 'catalog' WHEN b IS NOT NULL THEN 'price' ELSE 'provisional' END AS basis FROM g""",
)
def _(s, d):
    m = v.markets(s, d).select("match_id", "ticker", F.col("leg").alias("side"), "status", "result")
    return E.winners(m, v.tape(s, d), 0.8)


@query(
    "e19_top_terminal",
    v.sql(v.TAPE, v.MARKETS, _LAST) + "SELECT match_id, arg_max(leg, struct_pack(p := p, l := leg)) AS method, max(p) AS last_price FROM markets JOIN lst USING (ticker) GROUP BY 1",
)
def _(s, d):
    return E.top_terminal(v.tape(s, d), v.markets(s, d).select("ticker", "match_id", "leg"), "match_id", "leg")


@query(
    "e20_labels",
    """SELECT p_partkey, CASE WHEN p_size < 5 THEN p_name WHEN p_partkey % 9 = 0 THEN 'Draw' WHEN p_partkey % 30 < 25 THEN 'NATION_' || (p_partkey % 30) || ' to win' ELSE 'N' || lpad((p_partkey % 30)::VARCHAR, 2, '0') || ' to win' END AS title,
 CASE WHEN p_type = 'ECONOMY' THEN 'Settled yes' WHEN p_type = 'PROMO' THEN 'Settled no' ELSE 'Open' END AS settle_label FROM part""",
)
def _(s, d):
    p = v.table(s, d, "part")
    tail = F.when(F.col("p_partkey") % 9 == 0, "TIE").otherwise(_code(F.col("p_partkey") % 30))
    m = p.select(
        "p_partkey",
        F.concat_ws("-", F.lit("GAME"), F.lit("24"), tail).alias("ticker"),
        F.when(F.col("p_type") == "ECONOMY", "settled_yes").when(F.col("p_type") == "PROMO", "settled_no").otherwise("alive_at_freeze").alias("fate"),
        F.when(F.col("p_size") < 5, F.col("p_name")).otherwise("").alias("sub_title"),
    )
    return E.labels(m, _names(s, d)).select("p_partkey", "title", "settle_label")


@query(
    "e21_flags",
    """SELECT p_partkey, (CASE WHEN p_size < 10 THEN 1 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 2 ELSE 0 END + CASE WHEN p_retailprice > 1200 THEN 4 ELSE 0 END) AS flags FROM part""",
)
def _(s, d):
    p = v.table(s, d, "part")
    return E.flags(p, "p_partkey", [p.where("p_size < 10"), p.where("p_type = 'PROMO'"), p.where("p_retailprice > 1200")]).select("p_partkey", "flags")


@query("e22_match_id", v.sql(KEYS) + "SELECT event_id, substr(event_ticker, 8) AS match_id, 'ADVANCE' || substr(event_ticker, 5) AS advance_ticker FROM keys")
def _(s, d):
    x = E.rewrite_family(E.match_id(_keys(s, d)), "event_ticker", "GAME", "ADVANCE", "advance_ticker")
    return x.select("event_id", "match_id", "advance_ticker")


@query("e23_pick_token", "SELECT event_id, 't' || user_id AS first_token, CASE WHEN event_id % 3 > 0 THEN 't' || event_id END AS second_token FROM events")
def _(s, d):
    t = lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    e = v.events(s, d).select("event_id", F.to_json(F.when(F.col("event_id") % 3 > 0, F.array(t("user_id"), t("event_id"))).otherwise(F.array(t("user_id")))).alias("tokens"))
    x = E.pick_token(E.pick_token(e, "tokens", 0, "first_token"), "tokens", 1, "second_token")
    return x.select("event_id", "first_token", "second_token")
