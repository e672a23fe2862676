"""Market-shaped views over the given tables, once for Spark and once as DuckDB CTEs.

``tape`` reads ``events`` as trades, and the other views derive markets, windows, quotes, legs
and books from it or from the order tables. Nothing is cached or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import prepare

WINDOW_S = 12600
GRAIN = 500
GRAIN_WIDE = 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    # events.ts carries no zone: read it as UTC once, here.
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tape(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return events(spark, d).select(
        F.col("event_id").alias("trade_id"),
        F.col("user_id").alias("ticker"),
        (F.col("user_id") % 5).alias("series_ticker"),
        F.unix_seconds("ts").alias("created_ts"),
        k.alias("cents"),
        (k / F.lit(100.0)).alias("yes_price_usd"),
        F.col("value").alias("count_contracts"),
        F.when(F.col("event_type").isin("purchase", "signup"), "yes").otherwise("no").alias("taker_side"),
        "event_type",
    )


TAPE = """tape AS (
  SELECT event_id AS trade_id, user_id AS ticker, user_id % 5 AS series_ticker,
         CAST(floor(epoch(ts)) AS BIGINT) AS created_ts,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS cents,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) / 100e0 AS yes_price_usd,
         value AS count_contracts,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'yes' ELSE 'no' END AS taker_side,
         event_type
  FROM events)"""


def falling(df: DataFrame, tie: str) -> Column:
    """An id as a value that falls where the id rises; of text, the bytes' complement, closed so that a prefix comes last."""
    if df.schema[tie].dataType.typeName() == "string":
        return F.concat(F.translate(F.hex(tie), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return -F.col(tie)


def first_print(df: DataFrame, tie: str = "trade_id") -> DataFrame:
    """Turn the tie-break round: of several prints of a market in one second the first one counts as the last.

    This is what ``arg_max(x, created_ts)`` keeps, which orders by the second alone and holds on to the first row.
    """
    return df.withColumn(tie, falling(df, tie))


def markets(spark: SparkSession, d: str) -> DataFrame:
    t = tape(spark, d)
    m = t.groupBy("ticker", "series_ticker").agg(
        F.min("created_ts").alias("open_ts"),
        F.max("created_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n_trades"),
        F.sum("count_contracts").alias("tape_dollars"),
    )
    even = F.col("ticker") % 2 == 0
    return m.select(
        "ticker",
        "series_ticker",
        F.floor(F.col("ticker") / 3).alias("match_id"),
        F.element_at(F.array(F.lit("team1"), F.lit("team2"), F.lit("tie")), (F.col("ticker") % 3 + 1).cast("int")).alias("leg"),
        F.when(F.col("ticker") % 3 == 0, "yes").otherwise("no").alias("result"),
        F.when(F.col("ticker") % 11 == 0, "active").otherwise("finalized").alias("status"),
        (F.col("ticker") % 13 != 0).alias("in_scope"),
        "open_ts",
        "last_ts",
        F.when(even, F.col("last_ts") + 3600).otherwise(F.floor((F.col("open_ts") + F.col("last_ts")) / 2)).alias("settle_ts"),
        "n_trades",
        "tape_dollars",
    )


MARKETS = """markets AS (
  SELECT ticker, series_ticker, ticker // 3 AS match_id,
         CASE ticker % 3 WHEN 0 THEN 'team1' WHEN 1 THEN 'team2' ELSE 'tie' END AS leg,
         CASE WHEN ticker % 3 = 0 THEN 'yes' ELSE 'no' END AS result,
         CASE WHEN ticker % 11 = 0 THEN 'active' ELSE 'finalized' END AS status,
         ticker % 13 <> 0 AS in_scope,
         min(created_ts) AS open_ts, max(created_ts) AS last_ts,
         CASE WHEN ticker % 2 = 0 THEN max(created_ts) + 3600
              ELSE (min(created_ts) + max(created_ts)) // 2 END AS settle_ts,
         count(*) AS n_trades, sum(count_contracts) AS tape_dollars
  FROM tape GROUP BY ticker, series_ticker)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Each market with the time of its match: from the first trade of any of its legs to the last."""
    m = markets(spark, d)
    life = m.groupBy("match_id").agg(F.min("open_ts").alias("lo"), F.max("last_ts").alias("hi"))
    return m.select("match_id", "leg", "ticker", "result").join(life, "match_id")


SPANS = """spans AS (
  SELECT match_id, leg, ticker, result, min(open_ts) OVER (PARTITION BY match_id) AS lo, max(last_ts) OVER (PARTITION BY match_id) AS hi FROM markets)"""


def windows(spark: SparkSession, d: str) -> DataFrame:
    """Every error row opens a window of its own market."""
    e = events(spark, d).where(F.col("event_type") == "error")
    start = F.unix_seconds("ts")
    return e.select(F.col("event_id").alias("event"), F.col("user_id").alias("ticker"), start.alias("win_start"), (start + WINDOW_S).alias("win_end"))


WINDOWS = f"""windows AS (
  SELECT event_id AS event, user_id AS ticker, CAST(floor(epoch(ts)) AS BIGINT) AS win_start,
         CAST(floor(epoch(ts)) AS BIGINT) + {WINDOW_S} AS win_end
  FROM events WHERE event_type = 'error')"""

#: The window of its market that started last, the one with the larger id where two start together.
OWNER = """owner AS (
  SELECT t.*, CASE WHEN t.created_ts <= w.win_end THEN w.event END AS event
  FROM tape t ASOF LEFT JOIN (SELECT ticker, win_start, max(event) AS event, max(win_end) AS win_end FROM windows GROUP BY 1, 2) w
  ON t.ticker = w.ticker AND t.created_ts >= w.win_start)"""

#: Islands of windows that overlap or touch, numbered per market.
ISLANDS = """o AS (
  SELECT *, max(win_end) OVER (PARTITION BY ticker ORDER BY win_start, win_end, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM windows),
i AS (
  SELECT *, sum(CASE WHEN seen IS NULL OR win_start > seen THEN 1 ELSE 0 END)
    OVER (PARTITION BY ticker ORDER BY win_start, win_end, event ROWS UNBOUNDED PRECEDING) AS island FROM o),
islands AS (
  SELECT ticker, CAST(island AS BIGINT) AS island, min(win_start) AS island_start, max(win_end) AS island_end, count(*) AS n_merged,
    max(win_end) - min(win_start) AS covered_s FROM i GROUP BY 1, 2)"""


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Bookmaker-style quotes: the view and click rows, three outcomes per fixture."""
    e = events(spark, d).where(F.col("event_type").isin("view", "click"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    raw = F.greatest(k / F.lit(100.0), F.lit(0.01))
    over = F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(1.05)
    return e.select(
        F.col("event_id").alias("quote_id"),
        F.floor(F.col("user_id") / 3).alias("fixture_id"),
        (F.col("user_id") % 3).alias("outcome_id"),
        F.col("user_id").alias("ticker"),
        (F.col("user_id") % 2).alias("bookmaker"),
        F.unix_seconds("ts").alias("created_ts"),
        F.unix_millis("ts").alias("created_ms"),
        (F.col("event_id") % 7 != 0).alias("active"),
        (F.lit(1.0) / raw).alias("price_decimal"),
        over.alias("overround"),
        raw.alias("prob_raw"),
        F.when(over == 0, F.lit(None)).otherwise(raw / over).alias("prob"),
    )


QUOTES = """quotes AS (
  SELECT quote_id, fixture_id, outcome_id, ticker, ticker % 2 AS bookmaker, created_ts, created_ms, active,
         1e0 / prob_raw AS price_decimal, overround, prob_raw,
         CASE WHEN overround = 0 THEN NULL ELSE prob_raw / overround END AS prob
  FROM (SELECT event_id AS quote_id, user_id // 3 AS fixture_id, user_id % 3 AS outcome_id, user_id AS ticker,
               CAST(floor(epoch(ts)) AS BIGINT) AS created_ts, epoch_ms(ts) AS created_ms,
               event_id % 7 <> 0 AS active,
               greatest(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) / 100e0, 0.01e0) AS prob_raw,
               CASE WHEN event_id % 50 = 0 THEN 0e0 ELSE 1.05e0 END AS overround
        FROM events WHERE event_type IN ('view', 'click')))"""


def order_book(spark: SparkSession, d: str) -> DataFrame:
    """Orders as dated dollars of a family (the buyer's segment)."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("family"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("trade_id"),
        F.col("o_custkey").alias("ticker"),
        "family",
        F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).cast("date").alias("day"),
        F.col("o_totalprice").alias("dollars"),
    )


ORDER_BOOK = """order_book AS (
  SELECT o_orderkey AS trade_id, o_custkey AS ticker, c_mktsegment AS family,
         CAST(o_orderdate AS DATE) AS day, o_totalprice AS dollars
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def part_totals(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.groupBy(F.col("l_partkey").alias("ticker")).agg(
        (F.sum(cents) / 100).alias("dollars"), F.count(F.lit(1)).alias("n_trades")
    )


PART_TOTALS = """part_totals AS (
  SELECT l_partkey AS ticker, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100e0 AS dollars,
         count(*) AS n_trades
  FROM lineitem GROUP BY l_partkey)"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


def traded_parts(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
        .select(F.col("l_partkey").alias("p_partkey"))
    )


def sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
