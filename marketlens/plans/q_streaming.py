"""Streaming jobs driven over the given events table to completion (L1-L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.plans import views as v
from marketlens.plans.q_sources import _folder
from marketlens.plans.registry import query, shape
from marketlens.session import prepare
from marketlens.streaming import live as L


DAY = 86400
#: Days of arrivals that a micro-batch covers.
_STEP = 5


def _batches(s, d, root, marker=False):
    """The events as they arrive, one file per micro-batch of five days: every third row half an hour late, every 17th
    two days; every tenth row comes again with the next batch. A marker far ahead, of no market, may end the feed."""
    e = prepare(s).read.parquet(f"{d}/events.parquet")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    lag = F.when(F.col("event_id") % 17 == 0, 2 * DAY).when(F.col("event_id") % 3 == 0, 1800).otherwise(0)
    first = e.agg(F.min(at).alias("t0"), F.max(at).alias("t1")).first()
    f = F.floor((at + lag - first["t0"]) / (_STEP * DAY))
    arrived = e.withColumn("f", f)
    arrived = arrived.unionByName(e.where("event_id % 10 = 0").withColumn("f", f + 1))
    n = (first["t1"] + 2 * DAY - first["t0"]) // (_STEP * DAY) + 2
    # The tables are scanned once for all batches; each batch then reads its own folder.
    arrived.hint("rebalance", "f").write.partitionBy("f").parquet(f"{root}/arrived")
    staged = s.read.schema(arrived.schema).parquet(f"{root}/arrived")
    for k in range(n):  # files are read in the order in which they were written, by several tasks each
        staged.where(F.col("f") == k).drop("f").coalesce(1).write.option("parquet.block.size", 8 << 20).parquet(f"{root}/in/b{k:03d}")
    if marker:
        far = e.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 3650 DAYS")).withColumn("user_id", F.lit(None).cast(e.schema["user_id"].dataType))
        far.coalesce(1).write.parquet(f"{root}/in/b{n:03d}")
    return _trades(s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/b*"))


#: Rows with the micro-batch in which they first arrive.
ARRIVALS = f"""t0 AS (SELECT min(created_ts) AS t0 FROM tape),
arrivals AS (
  SELECT tape.*, (created_ts + CASE WHEN trade_id % 17 = 0 THEN {2 * DAY} WHEN trade_id % 3 = 0 THEN 1800 ELSE 0 END - t0) // {_STEP * DAY} AS f FROM tape, t0),
marks AS (
  SELECT f, max(max(created_ts)) OVER (ORDER BY f RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600 AS mark,
    max(max(created_ts)) OVER (ORDER BY f RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 3600 AS closed FROM arrivals GROUP BY f)"""


def _trades(e):
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("trade_id"),
        F.col("user_id").alias("ticker"),
        (F.col("user_id") % 5).alias("series_ticker"),
        ts.alias("created_at"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("int") / 100.0).alias("yes_price_usd"),
        F.col("value").alias("count_contracts"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") > 150), "finalized").otherwise("active").alias("status"),
    )


@query("l01_stream_ingest", v.sql(v.TAPE) + "SELECT trade_id, ticker, series_ticker::INT AS series_ticker, yes_price_usd, count_contracts FROM tape")
def _(s, d):
    root = _folder(s)
    L.stream_ingest(_batches(s, d, root), f"{root}/tape", f"{root}/checkpoint", once=True).awaitTermination()
    return L.read_ingested(s, f"{root}/tape").select("trade_id", "ticker", "series_ticker", "yes_price_usd", "count_contracts")


@query(
    "l02_live_bars",
    v.sql(v.TAPE, ARRIVALS)
    + """SELECT ticker, created_ts // 3600 * 3600 AS bar_ts, arg_max(yes_price_usd, (created_ts, trade_id)) AS price, round(sum(count_contracts), 4) AS contracts,
  count(*) AS n_trades, count(*) FILTER (WHERE created_ts < mark) AS n_late FROM arrivals JOIN marks USING (f) GROUP BY 1, 2""",
)
def _(s, d):
    root = _folder(s)
    bars = L.bar_writer(s, f"{root}/live", 3600)
    L.stream_ingest(_batches(s, d, root), f"{root}/tape", f"{root}/checkpoint", once=True, then=bars).awaitTermination()
    return shape(L.read_bars(s, f"{root}/live"), {"ticker": None, "bar_ts": "long", "price": None, "contracts": 4, "n_trades": "long", "n_late": "long"})


@query("l03_settlement_watch", "SELECT DISTINCT user_id AS ticker FROM events WHERE event_type = 'purchase' AND value > 150")
def _(s, d):
    root = _folder(s)

    def refresh(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/settled/b-{batch_id:08d}")

    L.on_settlement(L.settlement_watch(_batches(s, d, root)), f"{root}/checkpoint", refresh, once=True).awaitTermination()
    return s.read.parquet(f"{root}/settled/b-*")


#: A batch still adds to the bars that the batch before it left open, by the newest trade of those before that. Of one
#: market the next alert is the first move that is far enough from the last one.
_ALERTS = """, bars AS (
  SELECT ticker, created_ts // 3600 * 3600 AS bar, arg_max(yes_price_usd, (created_ts, trade_id)) AS price FROM arrivals JOIN marks USING (f)
  WHERE closed IS NULL OR created_ts // 3600 * 3600 + 3600 > closed GROUP BY 1, 2),
m AS (SELECT *, round(price - lag(price) OVER w, 9) AS move, bar - lag(bar) OVER w AS gap FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY bar)),
c AS (SELECT ticker, bar, move, price FROM m WHERE gap <= 432000 AND abs(move) >= 0.3),
a AS (
  SELECT ticker, min(bar) AS bar FROM c GROUP BY ticker
  UNION ALL SELECT a.ticker, min(c.bar) FROM a JOIN c ON a.ticker = c.ticker AND c.bar >= a.bar + 21600 GROUP BY a.ticker, a.bar)
SELECT ticker, bar AS alert_ts, move, price FROM c JOIN a USING (ticker, bar)"""


@query("l04_repricing_alerts", v.sql(v.TAPE, ARRIVALS).replace("WITH ", "WITH RECURSIVE ", 1) + _ALERTS)
def _(s, d):
    root = _folder(s)
    trades = _batches(L.with_timers(s), d, root, marker=True)
    alerts = L.repricing_alerts(trades, 0.3, 6 * 3600.0, 5 * DAY, "1 hour")
    L.run_append(alerts, f"{root}/alerts", f"{root}/checkpoint", once=True).awaitTermination()
    return s.read.parquet(f"{root}/alerts/b-*").select("ticker", F.unix_seconds("alert_ts").alias("alert_ts"), "move", "price")
