"""Declared schemas, scans, snapshots and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators import temporal

_KINDS = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "i": T.IntegerType(), "b": T.BooleanType()}


def struct(**columns: str) -> T.StructType:
    """Schema from short kinds: s string, d double, l long, i int, b boolean."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in columns.items()])


TRADES = struct(
    trade_id="s", ticker="s", created_time="s", created_ts="l", count_fp="s", yes_price_dollars="s", no_price_dollars="s",
    count_contracts="d", yes_price_usd="d", no_price_usd="d", taker_side="s", taker_outcome_side="s", taker_book_side="s",
    is_block_trade="b", source_segment="s", series_ticker="s",
)
CANDLE_GROUPS = ("price", "yes_ask", "yes_bid")
CANDLE_STATS = ("open", "high", "low", "close", "mean", "previous")
CANDLES = T.StructType(
    struct(ticker="s", end_period_ts="l", open_interest_fp="s", volume_fp="s", open_interest_contracts="d", volume_contracts="d").fields
    + [T.StructField(f"{g}_{st}_{unit}", kind) for g in CANDLE_GROUPS for st in CANDLE_STATS for unit, kind in (("dollars", T.StringType()), ("usd", T.DoubleType()))]
    + [T.StructField("series_ticker", T.StringType())]
)
MARKETS = struct(
    ticker="s", event_ticker="s", series_ticker="s", status="s", result="s", title="s", yes_sub_title="s", event_title="s",
    open_time="s", close_time="s", settlement_ts="s", occurrence_datetime="s", expiration="s", volume_contracts="d",
    volume_24h_contracts="d", open_interest_contracts="d", liquidity_usd="d", last_price_usd="d", in_narrative_scope="b", scope_note="s",
)
SERIES = struct(
    ticker="s", title="s", category="s", tags="s", fee_type="s", frequency="s", matched_by="s", family="s", n_events="l", n_markets="l",
    zero_volume_market_count="l", total_volume_contracts="d", in_narrative_scope="b", scope_note="s",
)
QUOTES = struct(
    fixture_id="s", participant1="s", participant2="s", fixture_start_time="s", bookmaker="s", market_id="s", market_name="s", outcome_id="s",
    player_id="s", created_at="s", tournament_id="l", price_decimal="d", limit="d", active="b", epoch_utc_seconds="l",
    pulled_at_utc_epoch_seconds="l", overround_at_ts="d", implied_prob_raw="d", implied_prob_devigged="d",
)
PRICES = struct(
    token_id="s", outcome_label="s", market_id="s", market_slug="s", question="s", event_id="s", event_slug="s", event_title="s", family="s",
    outcome_index="i", fidelity_minutes="i", ts_utc="l", price_raw="d", implied_prob="d", priority_tier="i", fidelity="i",
)


def read_trades(spark: SparkSession, root: str) -> DataFrame:
    """The tape, hive-partitioned by ``series_ticker``, with ``created_at`` as a timestamp."""
    return spark.read.schema(TRADES).parquet(root).withColumn("created_at", F.timestamp_seconds("created_ts"))


def scan(t: DataFrame, series: str | Sequence[str] | None = None, tickers: DataFrame | None = None, lo: int | None = None, hi: int | None = None, ordered: bool = False) -> DataFrame:
    """Pruned scan (S02): partition filter, pushed time range, semi join for many tickers."""
    if series is not None:
        t = t.where(F.col("series_ticker").isin(series if isinstance(series, (list, tuple)) else [series]))
    if lo is not None:
        t = t.where(F.col("created_ts") >= lo)
    if hi is not None:
        t = t.where(F.col("created_ts") <= hi)
    if tickers is not None:
        t = t.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    return t.orderBy("ticker", "created_ts", "trade_id") if ordered else t


def read_candles(spark: SparkSession, root: str) -> DataFrame:
    """Minute candles with a close (S03); columns absent from a file read as null."""
    return spark.read.schema(CANDLES).parquet(root).where(F.col("price_close_usd").isNotNull())


def read_prices(spark: SparkSession, root: str, tiers: Sequence[int] | None = None) -> DataFrame:
    """Snapshot prices of some priority tiers (S04), both fidelities."""
    p = spark.read.schema(PRICES).parquet(root)
    return p if tiers is None else p.where(F.col("priority_tier").isin(list(tiers)))


def finest(p: DataFrame, key: str = "token_id", fidelity: str = "fidelity") -> DataFrame:
    """Keep each token's finest available fidelity (S04): 1-minute rows, else hourly ones."""
    best = p.groupBy(key).agg(F.min(fidelity).alias(fidelity))
    return p.join(best, [key, fidelity], "left_semi")


def snapshot(df: DataFrame, path: str, ts: str) -> DataFrame:
    """Freeze a moving table once and return its manifest: rows and latest time."""
    df.write.mode("overwrite").parquet(path)
    frozen = df.sparkSession.read.parquet(path)
    return frozen.agg(F.count(F.lit(1)).alias("n_rows"), F.max(ts).alias("max_ts"), F.min(ts).alias("min_ts"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = (), sort: Sequence[str] = ()) -> None:
    """Parquet, CSV or JSON table.

    With partition columns the rows are first spread by them and by a hash of the sort columns,
    so that one large partition is written by several tasks and not by one.
    """
    if partition:
        df = df.repartition(*partition, *sort)
        if sort:
            df = df.sortWithinPartitions(*partition, *sort)
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition) if partition else w).save(path)


def to_records(df: DataFrame, keys: Sequence[str], ts: str, tie: str, round_map: Mapping[str, int], limit: int) -> DataFrame:
    """Rows as JSON text, rounded, thinned to ``limit`` evenly spaced ones per key."""
    thin = temporal.even_points(df, keys, ts, tie, limit).drop("n_raw")
    for c, nd in round_map.items():
        thin = thin.withColumn(c, F.round(c, nd))
    return thin.select(*keys, ts, F.to_json(F.struct(*thin.columns)).alias("record"))
