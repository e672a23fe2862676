"""Structured Streaming jobs: ingest, live bars, settlement watch, repricing alerts (L1-L4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DateType, StructField, StructType

from marketlens.operators import temporal as T

#: Settlement prints arrive up to 41 minutes after the close.
LATE = "1 hour"
TERMINAL = ("closed", "finalized", "settled")


def _start(df: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None], once: bool) -> StreamingQuery:
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (w.trigger(availableNow=True) if once else w).start()


def stream_ingest(src: DataFrame, out: str, checkpoint: str, ts: str = "created_at", key: str = "trade_id", partition: str = "series_ticker", watermark: str = LATE, once: bool = False, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append each trade once, replays included and however late (L1).

    A batch keeps one row per id and leaves out ids that earlier batches have on the same days, which is all of the
    tape that it reads: batches are stored by day, and the days of a batch are a short list. A micro-batch
    owns one directory per day and overwrites it, so a retried batch leaves the same files: exactly once end to end.
    A copy must carry the time of its first. ``watermark`` bounds nothing here; no trade is too late for the tape.
    ``then`` is called with the batch's new trades, as written, and its number (see ``bar_writer``).
    """
    spark = src.sparkSession
    # A schema of its own: ``add`` changes the schema that it is called on.
    columns = StructType([*src.schema.fields, StructField("day", DateType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates([key]).withColumn("day", F.to_date(ts)).persist()
        try:
            days = [r["day"] for r in fresh.select("day").distinct().collect()]
            known = None
            if batch_id and days:
                root = spark._jvm.org.apache.hadoop.fs.Path(out)
                exists = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
                known = read_ingested(spark, out, bare=False).where(F.col("day").isin(days) & (F.col("batch") < batch_id)) if exists else None
            new = fresh if known is None else fresh.join(known.select(F.col(key)), key, "left_anti")
            # Files of a batch follow its rows by day and partition, not its tasks.
            new = new.hint("rebalance", "day", partition)
            new.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day", partition).parquet(f"{out}/batch={batch_id}")
        finally:
            fresh.unpersist()
        if then is not None and days:
            then(spark.read.schema(columns).parquet(f"{out}/batch={batch_id}").drop("day"), batch_id)

    return _start(src, checkpoint, "append", write, once)


def read_ingested(spark: SparkSession, out: str, bare: bool = True) -> DataFrame:
    tape = spark.read.parquet(out)
    return tape.drop("batch", "day") if bare else tape


def bar_writer(spark: SparkSession, out: str, width_s: int = 60, ts: str = "created_at", late_s: int = 3600) -> Callable[[DataFrame, int], None]:
    """Bars that lose no late row (L2), as the ``then`` of ``stream_ingest``.

    Each batch writes partial bars: rows of its time under ``bars``, and rows older than the newest trade of all batches
    before it less ``late_s``, which a watermark would drop, under ``late``, the correction table. Partial bars
    combine map-side, so a hot market costs a row per task and bar. A batch owns its folders and looks at earlier ones
    only, so a retried batch writes the same files. ``read_bars`` merges both tables.
    """

    def write(new: DataFrame, batch_id: int) -> None:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/marks")
        seen = None
        if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            seen = spark.read.parquet(f"{out}/marks").where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        at = F.unix_seconds(ts)
        late = F.lit(False) if seen is None else at < F.lit(seen - late_s)
        start = F.floor(at / width_s) * width_s
        bars = new.groupBy("ticker", start.alias("bar_ts"), late.alias("late")).agg(
            F.max_by(F.struct("yes_price_usd", F.col(ts).alias("last_at"), F.col("trade_id").alias("last_id")), F.struct(ts, "trade_id")).alias("last"),
            F.sum(F.round(F.col("count_contracts") * 10000).cast("long")).alias("units"),
            F.count(F.lit(1)).alias("n_trades"),
        )
        held = bars.persist()
        try:
            for name, side in (("bars", ~F.col("late")), ("late", F.col("late"))):
                held.where(side).drop("late").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/{name}/batch={batch_id}")
        finally:
            held.unpersist()
        newest = new.agg(F.unix_seconds(F.max(ts)).alias("newest"))
        newest.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/marks/batch={batch_id}")

    return write


def read_bars(spark: SparkSession, out: str, corrections: bool = True) -> DataFrame:
    """ticker, bar_ts, price, contracts, n_trades, n_late: every trade in its bar, however late it came. Without
    ``corrections`` the bars as a watermark would have left them."""
    parts = spark.read.parquet(f"{out}/bars").withColumn("n_late", F.lit(0).cast("long"))
    if corrections:
        parts = parts.unionByName(spark.read.parquet(f"{out}/late").withColumn("n_late", F.col("n_trades")))
    last = F.max_by("last.yes_price_usd", F.struct("last.last_at", "last.last_id"))
    return parts.groupBy("ticker", "bar_ts").agg(
        last.alias("price"), (F.sum("units") / 10000).alias("contracts"), F.sum("n_trades").alias("n_trades"), F.sum("n_late").alias("n_late")
    )


def live_bars(stream: DataFrame, width: str = "1 minute", ts: str = "created_at", watermark: str | None = LATE) -> DataFrame:
    """Bars per market; a late row inside the watermark updates its bar (L2).

    Pass ``watermark=None`` for a stream that carries one, for example after de-duplication.
    Partial sums combine before the shuffle, so a hot market costs a row per task and bar.
    """
    w = F.window(ts, width)
    marked = stream if watermark is None else stream.withWatermark(ts, watermark)
    g = marked.groupBy(w.alias("w"), "ticker")
    bars = g.agg(
        F.max_by("yes_price_usd", F.struct(ts, "trade_id")).alias("price"),
        F.sum("count_contracts").alias("contracts"),
        F.count(F.lit(1)).alias("n_trades"),
    )
    return bars.select("ticker", F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "price", "contracts", "n_trades", "w")


def run_updates(df: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write every batch of an update-mode stream to its own directory."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/b-{batch_id:08d}")

    return _start(df, checkpoint, "update", write, once)


def read_updates(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Current value per key: the row of its latest batch."""
    return T.latest(spark.read.parquet(f"{out}/b-*"), keys, ["batch"]).drop("batch")


def settlement_watch(status: DataFrame, terminal: Sequence[str] = TERMINAL) -> DataFrame:
    """Each market once, when it first reaches a terminal status (L3).

    ``status``: ticker, status. State is one key per settled market.
    """
    return status.where(F.col("status").isin(*terminal)).select("ticker").dropDuplicates(["ticker"])


def on_settlement(watch: DataFrame, checkpoint: str, refresh: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Call ``refresh(newly settled tickers, batch id)`` for each batch that has any (L3)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        # The batch is read twice; keep it so that its state is not computed again.
        held = batch.persist()
        try:
            if not held.isEmpty():
                refresh(held, batch_id)
        finally:
            held.unpersist()

    return _start(watch, checkpoint, "append", each, once)


def closed_bars(stream: DataFrame, width: str = "1 minute", ts: str = "created_at", watermark: str = LATE) -> DataFrame:
    """Bars emitted once, when the watermark has passed their end; the feed of L4. ``w`` carries the event time on."""
    return live_bars(stream, width, ts, watermark).select("ticker", "bar_start", "price", "w")


class _Alerts(StatefulProcessor):
    """State of a market: its last bar and its last alert, and a timer that drops them once the market is idle."""

    def __init__(self, floor: float, sep_s: float, idle_s: float, width_s: float):
        self.floor, self.sep_s, self.idle_s, self.width_s = floor, sep_s, idle_s, width_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", "price double, at double, timer long")
        self.alert = handle.getValueState("alert", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - named by the interface
        price, before, timer = self.bar.get() if self.bar.exists() else (None, None, None)
        last = self.alert.get()[0] if self.alert.exists() else None
        bars = pd.concat(list(rows)).sort_values("bar_start")
        out = []
        for start, p in zip(bars["bar_start"], bars["price"]):
            at = start.timestamp()
            known = price is not None and at - before <= self.idle_s
            move = round(p - price, 9) if known else None
            if move is not None and abs(move) >= self.floor and (last is None or at - last >= self.sep_s):
                out.append((key[0], start, move, p))
                last = at
            price, before = p, at
        if timer is not None:
            self.handle.deleteTimer(timer)
        # The watermark runs ahead of the next bar's start by up to a bar.
        timer = int(1000 * (before + self.idle_s + self.sep_s + self.width_s))
        self.handle.registerTimer(timer)
        self.bar.update((price, before, timer))
        if last is not None:
            self.alert.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["ticker", "alert_ts", "move", "price"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.bar.clear()
        self.alert.clear()
        yield from ()

    def close(self) -> None:
        pass


def repricing_alerts(trades: DataFrame, floor: float = 0.08, sep_s: float = 240.0, idle_s: float = 86_400.0, width: str = "1 minute", ts: str = "created_at", watermark: str = LATE) -> DataFrame:
    """Moves of at least ``floor`` between consecutive bars, ``sep_s`` apart at least (L4): ticker, alert_ts, move, price.

    One query from trades to alerts. Bars close when the watermark passes their end, so any market's trades close a
    quiet one's last bar; they combine map-side, so the state sees one row per market and bar. A bar that starts
    more than ``idle_s`` after the one before has no move; an event-time timer drops an idle market's state, so state
    holds active markets only. Rows whose bar has closed change no alert. The state store must keep timers
    (``with_timers``).
    """
    bars = closed_bars(trades, width, ts, watermark)
    schema = f"ticker {trades.schema['ticker'].dataType.simpleString()}, alert_ts timestamp, move double, price double"
    return bars.groupBy("ticker").transformWithStateInPandas(_Alerts(floor, sep_s, idle_s, pd.Timedelta(width).total_seconds()), schema, "Append", "EventTime")


def with_timers(spark: SparkSession) -> SparkSession:
    """Set the state store that keeps timers for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def run_append(df: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append-mode stream to Parquet, one directory per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/b-{batch_id:08d}")

    return _start(df, checkpoint, "append", write, once)
