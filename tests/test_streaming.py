"""Streams replayed with overlap and late rows equal the batch result."""

from conftest import rows
from pyspark.sql import functions as F

from marketlens.streaming import live as L

SCHEMA = "trade_id long, ticker long, series_ticker long, created_at timestamp, yes_price_usd double, count_contracts double"


def _batches(spark, path):
    """Three files: each re-sends rows of the one before; some rows come up to 50 minutes late."""
    from datetime import datetime, timedelta, timezone

    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    all_rows = [(i, i % 3, i % 2, t0 + timedelta(minutes=i * 2 - (50 if i % 11 == 0 else 0)), (i * 37 % 100) / 100, 1.0 + i) for i in range(120)]
    for k in range(3):
        part = all_rows[max(0, k * 40 - 8) : (k + 1) * 40]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/in/f{k}")
    return all_rows


def _source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/f*")


def test_ingest_is_exactly_once(spark, tmp_path):
    want = _batches(spark, tmp_path)
    for _ in range(2):  # the second run finds nothing new
        L.stream_ingest(_source(spark, tmp_path), f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    got = L.read_ingested(spark, f"{tmp_path}/out")
    assert rows(got, "trade_id") == [(r[0],) for r in want]


def test_bars_equal_batch(spark, tmp_path):
    want = spark.createDataFrame(_batches(spark, tmp_path), SCHEMA)
    unique = _source(spark, tmp_path).withWatermark("created_at", L.LATE).dropDuplicatesWithinWatermark(["trade_id"])
    bars = L.live_bars(unique, "10 minutes", watermark=None).drop("w")
    # Bars after de-duplication run in append mode, so only closed ones come out.
    L.run_append(bars, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out/b-*"), "ticker", "bar_start", "contracts", "n_trades")
    batch = want.groupBy("ticker", F.window("created_at", "10 minutes").start.alias("bar_start")).agg(F.sum("count_contracts").alias("contracts"), F.count(F.lit(1)).alias("n_trades"))
    full = rows(batch, "ticker", "bar_start", "contracts", "n_trades")
    assert got and set(got) <= set(full) and len(got) >= len(full) - 3 * 8


def _alerts(spark, path, all_rows, **how):
    """Alerts of the stream with an end marker, and of a plain walk over the bars that hold every row in time."""
    L.with_timers(spark)
    far = all_rows[-1][3].replace(year=2030)
    spark.createDataFrame([(-1, None, 0, far, 0.5, 1.0)], SCHEMA).coalesce(1).write.parquet(f"{path}/in/f9")
    alerts = L.repricing_alerts(_source(spark, path), how["floor"], how["sep_s"], how["idle_s"], "10 minutes")
    L.run_append(alerts, f"{path}/alerts", f"{path}/c", once=True).awaitTermination()
    got = rows(spark.read.parquet(f"{path}/alerts/b-*"), "ticker", "alert_ts", "move")
    bars = {}
    for i, ticker, _, at, price, _ in all_rows:
        start = at.replace(minute=at.minute // 10 * 10, second=0, microsecond=0, tzinfo=None)
        bars[ticker, start] = max(bars.get((ticker, start), (at, -1, 0)), (at, i, price))
    want = []
    for k in {t for t, _ in bars}:
        prev = last = before = None
        for start in sorted(s for t, s in bars if t == k):
            p = bars[k, start][2]
            known = prev is not None and (start - before).total_seconds() <= how["idle_s"]
            if known and abs(round(p - prev, 9)) >= how["floor"] and (last is None or (start - last).total_seconds() >= how["sep_s"]):
                want.append((k, start, round(p - prev, 9)))
                last = start
            prev, before = p, start
    return got, sorted(want)


def test_alerts_against_walk(spark, tmp_path):
    """Rows come up to 50 minutes late, within the watermark; the marker closes the last bars."""
    got, want = _alerts(spark, tmp_path, _batches(spark, tmp_path), floor=0.2, sep_s=1800, idle_s=86_400)
    assert got == want and got


def test_alerts_forget_idle_markets(spark, tmp_path):
    got, want = _alerts(spark, tmp_path, _batches(spark, tmp_path), floor=0.01, sep_s=0, idle_s=700)
    longer, _ = _alerts(spark, tmp_path / "again", _batches(spark, tmp_path / "again"), floor=0.01, sep_s=0, idle_s=86_400)
    assert got == want and len(longer) > len(got) > 0


def test_bars_lose_no_late_row(spark, tmp_path):
    """Rows a day late go to the correction table, replays nowhere; a second run changes nothing."""
    from datetime import timedelta

    all_rows = _batches(spark, tmp_path)
    late = [(1000 + i, i % 3, i % 2, all_rows[i][3] - timedelta(days=1), 0.5, 2.0) for i in range(20)]
    spark.createDataFrame(late + all_rows[:5], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/f5")
    for _ in range(2):
        bars = L.bar_writer(spark, f"{tmp_path}/live", 600)
        L.stream_ingest(_source(spark, tmp_path), f"{tmp_path}/out", f"{tmp_path}/cp", once=True, then=bars).awaitTermination()
    cols = ("ticker", "bar_ts", "contracts", "n_trades")
    want = spark.createDataFrame(all_rows + late, SCHEMA).groupBy("ticker", (F.floor(F.unix_seconds("created_at") / 600) * 600).alias("bar_ts"))
    want = want.agg(F.sum("count_contracts").alias("contracts"), F.count(F.lit(1)).alias("n_trades"))
    got = L.read_bars(spark, f"{tmp_path}/live")
    assert rows(got, *cols) == rows(want, *cols)
    assert got.agg(F.sum("n_late")).first()[0] >= 20
    kept = L.read_bars(spark, f"{tmp_path}/live", corrections=False)
    assert kept.agg(F.sum("n_trades")).first()[0] == len(all_rows) + 20 - got.agg(F.sum("n_late")).first()[0]
    # A retried batch writes the same files.
    before = rows(got)
    again = spark.read.parquet(f"{tmp_path}/out").where("batch = 1").drop("batch", "day")
    L.bar_writer(spark, f"{tmp_path}/live", 600)(again, 1)
    assert rows(L.read_bars(spark, f"{tmp_path}/live")) == before


def test_bars_of_a_batch_without_new_rows(spark, tmp_path):
    """The last file sends earlier rows again and nothing else, so its batch has no day at all."""
    all_rows = _batches(spark, tmp_path)
    spark.createDataFrame(all_rows[:5], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/f5")
    bars = L.bar_writer(spark, f"{tmp_path}/live", 600)
    L.stream_ingest(_source(spark, tmp_path), f"{tmp_path}/out", f"{tmp_path}/cp", once=True, then=bars).awaitTermination()
    assert L.read_bars(spark, f"{tmp_path}/live").agg(F.sum("n_trades")).first()[0] == len(all_rows)


def test_settlement_watch_emits_once(spark, tmp_path):
    st = [(1, "active"), (1, "finalized"), (2, "closed"), (1, "settled"), (3, "active")]
    for i in range(3):
        spark.createDataFrame(st, "ticker long, status string").write.parquet(f"{tmp_path}/in/f{i}")
    seen = []
    src = spark.readStream.schema("ticker long, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/f*")
    L.on_settlement(L.settlement_watch(src), f"{tmp_path}/cp", lambda b, i: seen.extend(r[0] for r in b.collect()), once=True).awaitTermination()
    assert sorted(seen) == [1, 2]
