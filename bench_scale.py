"""Grain population at the reference tape's size: 73M trades derived from the given events.

Usage: ``python bench_scale.py [copies] [hot]``. ``copies`` (default 730) repeats sf0.1's 100,000
events with shifted ids and times over 30,000 markets; ``hot`` puts a third of all rows into one
market. Prints one JSON line. The derived tape goes to a new temporary folder.
"""

from __future__ import annotations

import json
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from marketlens.operators import temporal as T
    from marketlens.operators import volume as V
    from marketlens.plans import views as v
    from marketlens.session import SETTINGS

    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 730
    hot = len(sys.argv) > 2
    b = SparkSession.builder.master("local[8]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", "64")
    for k, x in SETTINGS.items():
        b = b.config(k, x)
    spark = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rep = spark.range(copies).select(F.col("id").alias("rep")).repartition(32, "rep")
    small = v.tape(spark, "/root/testdata/sf0.1").select("trade_id", "ticker", "created_ts", "yes_price_usd", "count_contracts", "taker_side")
    ticker = F.col("ticker") + 1500 * (F.col("rep") % 20)
    if hot:
        ticker = F.when(F.col("rep") % 3 == 0, F.lit(0)).otherwise(ticker)
    tape = rep.join(F.broadcast(small)).select(
        (F.col("rep") * 100_000 + F.col("trade_id")).alias("trade_id"), ticker.cast("long").alias("ticker"), (F.col("created_ts") + F.col("rep") * 37).alias("created_ts"), "yes_price_usd", "count_contracts", "taker_side"
    )
    tape.write.parquet(f"{root}/tape")
    t = spark.read.parquet(f"{root}/tape")
    out: dict = {"metric": "scale_seconds", "hot_key": hot, "queries": {}}

    def clock(name: str, df) -> None:
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()  # every column is computed
        out["queries"][name] = {"sec": round(time.perf_counter() - t0, 1)}

    out["rows"] = t.count()
    clock("v05_market_totals", V.market_totals(t))
    clock("v27_grain_75k", V.grain_population(t, 75_000))
    clock("v27_grain_250k", V.grain_population(t, 250_000))
    targets = t.where("trade_id % 20 = 0").select("ticker", F.col("trade_id").alias("id"), (F.col("created_ts") + 30).alias("at"))
    clock("j07_asof", T.asof(targets, t, ["ticker"], "at", "created_ts", {"yes_price_usd": "p"}, "trade_id").where("p >= 0"))
    print(json.dumps(out))


if __name__ == "__main__":
    main()
