"""Data-quality rules and checks (Q01-Q19). A check returns its violations as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import ordered
from marketlens.operators import temporal as T


def dedupe_ms(q: DataFrame, keys: Sequence[str], ms: str = "created_ms", order: str = "quote_id") -> DataFrame:
    """One row per key and millisecond, the last one kept (Q01)."""
    return T.latest(q, [*keys, ms], [order])


def drop_bad_quotes(q: DataFrame, floor: float = 1.01) -> DataFrame:
    """Drop prices below the floor and rows whose overround is null or the zero sentinel (Q02)."""
    return q.where((F.col("price_decimal") >= floor) & F.col("overround").isNotNull() & (F.col("overround") != 0))


def fallback_raw(q: DataFrame, floor: float = 1.01) -> DataFrame:
    """Keep sentinel rows with their raw probability (Q03)."""
    kept = q.where(F.col("price_decimal") >= floor)
    return kept.withColumn("prob_use", F.when(F.col("overround") == 0, F.col("prob_raw")).otherwise(F.col("prob")))


#: Fixed thresholds of the three screens: jump in, second-jump rule, neighbour agreement, seconds.
GLITCH_PRESETS = {
    "reversion": {"jump": 0.10, "revert": 0.6, "after_s": 10.0},
    "isolated": {"jump": 0.15, "agree": 0.05, "both_s": 5.0},
    "level": {"jump": 0.35, "agree": 0.06},
}


def screen_glitches(
    q: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, preset: str = "reversion", **override: float
) -> DataFrame:
    """Mark single prints that jump away and straight back (Q04), as column ``is_glitch``.

    reversion: the next move has the other sign, undoes over 60% of the jump, and comes quickly.
    isolated: both moves are large and quick, and the neighbours agree closely.
    level: both moves are very large and the neighbours agree; no time test.
    """
    p = {**GLITCH_PRESETS[preset], **override}
    n = ordered.neighbours(q, keys, [ts, tie], F.struct(F.col(value).alias("x"), F.col(ts).cast("double").alias("t")), "__p", "__n")
    x = F.col(value)
    d1, d2 = F.round(x - F.col("__p.x"), 9), F.round(F.col("__n.x") - x, 9)
    dt1, dt2 = F.col(ts) - F.col("__p.t"), F.col("__n.t") - F.col(ts)
    if preset == "reversion":
        hit = (d1 * d2 < 0) & (F.abs(d1) > p["jump"]) & (F.abs(d2) > p["revert"] * F.abs(d1)) & (dt2 < p["after_s"])
    elif preset == "isolated":
        near = F.round(F.abs(F.col("__n.x") - F.col("__p.x")), 9) < p["agree"]
        hit = (dt1 <= p["both_s"]) & (dt2 <= p["both_s"]) & (F.abs(d1) > p["jump"]) & (F.abs(d2) > p["jump"]) & near
    else:
        near = F.round(F.abs(F.col("__n.x") - F.col("__p.x")), 9) <= p["agree"]
        hit = (F.abs(d1) > p["jump"]) & (F.abs(d2) > p["jump"]) & near
    return n.withColumn("is_glitch", F.coalesce(hit, F.lit(False))).drop("__p", "__n")


def zero_after(prices: DataFrame, elim: DataFrame, keys: Sequence[str], ts: str, elim_ts: str, value: str) -> DataFrame:
    """Zero a price from its key's elimination instant on (Q05)."""
    j = prices.join(elim.select(*keys, F.col(elim_ts).alias("__e")), list(keys), "left")
    return j.withColumn(value, F.when(F.col(ts) >= F.col("__e"), 0.0).otherwise(F.col(value))).drop("__e")


def reconcile(tape_totals: DataFrame, catalog: DataFrame, tol: float = 0.001) -> DataFrame:
    """Tape sum against the catalog's own volume per market (Q06).

    ``tape_totals``: ticker, dollars. ``catalog``: ticker, volume.
    """
    j = catalog.join(tape_totals, "ticker", "left").withColumn("tape", F.coalesce("dollars", F.lit(0.0)))
    err = F.abs(F.col("tape") - F.col("volume")) / F.greatest(F.abs(F.col("volume")), F.lit(1e-9))
    return j.select("ticker", "tape", F.col("volume").alias("catalog"), err.alias("rel_err")).withColumn("within", F.col("rel_err") <= tol)


def reconcile_summary(rec: DataFrame) -> DataFrame:
    return rec.agg(F.count(F.lit(1)).alias("n"), F.count_if("within").alias("n_within")).withColumn("share_within", F.col("n_within") / F.col("n"))


def settled_universe(m: DataFrame) -> DataFrame:
    """Finalized, yes/no result, in scope, traded, with a settlement time (Q07)."""
    return m.where(
        F.col("status").isin("finalized") & F.col("result").isin("yes", "no") & F.col("in_scope") & (F.col("n_trades") > 0) & F.col("settle_ts").isNotNull()
    )


def one_winner(legs: DataFrame, by: str = "match_id", expected: int = 3) -> DataFrame:
    """Matches without exactly one winning leg, with missing results or missing legs (Q08)."""
    g = legs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_legs"), F.count_if(F.col("result") == "yes").alias("n_yes"), F.count_if(F.col("result").isNull()).alias("n_missing")
    )
    return g.where((F.col("n_yes") != 1) | (F.col("n_missing") > 0) | (F.col("n_legs") != expected))


def columns_agree(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows checked and rows where two columns differ, nulls included (Q09)."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("n_violations"))


def terminal_ticks(prices: DataFrame, results: DataFrame, ts: str, tie: str, value: str, hi: float = 0.9, lo: float = 0.1) -> DataFrame:
    """Last print of a winner below ``hi`` or of a loser above ``lo`` (Q10)."""
    last = T.last_by(prices, ["ticker"], value, [ts, tie], "last_price").join(results, "ticker")
    bad = ((F.col("result") == "yes") & (F.col("last_price") < hi)) | ((F.col("result") == "no") & (F.col("last_price") > lo))
    return last.select("ticker", "result", "last_price", bad.alias("flagged"))


def second_collisions(q: DataFrame, keys: Sequence[str], ts: str = "created_ts") -> DataFrame:
    """Seconds that hold more than one print of a key (Q11)."""
    return q.groupBy(*keys, F.floor(ts).alias("second")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def result_mismatch(em: DataFrame) -> DataFrame:
    """Matches whose regulation winner is not the side that advanced (Q12)."""
    return em.where((F.col("regulation") != "TIE") & F.col("advance").isNotNull() & (F.col("regulation") != F.col("advance")))


def outcomes_per_market(q: DataFrame, market: Sequence[str], outcome: str, floor: float = 1.5) -> DataFrame:
    """Mean distinct outcomes per market and whether it clears the floor (Q13)."""
    per = q.select(*market, outcome).distinct().groupBy(*market).agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n_markets"), F.avg("k").alias("mean_outcomes")).withColumn("ok", F.col("mean_outcomes") >= floor)


def unmatched(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``a`` without a partner (Q14)."""
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def expectations(df: DataFrame, expected: DataFrame, keys: Sequence[str], value: str, tol: float = 0.0) -> DataFrame:
    """Spot values against an expectations table (Q15): ok, off or missing."""
    want = expected.withColumnRenamed(value, "expected")
    j = want.join(df.select(*keys, value), list(keys), "left")
    verdict = F.when(F.col(value).isNull(), "missing").when(F.abs(F.col(value) - F.col("expected")) <= tol, "ok").otherwise("off")
    return j.select(*keys, "expected", F.col(value).alias("actual"), verdict.alias("verdict"))


def table_checks(df: DataFrame, name: str, expected_rows: Column, ts: str, order: Sequence[str], index: DataFrame, index_key: str, budget: int, columns: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """Structural checks of an exported table, one row per check (Q16).

    Row count equals the manifest, columns are as declared, time never runs backwards in the
    stated order, every key resolves in its index, and the row count keeps to the budget.
    ``chunk`` is a monotone slice of the order, by default an hour of its first column.
    """
    back = ordered.previous(df, [], order, F.col(ts), "__p", chunk).agg(F.count_if(F.col(ts) < F.col("__p"))).scalar()
    lost = df.join(index.select(index_key).distinct(), index_key, "left_anti").agg(F.count(F.lit(1))).scalar()
    missing = len(set(columns) - set(df.columns))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    checks = [
        ("count_matches_manifest", F.abs(F.col("n") - expected_rows)),
        ("columns_present", F.lit(missing)),
        ("time_ascending", back),
        ("index_resolves", lost),
        ("within_budget", F.greatest(F.lit(0), F.col("n") - budget)),
    ]
    rows = F.array(*[F.struct(F.lit(c).alias("check"), v.cast("long").alias("n_violations")) for c, v in checks])
    return n.select(F.lit(name).alias("table_name"), F.explode(rows).alias("r")).select("table_name", "r.*")


def conserved(parts: Sequence[Column], whole: Column, df: DataFrame, scale: int = 10_000) -> DataFrame:
    """Parts add up to the whole, in integer units (Q17)."""
    unit = lambda c: F.round(c * scale).cast("long")
    total = sum((unit(p) for p in parts[1:]), unit(parts[0]))
    return df.select(total.alias("parts_units"), unit(whole).alias("whole_units")).withColumn("conserved", F.col("parts_units") == F.col("whole_units"))


def paths_present(docs: DataFrame, key: str, body: str, paths: Sequence[tuple[str, str]]) -> DataFrame:
    """Field presence of JSON documents by dotted path (Q18).

    ``paths`` holds ``(path, kind)`` with kind ``value``, ``list`` or ``rows:<field>``: a list
    whose first row carries that field. Verdicts: ok, missing, not_a_list, empty_list,
    missing_row_field, bad_json.
    """
    v = F.try_parse_json(body)
    parsed = docs.select(key, v.alias("v"))

    def verdict(path: str, kind: str) -> Column:
        at = F.try_variant_get("v", "$." + path, "variant")
        if kind == "value":
            test = F.when(at.isNull(), "missing").otherwise("ok")
        else:
            first = F.try_variant_get("v", f"$.{path}[0]", "variant")
            is_list = F.schema_of_variant(at).startswith("ARRAY")
            test = F.when(at.isNull(), "missing").when(~is_list, "not_a_list").when(first.isNull(), "empty_list")
            if kind.startswith("rows:"):
                field = F.try_variant_get("v", f"$.{path}[0].{kind[5:]}", "variant")
                test = test.when(field.isNull(), "missing_row_field")
            test = test.otherwise("ok")
        return F.when(F.col("v").isNull(), "bad_json").otherwise(test)

    rows = F.array(*[F.struct(F.lit(p).alias("path"), verdict(p, k).alias("verdict")) for p, k in paths])
    return parsed.select(key, F.explode(rows).alias("r")).select(key, "r.*")


#: Spelled-out numbers accepted in prose.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
    "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}


def reconcile_claims(docs: DataFrame, key: str, text: str, slots: Sequence[tuple[str, str, str]], facts: DataFrame) -> DataFrame:
    """Numbers claimed in prose against data (Q19).

    ``slots``: (slot, regex whose first group is the number, fact column). ``facts`` has one row
    per document key. The number may carry thousands separators, decimals, or be a word; it is
    compared at the precision the text shows. A pattern that never matches is ``missing_anchor``.
    """
    words = F.create_map(*[x for w, n in NUMBER_WORDS.items() for x in (F.lit(w), F.lit(float(n)))])
    joined = docs.select(key, text).join(facts, key, "left")
    found = F.array(
        *[
            F.struct(F.lit(s).alias("slot"), F.regexp_extract(text, rx, 1).alias("raw"), F.col(fact).cast("double").alias("data_value"))
            for s, rx, fact in slots
        ]
    )
    r = joined.select(key, F.explode(found).alias("r")).select(key, "r.*")
    plain = F.regexp_replace("raw", ",", "")
    number = F.coalesce(F.expr("try_cast(regexp_replace(raw, ',', '') AS DOUBLE)"), F.try_element_at(words, F.lower("raw")))
    places = F.length(F.regexp_extract(plain, r"\.([0-9]+)$", 1))
    scale = F.pow(F.lit(10.0), places)
    same = F.abs(number - F.floor(F.col("data_value") * scale + 0.5) / scale) < 1e-9
    verdict = (
        F.when(F.col("raw") == "", "missing_anchor")
        .when(number.isNull(), "unreadable")
        .when(F.col("data_value").isNull(), "missing_data")
        .when(same, "match")
        .otherwise("mismatch")
    )
    return r.select(key, "slot", F.when(F.col("raw") != "", number).alias("text_value"), "data_value", verdict.alias("verdict"))
