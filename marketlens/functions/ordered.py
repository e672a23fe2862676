"""Ordered (running) computations that survive a hot key.

``Window.partitionBy(key).orderBy(ts)`` puts every row of a key into one task. When one key can
hold a third of the tape that task never ends. Each function here splits a key into *chunks* of
its order column (by default an hour of event time), runs the window inside ``(key, chunk)`` and
adds what the earlier chunks of the key leave behind, taken from a summary with one row per
``(key, chunk)``:

    rows ──window(key, chunk)──┐
      └──groupBy(key, chunk)──window(key)──join(key, chunk)──> rows + carry

The rows shuffle once, on ``(key, chunk)``; the summary is combined map-side first and its
per-key window is bounded by the number of chunks in the time span, not by the rows.
Results equal the plain window exactly, whatever the chunk width.

``keys`` may be empty: the order is then global and the summary window has one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, NumericType, TimestampType

from marketlens.session import cut

HOUR = 3600
_CH = "__chunk"
_SUM = "__summary"
_CARRY = "__carry"


def time_chunk(ts: str, width: float = HOUR) -> Column:
    return F.floor(F.col(ts) / F.lit(width))


def value_chunk(x: str, per_e_fold: int = 256) -> Column:
    """Monotone chunk of a measure by its size: below 10,000 chunks a side up to 1e15."""
    v = F.col(x).cast("double")
    return F.signum(v) * F.floor(F.ln(F.lit(1.0) + F.abs(v)) * per_e_fold)


def _order(cols: Sequence[str]) -> list[Column]:
    return [F.col(c).asc() for c in cols]


def _tick(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def _plain(df: DataFrame, keys: Sequence[str], chunk: Column) -> tuple[DataFrame, list[str]]:
    """Rows with their chunk and with keys that are never null: filled copies and one column that says which were
    null. Grouping, window and join on plain equal columns share one exchange, which null-safe conditions would not."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    filled, nulls = {}, F.lit(0)
    for i, k in enumerate(keys):
        own = F.col(k)
        if isinstance(kinds[k], NumericType):
            full = F.coalesce(own, F.lit(0).cast(kinds[k]))
        elif isinstance(kinds[k], (BooleanType, DateType, TimestampType)):
            full = F.coalesce(own, F.lit({BooleanType: "false"}.get(type(kinds[k]), "1970-01-01")).cast(kinds[k]))
        else:
            full = F.coalesce(own.cast("string"), F.lit(""))
        filled[f"__k{i}"] = full
        nulls = nulls + F.when(own.isNull(), 1 << i).otherwise(0)
    rows = df.withColumn(_CH, chunk)
    if isinstance(rows.schema[_CH].dataType, (LongType, IntegerType)):  # the chunk of null times comes first
        filled[_CH] = F.coalesce(F.col(_CH).cast("long"), F.lit(-(1 << 63)))
    elif isinstance(rows.schema[_CH].dataType, DoubleType):
        filled[_CH] = F.coalesce(F.col(_CH), F.lit(float("-inf")))
    plain = [f"__k{i}" for i in range(len(keys))]
    if keys:
        filled["__kn"] = nulls
        plain.append("__kn")
    return rows.withColumns(filled) if filled else rows, plain


def _attach(rows: DataFrame, plain: Sequence[str], summary: Column, carry: Column) -> DataFrame:
    """Join to each row what the neighbouring chunks of its key hand over."""
    per_chunk = rows.groupBy(*plain, _CH).agg(summary.alias(_SUM))
    return rows.join(per_chunk.select(*plain, _CH, carry.alias(_CARRY)), [*plain, _CH], "left")


def _windows(plain: Sequence[str], order: Sequence[str]):
    inside = W.partitionBy(*[F.col(k) for k in plain], F.col(_CH)).orderBy(*_order(order))
    across = W.partitionBy(*[F.col(k) for k in plain]).orderBy(F.col(_CH))
    return inside, across


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    chunk: Column | None = None,
) -> DataFrame:
    """``sum(value)`` over all rows of the key up to and including the current one."""
    rows, plain = _plain(df, keys, time_chunk(order[0]) if chunk is None else chunk)
    rows = rows.withColumn("__v", value)
    inside, across = _windows(plain, order)
    carry = F.sum(_SUM).over(across.rowsBetween(W.unboundedPreceding, -1))
    joined = _attach(rows, plain, F.sum("__v"), carry)
    total = F.sum("__v").over(inside.rowsBetween(W.unboundedPreceding, 0))
    zero = F.lit(0)
    return joined.withColumn(out, F.coalesce(total, zero) + F.coalesce(F.col(_CARRY), zero)).drop(
        _CH, _CARRY, "__v", *plain
    )


def row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    chunk: Column | None = None,
) -> DataFrame:
    """1-based position inside the key."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, chunk)


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    chunk: Column | None = None,
    before: bool = False,
) -> DataFrame:
    """Running maximum; ``before=True`` leaves the current row out."""
    rows, plain = _plain(df, keys, time_chunk(order[0]) if chunk is None else chunk)
    rows = rows.withColumn("__v", value)
    inside, across = _windows(plain, order)
    carry = F.max(_SUM).over(across.rowsBetween(W.unboundedPreceding, -1))
    joined = _attach(rows, plain, F.max("__v"), carry)
    local = F.max("__v").over(inside.rowsBetween(W.unboundedPreceding, -1 if before else 0))
    return joined.withColumn(out, F.greatest(local, F.col(_CARRY))).drop(_CH, _CARRY, "__v", *plain)


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    chunk: Column | None = None,
) -> DataFrame:
    """Latest non-null ``value`` of the key at or before the current row (forward fill)."""
    rows, plain = _plain(df, keys, time_chunk(order[0]) if chunk is None else chunk)
    rows = rows.withColumn("__v", value)
    inside, across = _windows(plain, order)
    closing = F.max_by("__v", F.when(F.col("__v").isNotNull(), _tick(order)))
    carry = F.last(_SUM, ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1))
    joined = _attach(rows, plain, closing, carry)
    local = F.last("__v", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn(out, F.coalesce(local, F.col(_CARRY))).drop(_CH, _CARRY, "__v", *plain)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    chunk: Column | None = None,
) -> DataFrame:
    """``value`` of the row just before, null on the first row of the key."""
    return _neighbour(df, keys, order, value, out, chunk, forward=False)


def following(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    chunk: Column | None = None,
) -> DataFrame:
    """``value`` of the row just after, null on the last row of the key."""
    return _neighbour(df, keys, order, value, out, chunk, forward=True)


def _neighbour(df, keys, order, value, out, chunk, forward: bool) -> DataFrame:
    rows, plain = _plain(df, keys, time_chunk(order[0]) if chunk is None else chunk)
    # A one-field struct keeps "the neighbour's value is null" apart from "no neighbour here".
    rows = rows.withColumn("__v", F.struct(value.alias("v")))
    inside, across = _windows(plain, order)
    if forward:
        edge, carry, local = (
            F.min_by("__v", _tick(order)),
            F.lead(_SUM).over(across),
            F.lead("__v").over(inside),
        )
    else:
        edge, carry, local = (
            F.max_by("__v", _tick(order)),
            F.lag(_SUM).over(across),
            F.lag("__v").over(inside),
        )
    joined = _attach(rows, plain, edge, carry)
    return joined.withColumn(out, F.coalesce(local, F.col(_CARRY))["v"]).drop(_CH, _CARRY, "__v", *plain)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    outputs: dict[str, tuple[str, int, int]],
    block: int = 100_000,
) -> DataFrame:
    """Aggregates over bounded row frames, several at once.

    ``position`` is the 1-based row number of the key. Rows are cut into blocks of ``block``
    positions; the few rows next to a border are copied into the neighbouring block, so no task
    holds more than a block and its borders of a key. ``outputs`` maps a new column to
    ``(SQL aggregate, first, last)`` with the frame as row offsets, for example
    ``{"med": ("percentile(v, 0.5)", -2, 2)}``.
    """
    pos = F.col(position)
    back = max(0, *[-lo for _, lo, _ in outputs.values()])
    ahead = max(0, *[hi for _, _, hi in outputs.values()])
    first, last = F.floor((pos - ahead) / block), F.floor((pos + back) / block)
    copied = df.withColumn("__blk", F.explode(F.sequence(first, last)))
    w = W.partitionBy(*[F.col(k) for k in keys], F.col("__blk")).orderBy(pos.asc())
    for name, (agg, lo, hi) in outputs.items():
        copied = copied.withColumn(name, F.expr(agg).over(w.rowsBetween(lo, hi)))
    return copied.where(F.col("__blk") == F.floor(pos / block)).drop("__blk")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ps: Sequence[float],
    names: Sequence[str],
    weight: Column | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per key.

    Rows are counted per ``(key, value)`` first, combined map-side. A running count over the
    distinct values, in value chunks, then finds the two ranks around each quantile, so not even
    a key with very many distinct values is gathered in one task. ``weight`` counts a row more
    than once. The counts are written once and read by every later step, so the rows themselves are
    scanned a single time.
    """
    one = F.lit(1) if weight is None else weight
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__x")).agg(F.sum(one).alias("__c")))
    run = running_sum(counts, keys, ["__x"], F.col("__c"), "__upto", value_chunk("__x"))
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    ranked = run.join(totals, list(keys)) if keys else run.withColumn("__n", totals.scalar())
    aggs = []
    for p, name in zip(ps, names):
        rank = F.lit(float(p)) * (F.col("__n") - 1)
        at = lambda k: F.max(F.when((F.col("__upto") - F.col("__c") <= k) & (k < F.col("__upto")), F.col("__x")))
        aggs += [at(F.floor(rank)).alias(f"__lo_{name}"), at(F.ceil(rank)).alias(f"__hi_{name}"), F.max(rank - F.floor(rank)).alias(f"__w_{name}")]
    g = ranked.groupBy(*keys).agg(*aggs)
    out = []
    for name in names:
        lo, hi, w = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.col(f"__w_{name}")
        out.append(F.when(w == 0, lo).otherwise(lo + (hi - lo) * w).alias(name))
    return g.select(*keys, *out)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    before: str,
    after: str,
    chunk: Column | None = None,
) -> DataFrame:
    """``value`` of the row before and of the row after, in one pass."""
    rows, plain = _plain(df, keys, time_chunk(order[0]) if chunk is None else chunk)
    rows = rows.withColumn("__v", F.struct(value.alias("v")))
    inside, across = _windows(plain, order)
    ends = F.struct(F.min_by("__v", _tick(order)).alias("head"), F.max_by("__v", _tick(order)).alias("tail"))
    carry = F.struct(
        F.lag(F.col(_SUM)["tail"]).over(across).alias("p"), F.lead(F.col(_SUM)["head"]).over(across).alias("n")
    )
    joined = _attach(rows, plain, ends, carry)
    return (
        joined.withColumn(before, F.coalesce(F.lag("__v").over(inside), F.col(_CARRY)["p"])["v"])
        .withColumn(after, F.coalesce(F.lead("__v").over(inside), F.col(_CARRY)["n"])["v"])
        .drop(_CH, _CARRY, "__v", *plain)
    )


def known_around(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    before: str,
    after: str,
    chunk: Column | None = None,
) -> DataFrame:
    """Latest non-null ``value`` up to each row and the first one from it on, in one pass."""
    rows, plain = _plain(df, keys, time_chunk(order[0]) if chunk is None else chunk)
    rows = rows.withColumn("__v", value)
    inside, across = _windows(plain, order)
    at = F.when(F.col("__v").isNotNull(), _tick(order))
    ends = F.struct(F.min_by("__v", at).alias("head"), F.max_by("__v", at).alias("tail"))
    lo, hi = W.unboundedPreceding, W.unboundedFollowing
    carry = F.struct(
        F.last(F.col(_SUM)["tail"], ignorenulls=True).over(across.rowsBetween(lo, -1)).alias("p"),
        F.first(F.col(_SUM)["head"], ignorenulls=True).over(across.rowsBetween(1, hi)).alias("n"),
    )
    joined = _attach(rows, plain, ends, carry)
    back = F.last("__v", ignorenulls=True).over(inside.rowsBetween(lo, 0))
    forth = F.first("__v", ignorenulls=True).over(inside.rowsBetween(0, hi))
    return (
        joined.withColumn(before, F.coalesce(back, F.col(_CARRY)["p"]))
        .withColumn(after, F.coalesce(forth, F.col(_CARRY)["n"]))
        .drop(_CH, _CARRY, "__v", *plain)
    )
