"""Mixing sources to target weights by weighted sampling without replacement.

Each document has the key ``-ln(u) / weight``: u is a hash of its id, weight its quality, so that taking
documents by ascending key draws them without replacement in proportion to quality. A source whose target
is e whole sizes and a rest takes every document e times, then by key each document that still fits the rest.
Within a source the order is cut into ranges of the key whose sums are added up first; only the range in
which the rest first runs out is put in order row by row, and after it only the few documents of each size that
the gap has room for, so no task holds a source. Ranges are steps of the key's logarithm, so that they hold alike shares
of a source whatever the scale of its weights.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.session import cut

#: Key ranges for each doubling of the key: none holds more than about a 4,000th of its source, and those of small keys
#: are empty but for a few.
RANGES = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (source, source_size): target per source.

    Sources by code point, null last, take the weights in turn and share ``share`` of all sizes. A target
    stops at ``most`` times its source's size; the excess is shared by weight among the others until none is
    above. Solved in one sorted pass: sources by size per weight reach their stop in that order, so the
    level is the first (and so the highest) at which the next source does not. One row per source, sorted whole: sources must be
    few enough for one task, which names are.
    """
    n = len(weights)
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    numbered = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % n + 1))
    every = W.partitionBy(F.lit(0))
    by_stop = W.partitionBy(F.lit(0)).orderBy((F.col("stop") / F.col("w")), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_stop.rowsBetween(W.unboundedPreceding, -1)
    return (
        numbered.withColumn("stop", F.col("source_size") * F.lit(float(most)))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("all_t", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("all_t") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("full", (F.col("level") * F.col("w") >= F.col("stop")))
        .withColumn("open_level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
        .select("source", "source_size", F.when(F.col("full"), F.col("stop")).otherwise(F.col("w") * F.col("open_level")).alias("target"))
    )


def mix(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, tie: str | None = None) -> DataFrame:
    """From (doc_id, source, size, weight): the same rows with the weight used, source_size, target and copies.

    ``copies`` is how often the mix takes the document whole: the complete epochs of its source, and one
    more if the fractional selection has it. That goes by key and takes each document that still fits what is
    left of the rest, so a long one that doesn't fit is passed over and later ones are taken. When none fits,
    the one document left out whose size comes nearest to the gap is taken too, if that brings the source nearer
    to its target; where closing the walk some documents earlier comes nearer still, it ends there.
    Null or non-positive weights count as the least weight 1e-6, null sizes as 0; null sources are one
    source. Equal keys go by id, then size; of rows equal in all that, those first by the column ``tie``, if one is named,
    are taken. Empty documents are taken with the epochs only. Reruns agree. Further columns stay, but those named as the
    results give way. ``sized`` is read several times: hand in a written table or a cheap plan.
    """
    own = [c for c in sized.columns if c not in ("doc_id", "source", "size", "weight", "source_size", "target", "copies")]
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-6))
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # a source that is never null
    keyed = (
        sized.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), weight.alias("weight"), *own)
        .withColumn("__s", named)
        .withColumn("__key", -F.log(u) / F.col("weight"))
        .withColumn("__range", F.floor(F.log2("__key") * RANGES).cast("int"))
    )
    sums = keyed.groupBy("__s", "source", "__range").agg(F.sum("size").alias("s"))
    running = W.partitionBy("__s").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = cut(sums.withColumn("before", F.coalesce(F.sum("s").over(running), F.lit(0))))
    plan = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, most).withColumn("__s", named)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    ranges = cut(sums.drop("source").join(plan.drop("source"), "__s"))
    rows = keyed.join(ranges, ["__s", "__range"])
    inside = F.col("before") + F.col("s") <= F.col("rest")
    edge = ~inside & (F.col("before") < F.col("rest"))
    in_range = W.partitionBy("__s", "__range").orderBy("__key", "doc_id", "size", *([tie] if tie else [])).rowsBetween(W.unboundedPreceding, 0)
    cols = ["doc_id", "source", "size", "weight", *own, "__s", "__key", "__range", "source_size", "target", "epochs", "rest"]
    edged = rows.where(edge).withColumn("upto", F.col("before") + F.sum("size").over(in_range)).select(*cols, (F.col("upto") <= F.col("rest")).alias("__taken"))
    chosen = cut(rows.where(~edge).select(*cols, inside.alias("__taken")).unionByName(edged))
    picks = fill(chosen)
    same = ["__s", "__key", "doc_id", "size"]
    c, k = chosen.alias("c"), picks.alias("k")
    same_row = (F.col("c.__s") == F.col("k.__s")) & (F.col("c.__key") == F.col("k.__key")) & F.col("c.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("c.size") == F.col("k.size")) & ~F.col("c.__taken")
    met = c.join(k, same_row, "left").select("c.*", "times")
    # Of rows that are equal throughout, as many as were picked.
    nth = F.row_number().over(W.partitionBy(*same).orderBy(*([tie] if tie else ["__key"])))
    hit = met.where("times IS NOT NULL").withColumn("__picked", nth <= F.col("times"))
    every = met.where("times IS NULL").withColumn("__picked", F.lit(False)).unionByName(hit)
    more_once = (F.col("__taken") & (F.col("size") > 0)) | F.col("__picked")
    return every.select("doc_id", "source", "size", "weight", *own, "source_size", "target", (F.col("epochs") + more_once.cast("long")).alias("copies"))


def fill(chosen: DataFrame) -> DataFrame:
    """What a walk by key through the rows not taken yet takes if it takes each that still fits, and the row that closes
    it: (__s, __key, doc_id, size, times), written.

    Only rows that could be taken are walked, counted per source, size and range: of one size at most gap / size fit,
    one more may close, and these are the first by key. So a walk sees about gap * ln(gap) rows and what else is in
    the last range of each size; the gap is less than one document, whatever the number of documents. It takes time in
    proportion to them, but for a search among the distinct sizes.
    """
    gaps = chosen.groupBy("__s").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("__taken"), F.col("size"))), F.lit(0))).alias("gap"))
    gaps = cut(gaps)
    fits = chosen.where(~F.col("__taken") & (F.col("size") > 0)).join(gaps, "__s").where(F.col("size") < 2 * F.col("gap"))
    running = W.partitionBy("__s", "size").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    counts = fits.groupBy("__s", "size", "__range").agg(F.count(F.lit(1)).alias("n"), F.first("gap").alias("gap"))
    near = counts.withColumn("n_before", F.coalesce(F.sum("n").over(running), F.lit(0))).where(F.col("n_before") * F.col("size") <= F.col("gap"))
    walk = fits.join(near.select("__s", "size", "__range"), ["__s", "size", "__range"], "left_semi")
    walk = walk.select("__s", "gap", F.col("__key").alias("key"), "doc_id", "size")
    kind = fits.schema["doc_id"].dataType.simpleString()
    picks = walk.groupBy("__s").applyInArrow(_walk, f"__s string, __key double, doc_id {kind}, size long, times long")
    return cut(picks)


def _walk(t: pa.Table) -> pa.Table:
    """One source's walk and its close."""
    t = t.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("size", "ascending")]) if t["doc_id"].null_count == 0 else _nulls_first(t)
    sizes = t["size"].to_pylist()
    gap = t["gap"][0].as_py()
    gaps, took = [gap], []
    for i, n in enumerate(sizes):
        if n <= gap:
            gap -= n
            took.append(i)
            gaps.append(gap)
    # Ends of the walk from its last document back: rows open by size, first by key; nearest size to the gap.
    distinct = sorted(set(sizes))
    open_: dict[int, list[int]] = {n: [] for n in distinct}
    gone = set(took)
    for i in range(len(sizes) - 1, -1, -1):
        if i not in gone:
            open_[sizes[i]].append(i)  # the first by key at the end
    best = None
    for j in range(len(took), -1, -1):
        if j < len(took):
            # Documents given back come before all that were passed over later, and among equals of one size a walk
            # takes the first, so this one is the first open one of its size.
            open_[sizes[took[j]]].append(took[j])
        g = gaps[j]
        at = bisect_left(distinct, g)
        up, down = at, at - 1
        while up < len(distinct) and not open_[distinct[up]]:
            up += 1
        while down >= 0 and not open_[distinct[down]]:
            down -= 1
        ends = [(abs(g - distinct[k]), open_[distinct[k]][-1]) for k in (down, up) if 0 <= k < len(distinct) and abs(g - distinct[k]) < g]
        off, i = min(ends, default=(g, None))
        if best is None or off < best[0]:
            best = (off, j, i)
    _, j, i = best
    picked = took[:j] + ([i] if i is not None else [])
    out = t.take(pa.array(picked, pa.int64()))
    same = out.select(["__s", "key", "doc_id", "size"]).group_by(["__s", "key", "doc_id", "size"]).aggregate([([], "count_all")])
    return pa.Table.from_arrays([same["__s"], same["key"], same["doc_id"], same["size"].cast(pa.int64()), same["count_all"]], ["__s", "__key", "doc_id", "size", "times"])


def _nulls_first(t: pa.Table) -> pa.Table:
    return t.append_column("none", pa.array(np.asarray(t["doc_id"].is_valid()))).sort_by([("key", "ascending"), ("none", "ascending"), ("doc_id", "ascending"), ("size", "ascending")]).drop_columns(["none"])
