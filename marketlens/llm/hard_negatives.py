"""Hard negatives from Hilbert-ordered candidate blocks with zone maps.

Rows are ordered by label and by a Hilbert curve through their vectors and written to the shared folder as Parquet: a
row of that table is a block of at most ``BLOCK_ROWS`` candidates, packed, with the least and the largest value of
every dimension (its zone map) beside it. Anchors are packed in the same order, ``CHUNK_ROWS`` at most in a chunk.

For an anchor and a block, interval arithmetic over the zone map bounds every inner product from both sides. An anchor
reads a block for its positives only if the upper bound reaches the fifth best score that its own block gave, and for
its negatives only if the bounds meet one of the windows that its positives open. Both tests are exact, so no row is
lost however little they prune. Chunks meet zone maps, and then blocks, in equi-joins; scores are integer matrix
products within tasks, of which only each window's best few rows leave.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.llm import vectors
from marketlens.session import cut, shared_folder

#: Candidates of a block, anchors of a chunk, and zone maps that a chunk meets at a time.
BLOCK_ROWS, CHUNK_ROWS, ZONES = 1024, 256, 512
#: Bits of the curve for each dimension; the cuts are at the mean and this many deviations from it.
CURVE_BITS, CUTS = 2, (-0.6745, 0.0, 0.6745)
#: Blocks, chunks or requests of an Arrow batch.
BATCH_ROWS = 32
_LOW = -(1 << 63) + 1

BLOCK = "block long, n int, label_lo long, label_hi long, lo binary, hi binary, ids binary, labels binary, marks binary, vecs binary"
CHUNK = "chunk long, n int, block binary, pos binary, ids binary, labels binary, vecs binary, floor binary"


def hilbert(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``bits``-bit coordinates, as bytes in order of the curve.

    Skilling's transform, on whole columns: undo the reflections and exchanges of each level from the top, then
    Gray-encode and interleave, first dimension first.
    """
    x = levels.astype(np.uint8).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint8(q - 1)
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low).astype(np.uint8)
            x[0] ^= np.where(on, low, swap).astype(np.uint8)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint8)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0).astype(np.uint8)
        q >>= 1
    x ^= flip
    planes = [(x >> k) & 1 for k in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T, axis=1)


def mine(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: tuple[int, int] = (4, 5),
) -> DataFrame:
    """For each anchor and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of
    other labels that score at most the positive's score and at least ``low`` of it, a quotient.

    Components become ``floor(scale * component)``; a score is the integer inner product, higher first, ties by smaller
    id. Rows with a null id, label or vector, with a null or non-finite component or with another length than the most
    frequent one take no part. Ids and labels are integers. Repeated rows are rows of their own: an anchor's copy is one of its other rows. Where a positive scores
    below 0 its window is empty. Scores beyond a long saturate. Other columns of ``df`` play no part.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    d, blocks = write_blocks(df, is_anchor, id_col, vec_col, label_col, scale)
    if d == 0:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    with few_rows_a_batch(df):
        chunks = cut(chunked(blocks, d, positives))
        best = search(chunks, blocks, d, positives, None)
        first = W.partitionBy("chunk", "at").orderBy(F.desc("score"), "id", "block", "pos")
        best = best.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives)
        per = best.groupBy("chunk").agg(F.collect_list(F.struct("at", "nth", "score", "id")).alias("found"))  # CHUNK_ROWS * positives at most
        windows = cut(chunks.join(per, "chunk"))
        hits = cut(search(windows, blocks, d, negatives, low))
    within = W.partitionBy("chunk", "at", "nth").orderBy(F.desc("score"), "id", "block", "pos")
    ranked = hits.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def write_blocks(df: DataFrame, is_anchor: Column, id_col: str, vec_col: str, label_col: str, scale: int) -> tuple[int, DataFrame]:
    """Dimension, and the written table of blocks. Bounded ranges of (label, curve, id) are ordered each in its task,
    so that neither a label nor a group of equal vectors is one task."""
    spark = df.sparkSession
    rows = df.where(vectors.valid(F.col(vec_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("mark"), vectors.scaled(F.col(vec_col), scale).alias("q")
    )
    d = vectors.dimension(rows, "q")
    if d == 0:
        return 0, rows
    rows = rows.where(F.size("q") == d)
    n, mean, spread, most = moments(rows, d)
    wide = np.argsort(-spread, kind="stable")  # the curve turns first through the dimensions that spread most
    kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
    cuts = [(mean + c * spread)[wide] for c in CUTS]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = vectors.matrix(b.column(3), d)
            levels = sum((q[:, wide] > c).astype(np.uint8) for c in cuts)
            keys = pa.array([k.tobytes() for k in hilbert(levels, CURVE_BITS)], pa.binary())
            packed = pa.array([r.tobytes() for r in q.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], packed, keys], ["id", "label", "mark", "q", "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, made = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            while len(b):
                part = b.slice(0, BLOCK_ROWS - count)
                held, count, b = [*held, part], count + len(part), b.slice(len(part))
                if count == BLOCK_ROWS:
                    yield block(made, held)
                    held, count, made = [], 0, made + 1
        if held:
            yield block(made, held)

    def block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids = np.asarray(t["id"])
        by = np.argsort(ids, kind="stable")  # so that of equal scores the first in the block goes first
        labels, marks = np.asarray(t["label"])[by], np.asarray(t["mark"])[by].astype(np.uint8)
        q = np.frombuffer(b"".join(t["q"].to_pylist()), kind).reshape(-1, d)[by]
        row = {
            "block": number,
            "n": len(ids),
            "label_lo": int(labels.min()),
            "label_hi": int(labels.max()),
            "lo": q.min(axis=0).astype(np.int64).tobytes(),
            "hi": q.max(axis=0).astype(np.int64).tobytes(),
            "ids": ids[by].tobytes(),
            "labels": labels.tobytes(),
            "marks": marks.tobytes(),
            "vecs": q.tobytes(),
        }
        return _batch([row], BLOCK)

    parts = max(1, n // (8 * BLOCK_ROWS))
    placed = rows.mapInArrow(place, "id long, label long, mark boolean, q binary, key binary")
    ordered = placed.repartitionByRange(parts, "label", "key", "id").sortWithinPartitions("label", "key", "id")
    path = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
    ordered.mapInArrow(pack, BLOCK).write.parquet(path)
    return d, spark.read.schema(BLOCK).parquet(path)


def moments(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray, int]:
    """Rows, mean and deviation of each dimension, and the largest size of a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, s2, top = 0, np.zeros(d), np.zeros(d), np.zeros(d, np.int64)
        for b in batches:
            q = vectors.matrix(b.column(0), d)
            x = q.astype(np.float64)
            n, s, s2, top = n + len(q), s + x.sum(axis=0), s2 + (x * x).sum(axis=0), np.maximum(top, np.abs(q).max(axis=0, initial=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s), pa.array(s2), pa.array(top)], ["i", "n", "s", "s2", "top"])

    parts = rows.select("q").mapInArrow(run, "i int, n long, s double, s2 double, top long")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.max("top").alias("top")).orderBy("i").collect()  # d rows
    n = got[0]["n"]
    s, s2 = np.array([r["s"] for r in got]), np.array([r["s2"] for r in got])
    return n, s / n, np.sqrt(np.maximum(s2 / n - (s / n) ** 2, 0)), max(r["top"] for r in got)


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kinds[k]) for name, k in fields], [name for name, _ in fields])


def _longs(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int64)


def _vectors(b: bytes, d: int, n: int) -> np.ndarray:
    return np.frombuffer(b, {2: np.int16, 4: np.int32, 8: np.int64}[len(b) // (d * n)]).reshape(n, d) if n else np.empty((0, d), np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as longs, saturated."""
    s = vectors.product(a, b.T)
    return np.clip(s, _LOW + 1, (1 << 63) - 1).astype(np.int64) if s.dtype == object else s


def chunked(blocks: DataFrame, d: int, positives: int) -> DataFrame:
    """Anchors in chunks, in order of the blocks, each with the score that its own block's rows let its last positive reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, count = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for r in b.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["marks"], np.uint8))
                if not len(at):
                    continue
                ids, labels, q = _longs(r["ids"]), _longs(r["labels"]), _vectors(r["vecs"], d, r["n"])
                for k in range(0, len(at), CHUNK_ROWS):
                    some = at[k : k + CHUNK_ROWS]
                    s = np.where(labels[some][:, None] == labels[None, :], scores(q[some], q), _LOW)
                    s[np.arange(len(some)), some] = _LOW
                    floor = np.partition(s, -positives, axis=1)[:, -positives] if r["n"] >= positives else np.full(len(some), _LOW)
                    held.append((np.full(len(some), r["block"]), some, ids[some], labels[some], q[some], floor))
                    count += len(some)
                    if count >= CHUNK_ROWS:
                        yield chunk(made, held)
                        made, held, count = made + 1, [], 0
        if held:
            yield chunk(made, held)

    def chunk(number: int, held: list[tuple]) -> pa.RecordBatch:
        block, pos, ids, labels, q, floor = (np.concatenate(x) for x in zip(*held, strict=True))
        row = {"chunk": number, "n": len(ids), "block": block.astype(np.int64).tobytes(), "pos": pos.astype(np.int64).tobytes(), "ids": ids.tobytes(), "labels": labels.tobytes()}
        return _batch([{**row, "vecs": q.tobytes(), "floor": floor.astype(np.int64).tobytes()}], CHUNK)

    return blocks.select("block", "n", "ids", "labels", "marks", "vecs").mapInArrow(run, CHUNK)


@contextmanager
def few_rows_a_batch(df: DataFrame):
    """Arrow batches of few rows while packed rows travel: a task holds ``BATCH_ROWS`` of them at a time."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        conf.set(name, before)


def search(chunks: DataFrame, blocks: DataFrame, d: int, most: int, low: tuple[int, int] | None) -> DataFrame:
    """The best rows of each chunk's anchors: without ``low`` those of the anchor's label, at most ``most`` a block; with
    it, for every positive in ``found``, those of other labels in its window. One more step keeps the best of all blocks."""
    windows = low is not None
    zones = blocks.select("block", "label_lo", "label_hi", "lo", "hi")
    groups = max(1, chunks.count())

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                held.append(r)
                if len(held) == ZONES:
                    yield zone(held)
                    held = []
        if held:
            yield zone(held)

    def zone(held: list[dict]) -> pa.RecordBatch:
        longs = lambda name: np.array([r[name] for r in held], np.int64).tobytes()
        row = {name: longs(name) for name in ("block", "label_lo", "label_hi")}
        return _batch([{"n": len(held), **row, "lo": b"".join(r["lo"] for r in held), "hi": b"".join(r["hi"] for r in held)}], ZONE)

    def spans(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per anchor and positive: anchor, number, id, lowest and highest score of the window; ascending by anchor and number."""
        f = sorted(((x["at"], x["nth"], x["id"], x["score"]) for x in r["found"]), key=lambda x: x[:2])
        at, nth, ids, top = (np.array(c, np.int64) for c in zip(*f, strict=True))
        # ceil(low * top) without a product: top - floor((1 - low) * top).
        num, den = low
        rest = top // den * (den - num) + top % den * (den - num) // den
        bottom = np.where(top >= 0, top - rest, top + 1)
        return at, nth, ids, bottom, top

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which anchors of a chunk must read which block."""
        for b in batches:
            for r in b.to_pylist():
                n, z = r["n"], r["z_n"]
                a, labels = _vectors(r["vecs"], d, n).astype(np.int64), _longs(r["labels"])
                lo, hi = (_longs(r[k]).reshape(z, d) for k in ("z_lo", "z_hi"))
                first, last, number = _longs(r["z_label_lo"]), _longs(r["z_label_hi"]), _longs(r["z_block"])
                up, down = np.maximum(a, 0), np.minimum(a, 0)
                upper = _sum(vectors.product(up, hi.T), vectors.product(down, lo.T))
                if windows:
                    lower = _sum(vectors.product(up, lo.T), vectors.product(down, hi.T))
                    own = spans(r)
                    at, _, _, bottom, top = own
                    meets = (upper[at] >= bottom[:, None]) & (lower[at] <= top[:, None]) & (bottom <= top)[:, None]
                    first_of = np.flatnonzero(np.diff(at, prepend=-1))
                    use = np.zeros((n, z), bool)
                    use[at[first_of]] = np.logical_or.reduceat(meets, first_of, axis=0)
                    use &= (first != last)[None, :] | (labels[:, None] != first[None, :])
                else:
                    own = None
                    use = (upper >= _longs(r["floor"])[:, None]) & (first[None, :] <= labels[:, None]) & (labels[:, None] <= last[None, :])
                for k in np.flatnonzero(use.any(axis=0)):
                    who = np.flatnonzero(use[:, k])
                    yield request(r, int(number[k]), who, own)

    def request(r: dict, block: int, who: np.ndarray, own: tuple | None) -> pa.RecordBatch:
        row = {"to": block, "chunk": r["chunk"], "n": len(who), "at": who.astype(np.int64).tobytes()}
        for name in ("block", "pos", "ids", "labels"):
            row[name] = _longs(r[name])[who].tobytes()
        row["vecs"] = _vectors(r["vecs"], d, r["n"])[who].tobytes()
        got = [np.empty(0, np.int64)] * 5
        if own is not None:
            keep = np.isin(own[0], who) & (own[3] <= own[4])
            got = [x[keep] for x in own]
            got[0] = np.searchsorted(who, got[0])
        else:
            got[3] = _longs(r["floor"])[who]
        for name, x in zip(("w_at", "w_nth", "w_id", "w_low", "w_high"), got, strict=True):
            row[name] = x.tobytes()
        return _batch([row], REQUEST)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield found(r)

    def found(r: dict) -> pa.RecordBatch:
        n, m = r["n"], r["b_n"]
        s = scores(_vectors(r["vecs"], d, n), _vectors(r["b_vecs"], d, m))
        same = _longs(r["labels"])[:, None] == _longs(r["b_labels"])[None, :]
        low_, high = _longs(r["w_low"]), _longs(r["w_high"])
        if windows:
            at = _longs(r["w_at"])
            least, top = np.full(n, (1 << 63) - 1), np.full(n, _LOW)
            np.minimum.at(least, at, low_)
            np.maximum.at(top, at, high)
            use = ~same & (s >= least[:, None]) & (s <= top[:, None])
        else:
            at, high = np.arange(n), np.full(n, (1 << 63) - 1)
            own = (_longs(r["block"]) == r["to"])[:, None] & (_longs(r["pos"])[:, None] == np.arange(m)[None, :])
            use = same & ~own & (s >= low_[:, None])
        i, j = np.nonzero(use)
        by = np.lexsort((j, -s[i, j], i))  # ids ascend within a block
        i, j = i[by], j[by]
        v = s[i, j]
        begin = np.searchsorted(i, np.arange(n + 1))
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.flatnonzero(begin[at + 1] > begin[at]):  # of the windows of this request, anchors times positives at most
            run = slice(begin[at[w]], begin[at[w] + 1])
            falls = -v[run]
            start = int(np.searchsorted(falls, -high[w]))
            end = min(int(np.searchsorted(falls, -low_[w], side="right")), start + most)
            if end > start:
                rows.append((np.full(end - start, w), begin[at[w]] + np.arange(start, end)))
        w, k = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 2
        whom = at[w]
        cols = {
            "chunk": np.full(len(w), r["chunk"]),
            "at": _longs(r["at"])[whom],
            "nth": _longs(r["w_nth"])[w] if windows else np.zeros(len(w), np.int64),
            "anchor_id": _longs(r["ids"])[whom],
            "positive_id": _longs(r["w_id"])[w] if windows else np.zeros(len(w), np.int64),
            "positive_score": high[w],
            "score": v[k],
            "id": _longs(r["b_ids"])[j[k]],
            "block": np.full(len(w), r["to"]),
            "pos": j[k],
        }
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols.values()], list(cols))

    packs = zones.mapInArrow(maps, ZONE).select(*[F.col(c).alias(f"z_{c}") for c in ("n", "block", "label_lo", "label_hi", "lo", "hi")])
    # Every chunk of the query set meets every pack of zone maps, through a key that says which chunks.
    dealt = packs.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = chunks.withColumn("g", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))
    requests = asked.join(dealt, "g").drop("g").mapInArrow(choose, REQUEST)
    held = blocks.select(F.col("block").alias("to"), *[F.col(c).alias(f"b_{c}") for c in ("n", "ids", "labels", "vecs")])
    columns = "chunk long, at long, nth long, anchor_id long, positive_id long, positive_score long, score long, id long, block long, pos long"
    return requests.join(held, "to").mapInArrow(read, columns)


ZONE = "n int, block binary, label_lo binary, label_hi binary, lo binary, hi binary"
REQUEST = "to long, chunk long, n int, at binary, block binary, pos binary, ids binary, labels binary, vecs binary, w_at binary, w_nth binary, w_id binary, w_low binary, w_high binary"


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = a.astype(object) + b.astype(object) if object in (a.dtype, b.dtype) else a + b
    return np.clip(s, _LOW + 1, (1 << 63) - 1).astype(np.int64) if s.dtype == object else s
