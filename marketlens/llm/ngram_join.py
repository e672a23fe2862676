"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams (their hashes) is cut into fragments; a document's n-grams in one fragment are a segment.
Two sets that reach the threshold differ in at most D n-grams, D following from their sizes, so of more
than D fragments at least one segment is equal in both: documents are candidates if they share a segment. The number
of fragments follows from a size class, and a document joins its own class and the next, so every pair that can
link meets in one. Candidates are compared by fragment: partial overlaps are counted for each fragment apart
and summed for each pair.

Groups are not expanded into pairs. Sets are compared once per distinct set. Each segment's documents are first
compared with its smallest (of a task's or of all); what links forms components. Where a segment of more than ``LARGE``
documents still has several, they are compared with one of each of ``HUBS`` components other than their own, and components
are formed anew: in a group whose members link with some others each, next to all of it is one then. After that only pairs of different
components that share a segment are looked at. Before a pair is made its sketches (parities of 512 hash bins) must
differ in no more bins than the threshold allows differences, which never rejects a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.blocks import PARTS, Dealer, block_count, bucket_of, match, shuffle_partitions, tasks_for, unpack
from marketlens.llm.text import grams, hashes, lowered, mix
from marketlens.session import cut

SKETCH = 8  # words of 64 bits
#: Fragments in which candidates are compared, by the top bits of the hash.
PIECE_BITS = 3
#: Components of a segment that its other documents are compared with before the rest is paired.
HUBS = 8
#: Documents of a segment from which on this is done.
LARGE = 64
#: The largest number of ids that is sent to all tasks.
FEW = 200_000
#: Tasks that the copies of one text are dealt to.
SALTS = 16


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; fewer words are one shingle, none give none."""
    h = hashes(lowered(text))
    if 0 < len(h) < n:
        h = np.append(h, np.full(n - len(h), len(h), np.uint64))  # its own kind of shingle: padded with its length
        return grams(h, n)
    return np.unique(grams(h, n))


@lru_cache(maxsize=4)
def _classes(percent: int) -> np.ndarray:
    """Least sizes of the classes: a set and any partner no smaller are in the same class or in neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def segments(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the segments of a set, in its class and the next. Segments without n-grams count only if a set has
    no more filled ones than it may have differences."""
    return _segments(s, percent)[0]


def _segments(s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The keys, and how many of them any partner must share at least."""
    if not len(s):
        return np.empty(0, np.uint64), 1
    needed = len(s)
    least = _classes(percent)
    own = int(np.searchsorted(least, len(s), side="right")) - 1
    out = []
    for c in (own, own + 1):
        most = int(least[c + 1]) - 1
        differ = 2 * most * (100 - percent) // (100 + percent)
        n = 1 if differ == 0 else (5 * (differ + 1) + 3) // 4 + 1
        at = ((s >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        value, at = np.add.reduceat(mix(s), first), at[first]
        needed = min(needed, max(1, len(first) - differ))
        if len(first) <= differ:
            full = np.zeros(n, np.uint64)
            full[at] = value
            value, at = full, np.arange(n)
        out.append(mix(value + mix(at.astype(np.uint64) + np.uint64(c << 40))))
    return np.concatenate(out), needed


def sketch(s: np.ndarray) -> list[int]:
    odd = np.bincount((mix(s ^ np.uint64(0x5BD1E995)) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _emit(n: int, percent: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(blocks, plain=True)
        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if owner is None:
                    continue
                k = segments(shingles(text, n), percent)
                dealer.add(k, np.full(len(k), owner, np.int64), np.zeros(len(k), np.int32))
                if dealer.full():
                    yield from dealer.flush()
        yield from dealer.flush()

    return run


_SETS = "doc_id long, n_shingles long, print binary, set array<long>"


def _sets(n: int, percent: int):
    """Sizes of all documents of a bucket; prints of those that share enough segments with others to link with one,
    and their sets, once if a row repeats."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        owners, counts = unpack(found["owner"], np.int64), unpack(found["mark"], np.int32)
        ids, at = np.unique(owners, return_inverse=True)
        shared = dict(zip(ids.tolist(), np.bincount(at, counts, len(ids)).tolist(), strict=True))
        size, prints, sets, done = [], [], [], set()
        for owner, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
            s = shingles(text, n)
            size.append(len(s))
            is_candidate = owner in shared and shared[owner] >= _segments(s, percent)[1] and len(s) > 0
            prints.append(np.array([mix(s).sum(), mix(s ^ np.uint64(1)).sum(), len(s)], np.uint64).tobytes() if is_candidate else None)
            sets.append(s.view(np.int64) if is_candidate and owner not in done else None)
            if is_candidate:
                done.add(owner)
        return pa.Table.from_arrays(
            [docs["doc_id"], pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "print", "set"]
        )

    return run


def _emit_sets(percent: int, blocks: int):
    """The segments of the distinct sets (doc, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(blocks, keyed=True)
        for b in batches:
            for owner, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                k = segments(s.values.to_numpy().view(np.uint64), percent)
                dealer.add(k, np.full(len(k), owner, np.int64), k.view(np.int64))
                if dealer.full():
                    yield from dealer.flush()
        yield from dealer.flush()

    return run


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.array(s, np.int64).view(np.uint64) for s in b.column(1).to_pylist()]
        cols = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc", "n", "sk"])


def _may_link(percent: int):
    """Sizes and sketches allow at most D differences; exact, it never rejects a link."""
    apart = F.lit(0)
    for i in range(SKETCH):
        apart = apart + F.bit_count(F.col("x.sk")[i].bitwiseXOR(F.col("y.sk")[i]))
    both = F.col("x.n") + F.col("y.n")
    gap = F.abs(F.col("x.n") - F.col("y.n"))
    return F.greatest(apart, gap) * (100 + percent) <= both * (100 - percent)


def _sent(ids: DataFrame) -> DataFrame:
    """Few ids (or rows of two) go to where the sets are; many meet them in a shuffle."""
    n = ids.count()
    return F.broadcast(ids) if n <= FEW else ids.coalesce(tasks_for(n))


def _linked(pairs: DataFrame, pieces: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Of pairs (a, b, na, nb) those that reach the threshold: overlaps by fragment, summed by pair."""
    pairs = cut(pairs.coalesce(tasks))
    ends = cut(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct().coalesce(tasks))
    pieces = pieces.join(_sent(ends), "doc", "left_semi")
    left = pieces.select(F.col("doc").alias("a"), "piece", F.col("part").alias("pa"))
    right = pieces.select(F.col("doc").alias("b"), "piece", F.col("part").alias("pb"))
    partial = pairs.join(left, "a").join(right, ["b", "piece"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("o"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b").coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp) for every end of an edge (a, b): the smallest id in its component.

    Labels go along edges and then to the label of the label, so rounds grow with the logarithm of a
    component's length. Each round is written to the checkpoint folder, in as many files as the edges ask for: every
    task of a shuffle leaves files of its own, which for a few rows each would outweigh the rows."""
    edges = cut(edges)
    tasks = tasks_for(2 * edges.count())
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").coalesce(tasks)
    both = cut(both.distinct().coalesce(tasks))
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "doc").coalesce(tasks))
    while True:
        near = both.join(labels.withColumnRenamed("doc", "b"), "b").coalesce(tasks).groupBy("a").agg(F.min("comp").alias("least")).withColumnRenamed("a", "doc")
        step = labels.join(near, "doc").select("doc", F.least("comp", "least").alias("to"), F.col("comp").alias("old")).coalesce(tasks)
        top = labels.select(F.col("doc").alias("to"), F.col("comp").alias("up"))
        jumped = cut(step.join(top, "to", "left").select("doc", F.least(F.col("to"), F.coalesce("up", "to")).alias("comp"), "old").coalesce(tasks))
        if jumped.where("comp <> old").isEmpty():
            return jumped.select("doc", "comp")
        labels = jumped.select("doc", "comp")


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles and component_id, the smallest id that links reach.

    Documents link when 100 * intersection >= percent * union of their sets of distinct n-word shingles, A-Z
    lower-cased; a text of fewer words is one shingle. Null and empty texts have no shingle and link with
    nothing. Ids are integers; rows that repeat an id are one document and should repeat its text. A null id
    links with nothing and has a null component. Other columns are ignored.
    """
    blocks = block_count(docs, text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = match(narrow.mapInArrow(_emit(n, percent, blocks), PARTS), blocks, plain=True)
    dealt = narrow.withColumn("bucket", bucket_of(F.col("doc_id"), blocks))
    rows = cut(dealt.groupBy("bucket").cogroup(found.groupBy("block")).applyInArrow(_sets(n, percent), _SETS))
    candidates = rows.where("print IS NOT NULL").select("doc_id", "n_shingles", "print")
    classes = candidates.groupBy("print").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last")).where("doc < last")
    # Sets that several documents have, once for each salt: so copies of one text meet their class in several tasks.
    classes = cut(classes.select("print", "doc", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    classes = classes.coalesce(tasks_for(classes.count()))
    candidates = candidates.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = cut(candidates.join(classes, ["print", "salt"]).where("doc_id <> doc").select(F.col("doc_id").alias("doc")).distinct())
    sets = rows.where("set IS NOT NULL").select(F.col("doc_id").alias("doc"), "set").join(_sent(copies), "doc", "left_anti")
    parts = sets.mapInArrow(_emit_sets(percent, blocks), PARTS)
    keys = cut(match(parts, blocks, keyed=True))
    n_keys = keys.count()
    with shuffle_partitions(docs, n_keys):
        comp = _linked_components(sets, keys.coalesce(tasks_for(n_keys)), percent, tasks_for(n_keys))
    of_class = classes.join(comp, "doc", "left").select("print", "salt", F.coalesce("comp", "doc").alias("of_class"))
    known = candidates.join(of_class, ["print", "salt"], "left").join(comp.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    known = known.select("doc_id", "n_shingles", F.coalesce("of_class", "comp", "doc_id").alias("component_id"))
    alone = rows.where("print IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(alone)


def _linked_components(sets: DataFrame, keys: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(doc, comp) of the distinct sets (doc, set) that link with another, written; ``keys`` are their shared segments."""
    info = cut(sets.mapInArrow(_sketch_rows, "doc long, n long, sk array<long>")).coalesce(tasks)
    part = lambda p: F.filter("set", lambda h: F.shiftrightunsigned(h, 64 - PIECE_BITS) == p)
    numbers = F.sequence(F.lit(0), F.lit((1 << PIECE_BITS) - 1))
    pieces = sets.select("doc", F.explode(F.transform(numbers, lambda p: F.struct(p.alias("piece"), part(p).alias("part")))).alias("p"))
    pieces = pieces.select("doc", "p.piece", "p.part").where(F.size("part") > 0)
    x, y = info.alias("x"), info.alias("y")
    hubs = keys.where("hub <> doc").select("hub", "doc").distinct().coalesce(tasks).alias("k")
    ok = _may_link(percent)
    pair = [F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")]
    first = hubs.join(x, F.col("k.hub") == F.col("x.doc")).join(y, F.col("k.doc") == F.col("y.doc")).where(ok).select(*pair)
    edges = cut(_linked(first, pieces, percent, tasks))
    comp = components(edges)
    left = _mixed(keys, comp, info, tasks)
    large = left.where(F.col("m") > LARGE)
    reps = large.groupBy("key", "comp").agg(F.min("doc").alias("doc"))
    reps = reps.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("comp"), "comp"))).where(F.col("nth") <= HUBS)
    x, y = reps.select("key", "doc", F.col("comp").alias("of")).join(info, "doc").alias("x"), large.alias("y")
    some = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.of") != F.col("y.comp")) & ok).select(*pair).distinct()
    more = cut(_linked(some, pieces, percent, tasks))
    if not more.isEmpty():
        edges = cut(edges.unionByName(more))
        before = comp.withColumnRenamed("comp", "was")
        comp = components(edges)
        moved = cut(comp.join(before, "doc", "left").where("was IS NULL OR was <> comp").select("doc", F.col("comp").alias("now")))
        left = left.join(_sent(moved), "doc", "left").withColumn("comp", F.coalesce("now", "comp"))
    x, y = left.alias("x"), left.alias("y")
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & ok).select(*pair).distinct()
    more = cut(_linked(across, pieces, percent, tasks))
    if not more.isEmpty():
        comp = components(edges.unionByName(more))
    return comp


def _mixed(keys: DataFrame, comp: DataFrame, info: DataFrame, tasks: int) -> DataFrame:
    """(key, m, doc, comp, n, sk) of the segments that documents of several components share, m of them, written."""
    named = keys.select("key", "doc").join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc")).coalesce(tasks)
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("key", "m")
    return cut(named.join(mixed, "key").coalesce(tasks).join(info, "doc").select("key", "m", "doc", "comp", "n", "sk").coalesce(tasks))
