"""Substring dedup by relative Lempel-Ziv parsing against the indexed corpus.

Every window of 13 words has one seed: of its 7-word grams the one with the least hash, the leftmost of
equals. Equal windows have equal seeds at equal offsets, so documents that share a window share its seed,
and consecutive seeds of a document are at most 7 words apart, so they cover its words without a gap.
The seeds of all documents are indexed in blocks (``blocks``). Each document is then parsed greedily
from left to right: a factor goes on while the next seed comes from the same earlier document at the same
distance. A factor of 13 words or more is a duplicate span. A window that no factor contains, at a factor's
ends or where its seed pointed elsewhere, is checked by its own hash through a second set of blocks, so
the result is exact: a window counts if, and only if, a document with a smaller id has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.blocks import PARTS, PARTS_ARROW, Dealer, block_count, bucket_of, match, unpack
from marketlens.llm.text import grams, hashes, split

WINDOW = 13
SEED = 7
REACH = WINDOW - SEED + 1


def seeds(h: np.ndarray) -> np.ndarray:
    """For each window of a document's word hashes: the position of its seed."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    g = grams(h, SEED)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, REACH):
        less = g[j : j + n] < best
        best[less] = g[j : j + n][less]
        at[less] = j
    return at + np.arange(n)


def _emit_seeds(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(blocks)
        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = hashes(split(text))
                if owner is None or len(h) < WINDOW:
                    continue
                at = np.unique(seeds(h))
                dealer.add(grams(h, SEED)[at], np.full(len(at), owner, np.int64), at.astype(np.int32))
                if dealer.full():
                    yield from dealer.flush()
        yield from dealer.flush()

    return run


class _Found:
    """The packed results of one bucket, by owner."""

    def __init__(self, t: pa.Table):
        owner, mark = unpack(t["owner"], np.int64), unpack(t["mark"], np.int32)
        by = np.lexsort((mark, owner))
        self.owner, self.mark = owner[by], mark[by]
        self.ref, self.ref_mark = unpack(t["ref"], np.int64)[by], unpack(t["ref_mark"], np.int32)[by]

    def of(self, owner: int):
        lo, hi = np.searchsorted(self.owner, [owner, owner + 1]) if owner < 2**63 - 1 else (np.searchsorted(self.owner, owner), len(self.owner))
        return self.mark[lo:hi].astype(np.int64), self.ref[lo:hi], self.ref_mark[lo:hi].astype(np.int64)


def factors(owner: int, pos: np.ndarray, mark: np.ndarray, ref: np.ndarray, ref_mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of a document: start and end in words of those of ``WINDOW`` words or more; and which of
    ``pos`` (its seeds, ascending) some other document shares."""
    has = np.zeros(len(pos), bool)
    src, off = np.full(len(pos), owner, np.int64), np.zeros(len(pos), np.int64)
    i = np.searchsorted(pos, mark)
    ok = (i < len(pos)) & (pos[np.minimum(i, len(pos) - 1)] == mark) if len(pos) else np.zeros(len(mark), bool)
    i = i[ok]
    has[i], src[i], off[i] = True, ref[ok], ref_mark[ok] - mark[ok]
    old = has & (src < owner)
    goes_on = np.zeros(len(pos), bool)
    goes_on[1:] = old[1:] & old[:-1] & (src[1:] == src[:-1]) & (off[1:] == off[:-1])
    first = np.flatnonzero(old & ~goes_on)
    last = np.flatnonzero(old & ~np.append(goes_on[1:], False))
    start, end = pos[first], pos[last] + SEED
    long = end - start >= WINDOW
    return start[long], end[long], has


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    d = np.zeros(n + 1, np.int64)
    ok = (start >= 0) & (end <= n)
    np.add.at(d, start[ok], 1)
    np.add.at(d, end[ok], -1)
    return np.cumsum(d[:n]) > 0


def _parse(blocks: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        dealer, seen = Dealer(blocks), _Found(found)
        out, done = [], set()
        for owner, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
            if owner is None or owner in done:
                continue
            mark, ref, ref_mark = seen.of(owner)
            if not len(mark):
                continue
            done.add(owner)
            h = hashes(split(text))
            at = seeds(h)
            pos = np.unique(at)
            start, end, has = factors(owner, pos, mark, ref, ref_mark)
            inside = _covered(len(at), start, end - WINDOW + 1)
            left = np.flatnonzero(~inside & has[np.searchsorted(pos, at)])
            dealer.add(grams(h, WINDOW)[left], np.full(len(left), owner, np.int64), left.astype(np.int32))
            dealer.settle(np.full(len(start), owner, np.int64), start.astype(np.int32), end, np.full(len(start), -1, np.int32))
            if dealer.full():
                out += dealer.flush()
        out += dealer.flush()
        return pa.Table.from_batches(out, PARTS_ARROW)

    return run


def _apply(names: list[str], id_at: int, text_at: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        seen = _Found(found)
        n_words, n_removed, starts, ends, kept = [], [], [], [], []
        for owner, text in zip(docs.column(id_at).to_pylist(), docs.column(text_at).to_pylist(), strict=True):
            w = split(text)
            n_words.append(len(w))
            gone = None
            if owner is not None:
                mark, ref, ref_mark = seen.of(owner)
                span = ref_mark < 0
                hit = span | (ref < owner)
                if hit.any():
                    gone = _covered(len(w), mark[hit], np.where(span, ref, mark + WINDOW)[hit])
            if gone is None or not gone.any():
                n_removed.append(0)
                starts.append([])
                ends.append([])
                kept.append(b" ".join(w))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            starts.append(edge[::2].tolist())
            ends.append(edge[1::2].tolist())
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g))
        cols = [docs.column(n) for n in names] + [
            pa.array(n_words, pa.int64()),
            pa.array(n_removed, pa.int64()),
            pa.array(starts, pa.list_(pa.int64())),
            pa.array(ends, pa.list_(pa.int64())),
            pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()),
        ]
        return pa.Table.from_arrays(cols, [*names, *OWN])

    return run


OWN = ("n_words", "n_removed", "span_starts", "span_ends", "kept")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, with n_words, n_removed, span_starts, span_ends (word positions of the
    removed spans, ends exclusive) and kept (the words left, joined by one space); an own column of such a name gives way.

    A null or empty text has no words; fewer than 13 words have no window. Rows that repeat a doc_id are
    one document and must repeat its text. A null doc_id is neither a source nor judged. Ids are integers.
    """
    docs = docs.drop(*[c for c in OWN if c in docs.columns])
    blocks = block_count(docs, text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = match(narrow.mapInArrow(_emit_seeds(blocks), PARTS), blocks)
    dealt = narrow.withColumn("bucket", bucket_of(F.col("doc_id"), blocks))
    boundary = dealt.groupBy("bucket").cogroup(first.groupBy("block")).applyInArrow(_parse(blocks), PARTS)
    second = match(boundary, blocks)
    names = docs.columns
    bucket = "bucket__" + "_".join(names)
    whole = dealt if names == ["doc_id", "text"] else docs.withColumn(bucket, bucket_of(F.col(id_col), blocks))
    bucket = "bucket" if whole is dealt else bucket
    schema = T.StructType(
        [*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in OWN[:2]), *(T.StructField(c, T.ArrayType(T.LongType())) for c in OWN[2:4]), T.StructField("kept", T.StringType())]
    )
    return whole.groupBy(bucket).cogroup(second.groupBy("block")).applyInArrow(_apply(names, names.index(id_col), names.index(text_col)), schema)
