"""Matching keys across documents through indexed blocks.

Documents emit many 64-bit keys. To find which documents share a key, keys are dealt to blocks by
their value; within a task the entries are packed, one binary row per block, and pre-aggregated: of the
entries of one key only those of the smallest owner travel, marked as shared, and the others are settled on
the spot. So a key that a third of all documents hold costs one entry per batch. A block holds the keys of
about ``BLOCK_BYTES`` of text, and the number of blocks grows with the corpus. Results are packed by
bucket of the owner and meet the texts in a cogroup on that bucket, so no task holds more than a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text per block and bucket.
BLOCK_BYTES = 4 << 20
#: Entries that a task holds before it packs them.
FLUSH = 300_000

PARTS = "block long, kind int, key binary, owner binary, mark binary, flag binary, ref_mark binary"
FOUND = "block long, owner binary, mark binary, ref binary, ref_mark binary"
KEYED = "key long, hub long, doc long"
PARTS_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32())] + [(c, pa.binary()) for c in ("key", "owner", "mark", "flag", "ref_mark")])
_FOUND = pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in ("owner", "mark", "ref", "ref_mark")])

Emit = Callable[[np.ndarray, np.ndarray, np.ndarray], None]


def block_count(docs: DataFrame, text_col: str = "text") -> int:
    """A prime number of blocks for the corpus, from one pass over the lengths of the texts."""
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(parts, total // BLOCK_BYTES + 1)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def bucket_of(owner: Column, blocks: int) -> Column:
    """By id; rows without one, which nothing is found for, are dealt out evenly."""
    return F.coalesce(F.pmod(owner.cast("long"), F.lit(blocks)), F.pmod(F.monotonically_increasing_id(), F.lit(blocks))).cast("long")


def tasks_for(rows: int, each: int = 50_000, least: int = 8) -> int:
    """Tasks that a small table's rows ask for; grows with the rows."""
    return max(least, rows // each + 1)


@contextmanager
def shuffle_partitions(df: DataFrame, rows: int, each: int = 50_000, least: int = 8):
    """While small tables are made and written: as many shuffle partitions as their rows ask for, whatever the session's
    number is. Hundreds of tasks and files for a few thousand rows would cost more than the rows."""
    conf, name = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, str(tasks_for(rows, each, least)))
    try:
        yield
    finally:
        conf.set(name, before)


def pack(a: np.ndarray) -> bytes:
    """Byte planes, so that the shuffle's compression sees the high bytes together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpack(column: pa.ChunkedArray, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel() for b in column.to_pylist() if b]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def _runs(keys: np.ndarray, owners: np.ndarray):
    """Order by key and owner; for each entry in that order the index of its key's first, and whether two owners share the key."""
    by = np.lexsort((owners, keys))
    k, o = keys[by], owners[by]
    new = np.empty(len(k), bool)
    new[:1] = True
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(k)))
    shared = np.repeat(o[first] != o[first + size - 1], size)
    return by, np.repeat(first, size), shared


class Dealer:
    """Collects entries in a task and packs them by block. ``settled`` entries pass through to their owner.
    ``plain`` entries have no marks; ``keyed`` ones have their key as the mark, which travels only where settled."""

    def __init__(self, blocks: int, plain: bool = False, keyed: bool = False):
        self.blocks, self.plain, self.keyed = blocks, plain, keyed
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.settled: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, owners: np.ndarray, marks: np.ndarray) -> None:
        self.entries.append((keys, owners, marks))
        self.held += len(keys)

    def settle(self, owners, marks, refs, ref_marks) -> None:
        self.settled.append((owners, marks, refs, ref_marks))
        self.held += len(owners)

    def full(self) -> bool:
        return self.held >= FLUSH

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        if self.entries:
            keys, owners, marks = (np.concatenate(x) for x in zip(*self.entries, strict=True))
            by, first, shared = _runs(keys, owners)
            least = owners[by][first] == owners[by]
            later = by[~least]
            if len(later):
                at = by[first[~least]]
                self.settled.append((owners[later], marks[later], owners[at], marks[at]))
            flag = np.zeros(len(keys), np.uint8)
            flag[by] = shared
            if self.plain:  # one entry for each key and owner is enough
                same = np.zeros(len(keys), bool)
                o, k = owners[by], keys[by]
                same[by[1:]] = (o[1:] == o[:-1]) & (k[1:] == k[:-1])
            go = np.zeros(len(keys), bool)
            go[by[least]] = True
            if self.plain:
                go &= ~same
            keys, owners, marks, flag = keys[go], owners[go], marks[go], flag[go]
            to = (keys % np.uint64(self.blocks)).astype(np.int64)
            for b, i in _groups(to):
                mark = b"" if self.plain or self.keyed else pack(marks[i])
                rows.append((b, 0, pack(keys[i]), pack(owners[i]), mark, pack(flag[i]), b""))
        if self.settled:
            owners, marks, refs, ref_marks = (np.concatenate(x) for x in zip(*self.settled, strict=True))
            if self.plain:
                owners, counts = np.unique(owners, return_counts=True)
                marks = counts.astype(np.int32)
            for b, i in _groups(np.mod(owners, self.blocks)):
                ref, mark = b"" if self.plain else pack(refs[i]), pack(marks[i])
                ref_mark = b"" if self.plain or self.keyed else pack(ref_marks[i])
                rows.append((b, 1, ref, pack(owners[i]), mark, b"", ref_mark))
        self.entries, self.settled, self.held = [], [], 0
        for at in range(0, len(rows), 64):
            cols = list(zip(*rows[at : at + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PARTS_ARROW, strict=True)], schema=PARTS_ARROW)


def _groups(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    by = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[by])) + 1
    for i in np.split(by, cuts) if len(by) else []:
        yield int(to[i[0]]), i


def match(parts: DataFrame, blocks: int, plain: bool = False, keyed: bool = False) -> DataFrame:
    """For each entry whose key two owners share: owner, mark, and the key's smallest owner with its first mark
    (the entry itself, if that is its own). Packed by bucket of the owner. ``plain`` returns each such
    owner once with the number of its shared entries as the mark. Settled entries pass through. ``keyed`` returns rows
    (key, hub, doc) that are not packed: the key, its smallest owner and the owner."""
    mark_type = np.int64 if keyed else np.int32

    def one(t: pa.Table) -> pa.Table:
        kind = np.asarray(t["kind"])
        new, old = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1))
        keys, owners, flag = unpack(new["key"], np.uint64), unpack(new["owner"], np.int64), unpack(new["flag"], np.uint8)
        marks = keys.view(np.int64) if keyed else np.zeros(len(keys), np.int32) if plain else unpack(new["mark"], np.int32)
        by, first, shared = _runs(keys, owners)
        hot = np.zeros(len(keys), bool)  # by the first of each key: any entry of it came in as shared
        np.logical_or.at(hot, first, flag[by] > 0)
        shared |= hot[first]
        got = by[shared]
        at = by[first[shared]]
        owner = np.concatenate([owners[got], unpack(old["owner"], np.int64)])
        if plain:
            n = np.concatenate([np.ones(len(got), np.int64), unpack(old["mark"], np.int32).astype(np.int64)])
            owner, at = np.unique(owner, return_inverse=True)
            mark = np.bincount(at, n, len(owner)).astype(np.int32)
            ref = ref_mark = None
        else:
            mark = np.concatenate([marks[got], unpack(old["mark"], mark_type)])
            ref = np.concatenate([owners[at], unpack(old["key"], np.int64)])
            if keyed:
                return pa.Table.from_arrays([pa.array(mark), pa.array(ref), pa.array(owner)], ["key", "hub", "doc"])
            ref_mark = np.concatenate([marks[at], unpack(old["ref_mark"], np.int32)])
        rows = []
        for b, i in _groups(np.mod(owner, blocks)):
            rest = (b"", b"") if plain else (pack(ref[i]), pack(ref_mark[i]))
            rows.append((b, pack(owner[i]), pack(mark[i]), *rest))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)

    return parts.groupBy("block").applyInArrow(one, KEYED if keyed else FOUND)
