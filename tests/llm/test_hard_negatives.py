"""Hard negatives against a plain search over all rows, and the pruning that blocks allow."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import hard_negatives as H

VECS = "vec_id long, embedding array<double>, label int, rank string"


@pytest.mark.parametrize("d,bits", [(2, 2), (3, 2), (2, 4), (4, 1)])
def test_hilbert_visits_every_cell_by_single_steps(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    keys = [k.tobytes() for k in H.hilbert(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[np.argsort(keys, kind="stable")]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(rows, anchor, most=5, low=(4, 5)):
    size = max({len(v) for _, v, *_ in rows if v}, key=lambda n: (sum(len(v or ()) == n for _, v, *_ in rows), n))
    fine = lambda v: v and len(v) == size and all(c is not None and math.isfinite(c) for c in v)
    kept = [(i, [math.floor(256 * c) for c in v], label) for i, v, label, *_ in rows if i is not None and label is not None and fine(v)]
    out = []
    for a, (i, q, label) in enumerate(kept):
        if not anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(q, p, strict=True)), j, other) for b, (j, p, other) in enumerate(kept) if a != b]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:most]:
            fits = sorted(x for x in scored if x[2] != label and low[0] * -s <= low[1] * -x[0] and -x[0] <= -s)[:most]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def clustered(n, d, seed, labels=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(12)]
    out = []
    for k in range(n):
        c = r.choice(centres)
        out.append((k, [x + r.gauss(0, 0.3) for x in c], r.randrange(labels), "x"))
    return out


COLS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(spark, rows, every=10):
    got = H.mine(spark.createDataFrame(rows, VECS), F.col("vec_id") % every == 0)
    assert got.columns == list(COLS)
    return sorted(tuple(x) for x in got.collect())


def test_rows_equal_plain_search(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    monkeypatch.setattr(H, "CHUNK_ROWS", 7)
    monkeypatch.setattr(H, "ZONES", 3)
    rows = clustered(260, 6, 1)
    rows += [(1000 + k, rows[k][1], rows[k][2], "tie") for k in range(40)]  # equal scores
    rows += [(20, rows[20][1], rows[20][2], "again"), (30, rows[31][1], 0, "same id"), (2000, None, 1, ""), (2010, [1.0] * 6, None, ""), (None, [1.0] * 6, 1, "")]
    rows += [(2020, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, ""), (2030, [float("nan")] * 6, 1, ""), (2040, [float("-inf")] * 6, 1, ""), (2050, [1.0], 1, ""), (2060, [], 1, "")]
    rows += [(3000, [0.0] * 6, 2, "zero"), (3010, [-x for x in rows[0][1]], 9, "alone in its label")]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_one_label_holds_most_rows_and_one_vector_many(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 32)
    rows = [(k, [1.0, 0.5, -0.25], 0, "") for k in range(150)] + [(200 + k, [1.0, 0.5 - k / 999, -0.25], 0 if k % 5 else 1, "") for k in range(150)]
    assert mined(spark, rows, 50) == brute(rows, lambda i: i % 50 == 0)


def test_blocks_out_of_reach_are_not_read(spark, monkeypatch):
    """Tight far-away clusters: the zone maps alone rule most blocks out."""
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    r = random.Random(5)
    rows = [(k, [10.0 * (j == k % 8) + r.gauss(0, 0.01) for j in range(8)], k // 8 % 2, "") for k in range(512)]
    d, blocks = H.write_blocks(spark.createDataFrame(rows, VECS), F.col("vec_id") % 64 == 0, "vec_id", "embedding", "label", 256)
    n = blocks.count()
    with H.few_rows_a_batch(blocks):
        chunks = H.cut(H.chunked(blocks, d, 5))
        reads = H.search(chunks, blocks, d, 5, None).select("block", "anchor_id").distinct().collect()
    assert n >= 32 and len({x["anchor_id"] for x in reads}) == 8
    assert len(reads) <= 8 * n // 4
    assert mined(spark, rows, 64) == brute(rows, lambda i: i % 64 == 0)


def test_large_integers_stay_exact(spark):
    r = random.Random(9)
    rows = [(k, [r.uniform(-1, 1) * 2.0**17 for _ in range(3)], k % 2, "") for k in range(60)]
    rows += [(100 + k, [r.uniform(-1, 1) * 2.0**22 for _ in range(3)], k % 2, "") for k in range(20)]
    assert mined(spark, rows, 20) == brute(rows, lambda i: i % 20 == 0)


def test_no_rows_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0, ""), (2, [1.0], 1, "")]) == []
    assert mined(spark, [(10, [1.0], 0, ""), (12, [1.0], 1, "")]) == []
