"""Tables replaced whole: retried loads, writers that collide, readers that keep their version."""

from conftest import rows

from marketlens.sources import versions as V

SCHEMA = "id long, x long, at long"


def load(spark, pairs, at):
    return spark.createDataFrame([(i, x, at) for i, x in pairs], SCHEMA)


def test_readers_see_whole_versions(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert V.read(spark, root) is None and V.history(spark, root) is None
    assert V.merge(load(spark, [(1, 10), (2, 20), (None, 1)], 0), root, "a", ["id"], ["at"]) == 1
    old = V.read(spark, root)
    assert V.merge(load(spark, [(2, 21), (3, 30)], 1), root, "b", ["id"], ["at"]) == 2
    assert rows(old, "id", "x") == [(1, 10), (2, 20), (None, 1)]
    new = [(1, 10), (2, 21), (3, 30), (None, 1)]
    assert rows(V.read(spark, root), "id", "x") == new
    # Sent again, with other rows even: the load is there, so nothing changes.
    assert V.merge(load(spark, [(1, 99)], 9), root, "a", ["id"], ["at"]) == 1
    assert rows(V.read(spark, root), "id", "x") == new and rows(V.read(spark, root, 1), "id", "x") == [(1, 10), (2, 20), (None, 1)]
    assert V.merge(load(spark, [], 2), root, "empty", ["id"], ["at"]) == 3 and rows(V.read(spark, root), "id", "x") == new


def test_second_writer_merges_again(spark, tmp_path):
    root = f"{tmp_path}/t"
    V.merge(load(spark, [(1, 10)], 0), root, "a", ["id"], ["at"])
    seen = V._taken(spark, root)
    mine = V.N.merge_dedupe(V.read(spark, root), load(spark, [(2, 20)], 1), ["id"], ["at"])
    V.merge(load(spark, [(3, 30)], 1), root, "b", ["id"], ["at"])
    assert V.commit(mine, root, "c", seen) is False
    assert rows(V.read(spark, root), "id", "x") == [(1, 10), (3, 30)]
    V.merge(load(spark, [(2, 20)], 1), root, "c", ["id"], ["at"])
    assert rows(V.read(spark, root), "id", "x") == [(1, 10), (2, 20), (3, 30)]


def test_unfinished_line_is_no_version(spark, tmp_path):
    root = f"{tmp_path}/t"
    V.merge(load(spark, [(1, 10)], 0), root, "a", ["id"], ["at"])
    (tmp_path / "t" / "log" / f"{2:020d}").write_text('{"version": 2, "lo')
    assert rows(V.read(spark, root), "id", "x") == [(1, 10)]
    assert V.merge(load(spark, [(2, 20)], 1), root, "b", ["id"], ["at"]) == 3
    assert rows(V.read(spark, root), "id", "x") == [(1, 10), (2, 20)]
