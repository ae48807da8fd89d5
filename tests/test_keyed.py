import pytest

from millrace.sources import files, keyed

SCHEMA = "day string, k int, v int"


def put(spark, path, version, *rows, **more):
    keyed.upsert(spark, path, spark.createDataFrame(list(rows), more.pop("schema", SCHEMA)), ["k"], "day", version, **more)


def table(spark, path):
    return sorted(tuple(r) for r in keyed.read_keyed(spark, path, "day").select("day", "k", "v").fillna("none").collect())


def folders(spark, path):
    return [(v, f) for v in files.names(spark, path) if v.startswith("version=") for f in files.names(spark, f"{path}/{v}") if "=" in f]


def test_old_versions_go_and_readers_of_the_pointer_before_stay(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    put(spark, path, 0, *((f"d{i}", i, 0) for i in range(5)))
    for n in range(1, 25):
        before = keyed.read_keyed(spark, path, "day")
        put(spark, path, n, (f"d{n % 5}", n % 5, n))
        assert before.count() == 5  # files of the pointer before are still there
    assert table(spark, path) == [(f"d{i}", i, 20 + i) for i in range(5)]
    assert len(folders(spark, path)) == 5 + 1
    assert len([f for f in files.names(spark, f"{path}/_pointers") if f.endswith(".json") and not f.startswith(".")]) == 2


def test_a_crash_between_files_and_pointer_leaves_the_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    put(spark, path, 0, ("a", 1, 1), ("b", 2, 2))
    with monkeypatch.context() as m, pytest.raises(OSError, match="power"):
        m.setattr(files, "write_text", lambda *_: (_ for _ in ()).throw(OSError("power")))
        put(spark, path, 1, ("a", 1, 9))
    assert table(spark, path) == [("a", 1, 1), ("b", 2, 2)]
    put(spark, path, 1, ("a", 1, 7))
    put(spark, path, 1, ("a", 1, 8))  # a repeated version starts from the one before it
    assert table(spark, path) == [("a", 1, 8), ("b", 2, 2)]
    with pytest.raises(ValueError, match="older"):
        put(spark, path, 0, ("a", 1, 0))


def test_deleted_keys_and_emptied_partitions(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", SCHEMA + ", gone boolean"
    put(spark, path, 0, ("a", 1, 1, None), ("a", 2, 2, False), ("b c:d", 3, 3, False), (None, 4, 4, False), schema=schema, deleted="gone")
    put(spark, path, 1, ("a", 1, 0, True), ("b c:d", 3, 0, True), (None, 4, 0, True), ("x", 9, 9, True), schema=schema, deleted="gone")
    assert table(spark, path) == [("a", 2, 2)]
    put(spark, path, 2, ("a", 2, 0, True), schema=schema, deleted="gone")
    assert keyed.read_keyed(spark, path, "day") is None
    put(spark, path, 3, ("a", 5, 5, False), schema=schema, deleted="gone")
    assert table(spark, path) == [("a", 5, 5)]
