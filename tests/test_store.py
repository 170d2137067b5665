import pytest

from weftline.operators.store import Conflict, KeyedStore

KIND = "k long, v long, x string"


def rows(spark, *values, kind=KIND):
    return spark.createDataFrame(list(values), kind)


def held(store):
    now = store.read()
    return set() if now is None else set(map(tuple, now.collect()))


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/store", "k", "v", parts=16)


def test_greatest_version_stays(spark, store):
    assert held(store) == set()
    store.upsert(rows(spark, (1, 1, "a"), (2, 1, "b"), (None, 1, "no record")))
    store.upsert(rows(spark, (2, 2, "c"), (3, 1, "d"), (1, 0, "old")))
    assert held(store) == {(1, 1, "a"), (2, 2, "c"), (3, 1, "d")}
    store.upsert(rows(spark, (2, 2, "c"), (3, 1, "d")))
    assert held(store) == {(1, 1, "a"), (2, 2, "c"), (3, 1, "d")}
    assert store.upsert(rows(spark, (None, 1, "y"))) == store.manifest()
    both = rows(spark, (9, 1, "p"), (9, 1, "q"))
    store.upsert(both)
    first = {r for r in held(store) if r[0] == 9}
    store.upsert(both.orderBy("x", ascending=False))
    assert {r for r in held(store) if r[0] == 9} == first and len(first) == 1


def test_only_touched_parts_are_rewritten(spark, store):
    before = store.upsert(spark.range(2_000).selectExpr("id k", "1L v", "'a' x"))
    after = store.upsert(rows(spark, (7, 2, "b"), (7, 3, "c")))
    changed = [p for p in after["files"] if after["files"][p] != before["files"][p]]
    assert len(before["files"]) == 16 and len(changed) == 1 and sum(n for _, n in after["files"].values()) == 2_000
    assert store.read().count() == 2_000 and store.read().where("v = 3").count() == 1


def test_no_success_marks_are_needed(spark, store):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        store.upsert(rows(spark, (1, 1, "a")))
        store.upsert(rows(spark, (2, 1, "b")))
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert held(store) == {(1, 1, "a"), (2, 1, "b")}


def test_crash_before_the_manifest_leaves_the_last(spark, store):
    store.upsert(rows(spark, (1, 1, "a")))

    def crash(manifest):
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        store.upsert(rows(spark, (1, 2, "lost"), (2, 1, "lost")), before_publishing=crash)
    assert held(store) == {(1, 1, "a")}
    store.upsert(rows(spark, (1, 2, "b")))
    assert held(store) == {(1, 2, "b")}
    store.clean(keep=1)
    assert held(store) == {(1, 2, "b")} and len(store._system().globStatus(store._file("data/*"))) == 1


def test_of_two_writers_one_does_its_merge_again(spark, store):
    store.upsert(rows(spark, (1, 1, "a")))
    met = []

    def meanwhile(manifest):
        if not met:
            met.append(KeyedStore(spark, store.path, "k", "v").upsert(rows(spark, (1, 5, "other"), (2, 1, "other"))))

    last = store.upsert(rows(spark, (1, 4, "mine"), (3, 1, "mine")), before_publishing=meanwhile)
    assert held(store) == {(1, 5, "other"), (2, 1, "other"), (3, 1, "mine")} and last["number"] == met[0]["number"] + 1

    def always(manifest):
        KeyedStore(spark, store.path, "k", "v").upsert(rows(spark, (8, 100 + manifest["number"], "other")))

    with pytest.raises(Conflict):
        store.upsert(rows(spark, (9, 1, "mine")), tries=2, before_publishing=always)
    assert not any(r[0] == 9 for r in held(store))


def test_columns_may_be_added(spark, store):
    store.upsert(rows(spark, (1, 1, "a")))
    store.upsert(rows(spark, (2, 1, "b", 7), kind=KIND + ", y int"))
    store.upsert(rows(spark, *((i, 1, "c") for i in range(3, 40))))
    assert store.read().columns == ["k", "v", "x", "y"]
    assert {r["k"]: r["y"] for r in store.read().collect()} == {i: 7 if i == 2 else None for i in range(1, 40)}
