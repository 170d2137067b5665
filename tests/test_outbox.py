import datetime as dt

from weftline.streaming import outbox, stream
from weftline.streaming.outbox import DELAYS_MS, REFUSED_MS, Held, answer_came, row_came, time_came

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_waits_and_tries():
    held, offer = row_came(None, 1, "a")
    assert offer == (1, "a", 1) and held.sent == 1
    held, offer = answer_came(held, 1, 500, now=1_000)
    assert offer is None and held.due == 1_000 + DELAYS_MS[0]
    assert time_came(held, held.due - 1) == (held, None)
    held, offer = time_came(held, held.due)
    assert offer == (1, "a", 2) and held.due == -1
    held, _ = answer_came(held, 1, 500, now=9_000)
    assert held.due == 9_000 + DELAYS_MS[1]
    held, offer = time_came(held, held.due)
    assert offer == (1, "a", 3)
    held, offer = answer_came(held, 1, 500, now=50_000)
    assert offer is None and (held.version, held.sent, held.due) == (1, -1, -1)  # kept, no more tries
    held, offer = row_came(held, 2, "b")
    assert offer == (2, "b", 1)
    assert answer_came(held, 2, 200, now=60_000) == (None, None)


def test_a_refusal_waits_longer_once():
    held, _ = row_came(None, 1, "a")
    held, _ = answer_came(held, 1, 403, now=0)
    assert held.due == REFUSED_MS
    held, offer = time_came(held, REFUSED_MS)
    assert offer == (1, "a", 2)
    held, _ = answer_came(held, 1, 403, now=200_000)
    assert held.due == 200_000 + DELAYS_MS[1]


def test_only_the_version_sent_is_settled():
    held, _ = row_came(None, 1, "a")
    held, offer = row_came(held, 2, "b")  # replaced while it is on its way
    assert offer is None and held.sent == 1
    held, offer = answer_came(held, 1, 200, now=0)
    assert offer == (2, "b", 1)
    assert answer_came(held, 1, 200, now=0) == (held, None)  # an answer that comes twice
    assert row_came(held, 1, "old") == (held, None)
    assert answer_came(held, 2, 204, now=0) == (None, None) == answer_came(None, 2, 204, now=0)
    waiting = Held(1, "a", failures=1, due=500)
    held, offer = row_came(waiting, 2, "b")  # a wait goes on with the newer version
    assert offer is None and time_came(held, 500)[1] == (2, "b", 2)


def test_offers_of_a_stream_across_a_restart(spark, tmp_path):
    kind = "key string, kind string, version long, payload string, status int"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        def run(*events):
            spark.createDataFrame(list(events), kind).coalesce(1).write.json(f"{tmp_path}/in", mode="append")
            rows = spark.readStream.schema(kind).json(f"{tmp_path}/in")
            q = outbox.offers(rows).writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start()
            assert q.awaitTermination(60)  # with timers `availableNow` never ends
            return sorted((r["key"], r["version"], r["attempt"]) for r in spark.read.schema("key string, version long, payload string, attempt int").json(f"{tmp_path}/out").collect())

        assert run(("a", "row", 1, "x", None), ("b", "row", 1, "y", None), (None, "row", 1, "z", None)) == [("a", 1, 1), ("b", 1, 1)]
        assert run(("a", "row", 2, "x2", None), ("b", "answer", 1, None, 200), ("a", "answer", 1, None, 200)) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 1)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_comments_before_their_post(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        def run(comments, posts):
            spark.createDataFrame(comments, "post string, said string, comment_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/comments", mode="append")
            spark.createDataFrame(posts, "post string, title string, post_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/posts", mode="append")
            read = lambda name, k: spark.readStream.schema(k).parquet(f"{tmp_path}/{name}")
            joined = stream.attached_late(read("comments", "post string, said string, comment_at timestamp"), read("posts", "post string, title string, post_at timestamp"), "post", "comment_at", "post_at", "10 minutes")
            q = joined.writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            q.awaitTermination(120)
            return sorted((r["said"], r["title"]) for r in spark.read.schema("said string, title string").json(f"{tmp_path}/out").collect())

        assert run([("p", "early", at(0)), ("gone", "orphan", at(1))], [("q", "other", at(1))]) == []
        assert run([("q", "late", at(3))], [("p", "found", at(5))]) == [("early", "found"), ("late", "other")]  # after a restart
        run([("x", "far", at(200))], [("y", "far", at(200))])
        assert ("orphan", None) in run([("x", "farther", at(300))], [("y", "farther", at(300))])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
