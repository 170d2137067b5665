from pyspark.sql import functions as F

from weftline.operators import sink
from weftline.operators.store import KeyedStore
from weftline.streaming import stream

KIND = "user_id long, event_id long, value double, ts timestamp"


def parts(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/events.parquet").selectExpr("user_id", "event_id", "value", "cast(ts as timestamp) ts").where("user_id < 20")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), rows


def run(df, name, mode, **trigger):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_merged_stream_equals_batch(spark, tmp_path):
    rows, batch = parts(spark, tmp_path)
    rules = dict(most=["value"], last=["ts"])
    got = run(stream.merged_stream(rows, "user_id", "event_id", **rules), "merged", "complete")
    want = stream.merged_stream(batch, "user_id", "event_id", **rules)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_once_per_key(spark, tmp_path):
    rows, batch = parts(spark, tmp_path)
    twice = rows.unionByName(rows)
    got = run(stream.once_per_key(twice, ["event_id"], "ts", "60 days"), "once", "append")
    assert got.count() == batch.count()


def test_upsert_sink_delivers_twice(spark, tmp_path):
    rows, batch = parts(spark, tmp_path)
    deliver = stream.upsert_sink(f"{tmp_path}/out", "user_id", "event_id")
    for _ in range(2):
        q = rows.writeStream.foreachBatch(deliver).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c{_}").start()
        q.awaitTermination(120)
    now = KeyedStore(spark, f"{tmp_path}/out", "user_id", "event_id").read()
    want = batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert sorted(map(tuple, now.select("user_id", "event_id").collect())) == sorted(map(tuple, want.collect()))


def test_hold_until_result(spark, tmp_path):
    rows = spark.createDataFrame([("a", "post", None), ("b", "post", None), ("a", "result", "r1"), ("c", "result", "r2")], "id string, kind string, payload string")
    rows.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = run(stream.hold_until_result(source, "id"), "held", "append", once=True).collect()  # with timers `availableNow` never ends
    assert [tuple(r) for r in got] == [("a", "r1", "result")]


def test_envelope(spark):
    assert sink.envelope(spark.range(1)).first()[0] == '{"id":0}'
