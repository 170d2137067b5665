import random

import pytest

from weftline.streaming import stream
from weftline.streaming.lines import GrowingLines, GrowingLinesReader, Range


def ask(spark, path, checkpoint, table):
    """One run over all that is there now."""
    spark.dataSource.register(GrowingLines)
    rows = spark.readStream.format("growing_lines").option("glob", "*.jsonl").option("range_bytes", 7).load(str(path))
    q = rows.writeStream.format("parquet").option("path", str(table)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = spark.read.schema("file string, offset long, value string").parquet(str(table)).collect() if any(table.glob("*.parquet")) else []
    return sorted((r["file"], r["offset"], r["value"]) for r in found)


def test_a_line_in_pieces_is_read_once_and_restarts_lose_nothing(spark, tmp_path):
    landed, checkpoint, table = tmp_path / "in", tmp_path / "c", tmp_path / "out"
    landed.mkdir()
    file = landed / "a.jsonl"
    file.write_bytes('{"a": 1}\n{"b": "ö'.encode()[:-1])  # torn inside a character
    (landed / "other.txt").write_text("not asked for\n")
    assert ask(spark, landed, checkpoint, table) == [("a.jsonl", 0, '{"a": 1}')]
    whole = '{"a": 1}\n{"b": "öl"}\n\r\nlast'.encode()
    file.write_bytes(whole)
    (landed / "b.jsonl").write_text("x\n")
    second = [("a.jsonl", 0, '{"a": 1}'), ("a.jsonl", 9, '{"b": "öl"}'), ("a.jsonl", 22, ""), ("b.jsonl", 0, "x")]
    assert ask(spark, landed, checkpoint, table) == second
    assert ask(spark, landed, checkpoint, table) == second
    (landed / "a.jsonl.end").write_text("")
    assert ask(spark, landed, checkpoint, table) == sorted([*second, ("a.jsonl", 24, "last")])


@pytest.mark.parametrize("size", [1, 2, 3, 5, 1_000])
def test_ranges_split_lines_nowhere(tmp_path, size):
    rng = random.Random(size)
    lines = ["".join(rng.choice("ab☃") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    data = "".join(x + "\n" for x in lines).encode()
    (tmp_path / "f").write_bytes(data)
    reader = GrowingLinesReader({"path": str(tmp_path), "range_bytes": str(size)})
    start, end = reader.initialOffset(), reader.latestOffset()
    got = [row for part in reader.partitions(start, end) for row in reader.read(part)]
    assert [v for _, _, v in got] == lines and all(isinstance(p, Range) for p in reader.partitions(start, end))
    assert [o for _, o, _ in got] == [len("".join(x + "\n" for x in lines[:i]).encode()) for i in range(60)]


def test_contents_are_read_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        kind = "page string, body string"

        def run():
            source = spark.readStream.schema(kind).json(f"{tmp_path}/in")
            q = stream.read_once(source, "body").writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start()
            assert q.awaitTermination(60)  # with times to live `availableNow` never ends
            return sorted(r["body"] or "" for r in spark.read.schema(kind).json(f"{tmp_path}/out").collect())

        spark.createDataFrame([("p", "one"), ("q", "one"), ("q", "two"), ("r", None)], kind).write.json(f"{tmp_path}/in", mode="append")
        assert run() == ["", "one", "two"]
        spark.createDataFrame([("p", "one"), ("s", "three"), ("s", "three")], kind).write.json(f"{tmp_path}/in", mode="append")
        assert run() == ["", "one", "three", "two"]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
