"""Listings of outlets, orders, run clocks and times read once a label."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import times
from weftline.operators import order, sink, status
from weftline.sources.outlets import listed_outlets


def walked(answers, furthest):
    """What a reader of one run sees, page by page."""
    pages = {}
    for offset, body in answers:
        if body is not None and offset is not None:
            pages[offset] = max(body, pages.get(offset, ""))
    out, offset = [], 0
    while offset <= furthest and offset in pages:
        try:
            page = json.loads(pages[offset])
        except ValueError:
            break
        if not isinstance(page, dict):
            break
        rows = page["sources"] if page.get("sources") is not None else page.get("items") or []
        out += [(offset, i, x.get("handle")) for i, x in enumerate(rows)]
        about = page.get("pagination") or {}
        returned = about["returned"] if about.get("returned") is not None else len(rows)
        if about.get("hasMore") is False or not returned:
            break
        offset += returned
    return out


def body(names, field="sources", **pagination):
    return json.dumps({field: [{"handle": n} for n in names], "pagination": pagination})


RUNS = {
    "whole": [(0, body("ab")), (2, body("c", "items")), (3, body("", hasMore=True))],
    "ends": [(0, body("ab", hasMore=False)), (2, body("c"))],
    "gap": [(0, body("ab")), (3, body("d")), (4, body("e"))],
    "no start": [(1, body("a"))],
    "says three": [(0, body("ab", returned=3)), (2, body("x")), (3, body("c"))],
    "says none": [(0, body("ab", returned=0)), (2, body("c"))],
    "twice": [(0, body("ab")), (0, body("ab")), (2, body("c")), (2, body("c"))],
    "broken": [(0, body("ab")), (2, "{no json"), (3, body("c"))],
    "null": [(0, body("a")), (1, None), (None, body("z")), (2, body("c"))],
    "far": [(0, body("abcde")), (5, body("fghij")), (10, body("k"))],
    "both": [(0, json.dumps({"sources": [], "items": [{"handle": "a"}]})), (1, body("b"))],
    "bare": [(0, json.dumps({"items": [{"handle": "a"}, {}]})), (2, "[]")],
    "empty": [],
}


@pytest.mark.parametrize("furthest", [4, 9, 2_000])
def test_listing_like_a_walk(spark, furthest):
    rows = [(run, offset, text, "x") for run, pages in RUNS.items() for offset, text in pages] + [(None, 0, body("a"), "x")]
    found = listed_outlets(spark.createDataFrame(rows, "r string, o long, b string, outlet string"), "r", "o", "b", furthest)
    got = {run: [] for run in RUNS}
    for r in found.select("run", "offset", "place", "outlet.handle").collect():
        got[r[0]].append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: walked(v, furthest) for k, v in RUNS.items()}


def test_outlet_columns(spark):
    outlets = [
        {"handle": "Ab/", "externalId": 7, "mediaOutlet": "ab", "metadata": {"group": {"slug": "S", "externalId": "7"}}, "discoveryUrl": "https://h.example/groups/%C3%A9t/x", "lastDiscoveredAt": "d"},
        {"canonicalUrl": "groups/no", "last_discovered_at": "e"},
        {"lastDiscoveredAt": "", "last_discovered_at": "f"},
    ]
    df = spark.createDataFrame([("r", 0, json.dumps({"items": outlets}))], "r string, o int, b string")
    rows = listed_outlets(df, "r", "o", "b").orderBy("place").collect()
    assert [sorted(r["keys"]) for r in rows] == [["7", "ab", "s", "ét"], [], []]
    assert [r["last_discovered_at"] for r in rows] == ["d", "e", None]
    assert listed_outlets(df.limit(0), "r", "o", "b").collect() == []


def test_order_of_a_snapshot(spark):
    labels = [" Newest ", "MOST RECENT", "All comments", "Most relevant", "newestish", "", None, "New posts", "new posts today"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    states = [r[0] for r in df.select(order.order_state(F.col("label"), "newest", order.COMMENT_ORDERS)).collect()]
    assert [s["verified"] for s in states] == [True, True, True, False, False, False, False, False, False]
    assert [s["reason"] for s in states] == [None] * 3 + ["not_verified"] * 2 + ["control_not_found"] * 2 + ["not_verified"] * 2
    feed = [r[0]["verified"] for r in df.select(order.order_state(F.col("label"), "new", order.FEED_ORDERS)).collect()]
    assert feed == [False] * 7 + [True, False]
    other = df.select(order.order_state(F.col("label"), "oldest", order.COMMENT_ORDERS).alias("s")).first()["s"]
    assert (other["order"], other["verified"], other["reason"]) == (None, False, "unknown_order")


def test_unsorted_is_marked_once(spark):
    df = spark.createDataFrame([(None, True), (None, False), (["a", order.UNSORTED], False), (["a"], None)], "w array<string>, v boolean")
    marked = [r[0] for r in df.select(order.marked_unsorted(F.col("w"), F.col("v"))).collect()]
    assert marked == [[], [order.UNSORTED], ["a", order.UNSORTED], ["a", order.UNSORTED]]


def test_newest_first(spark):
    df = spark.createDataFrame([("t", 1, None), ("t", 2, 5), ("t", 3, 5), ("t", 4, 9), (None, 5, 1)], "thread string, key int, at int")
    placed = {r["key"]: r["place"] for r in order.newest_first(df, "thread", "at", "key").collect()}
    assert placed == {4: 1, 2: 2, 3: 3, 1: 4, 5: 1}
    assert {r["key"] for r in order.newest_first(df, "thread", "at", "key", most=1).collect()} == {4, 5}
    assert [r["place"] for r in order.in_document_order(df, "thread", "key").orderBy("key").collect()] == [1, 2, 3, 4, 1]


def test_clock_from_json(spark):
    whole = dict(zip(status.CLOCK, (0, 10, 10, 30, 30, 30.5), strict=True))
    saved = [json.dumps(x) for x in (whole, whole | {"storeEndedAt": "30.5"}, whole | {"drainEndedAt": 9}, {"collectStartedAt": None, "other": 1}, [1])] + ["{no", "", None]
    df = spark.createDataFrame([(x,) for x in saved], "saved string").select(status.restored_clock(F.col("saved")).alias("c"))
    clocks = [tuple(r[0]) for r in df.collect()]
    none = (None,) * 6
    assert clocks == [(0, 10, 10, 30, 30, 30.5), (0, 10, 10, 30, 30, None), (0, 10, 10, 9, 30, 30.5), none, none, none, none, none]
    totals = [r[0] for r in df.select(status.timing_totals(F.col("c"), F.lit(True))).collect()]
    assert totals[0] == (10, 20, 0.5, 30.5) and totals[1:] == [None] * 7
    assert df.select(status.timing_totals(F.col("c"), F.lit(False)).alias("t")).where("t is not null").count() == 0
    assert spark.range(1).select(status.stamp_ms(F.lit(float("nan"))), status.stamp_ms(F.lit(float("-inf"))), status.stamp_ms(F.lit(3.0))).first() == (None, None, 3.0)


def test_iso_or_null(spark):
    df = spark.createDataFrame([("2024-02-29T23:30:00.123+02:00",), ("2024-02-30",), ("soon",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(times.iso_or_null(F.col("t"))).collect()] == ["2024-02-29T21:30:00.123Z", None, None, None, None]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert df.select(times.iso_or_null(F.col("t"))).first()[0] == "2024-02-29T21:30:00.123Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_labels_read_once(spark):
    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    rows = [(1, "2024-01-05", "January 3, 2024"), (2, "2024-01-05", None), (2, "2024-01-05", None), (3, "nothing", "2024-01-05"), (4, None, "")]
    df = spark.createDataFrame(rows, "k int, one string, two string")
    each = df.select("k", "one", "two", times.absolute_time(F.col("one"), now).alias("a"), times.absolute_time(F.col("two"), now).alias("b"))
    once = times.with_absolute_times(df, {"a": "one", "b": "two"}, now)
    assert once.columns == each.columns
    key = lambda r: [str(x) for x in r]
    assert sorted(once.collect(), key=key) == sorted(each.collect(), key=key)
    assert times.with_absolute_times(df.limit(0), {"a": "one"}, now).collect() == []


def test_saved_outbox(spark):
    schema = "post_id string, group_key string, turn int, named string"
    waiting = spark.createDataFrame([("a", "g", 1, "w"), (None, "g", 2, "w"), ("z", "h", 3, "w")], schema)
    saved = spark.createDataFrame([("a", "g", 1, "s"), ("b", "g", 3, "s3"), ("b", "g", 2, "s2"), ("a", "k", 1, "s"), (None, "g", 1, "s"), ("", "g", 1, "s"), ("c", None, 1, "s"), ("c", "", 1, "s")], schema)
    values = lambda df: sorted(((r["post_id"] or "", r["group_key"] or "", r["named"]) for r in df.collect()))
    assert values(sink.resumed(waiting, saved, "turn")) == [("", "g", "w"), ("a", "g", "w"), ("a", "k", "s"), ("b", "g", "s2"), ("z", "h", "w")]
    assert values(sink.resumed(waiting.limit(0), saved.limit(0), "turn")) == []
    groups = spark.createDataFrame([("g",), ("g",), ("k",), ("",), (None,)], "group_key string")
    assert values(sink.parked(saved, waiting, groups)) == [("", "g", "w"), ("a", "g", "w"), ("c", "", "s"), ("c", "", "s")]
