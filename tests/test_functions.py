import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import comments, counts, text, times, urls
from weftline.functions.ids import record_id, record_ids
from weftline.operators import cutoff, merge, resolve, sink, threads
from weftline.sources.html import page_of
from weftline.sources.json_payload import first_json, stories_of

NOW = dt.datetime(2024, 2, 1, 12, 0)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value, NOW)], f"x {kind}, now timestamp").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("label", "want"),
    [("1.2K", 1200), ("3M", 3_000_000), ("1,234", 1234), (",", 0), (".", None), ("1.2.3", None), ("x", None), (None, None), ("24 reactions", 24)],
)
def test_parsed_count(spark, label, want):
    assert one(spark, counts.parsed_count, label) == want


@pytest.mark.parametrize(
    ("label", "seconds"),
    [("3h", 10_800), ("about 2 days ago", 172_800), ("an hour ago", 3_600), ("1 mo", 2_629_800), ("just now", 0), ("Ann · 5 min", 300)],
)
def test_relative_time(spark, label, seconds):
    assert one(spark, lambda x: times.relative_time(x, F.col("now")), label) == NOW - dt.timedelta(seconds=seconds)


@pytest.mark.parametrize(
    ("label", "want"),
    [
        ("9/8/25", dt.datetime(2025, 9, 8)), ("13/2/2025", dt.datetime(2025, 2, 13)), ("13/13", None), ("2/31/2025", dt.datetime(2025, 3, 3)),
        ("September 8", dt.datetime(2024, 9, 8)), ("8 September 2025", dt.datetime(2025, 9, 8)), ("Market 5", dt.datetime(2024, 3, 5)),
        ("Yesterday at 5:03 PM", dt.datetime(2024, 1, 31, 17, 3)), ("2024-01-05", dt.datetime(2024, 1, 5)), ("hello", None), (None, None),
        ("January 3, 2024 at 12:00 am", dt.datetime(2024, 1, 3)),
    ],
)
def test_absolute_time(spark, label, want):
    assert one(spark, lambda x: times.absolute_time(x, F.col("now")), label) == want


def test_labels_that_only_contain_a_word(spark):
    read = lambda label: one(spark, lambda x: times.relative_time(x, F.col("now")), label)
    assert read("photo from today, 3h") == NOW - dt.timedelta(hours=3)
    assert read("what happened today here") is None
    assert read("yesterday") == NOW - dt.timedelta(days=1)
    assert read("Yesterday at 5:03 PM") == dt.datetime(2024, 1, 31, 17, 3)
    assert read("seen by Ann just now") == NOW


def test_handles(spark):
    for url, want in [
        ("https://h/?id=5", None), ("https://h.example/Groups/x?id=5", "5"), ("https://h.example/J%C3%B6rg/", "Jörg"), ("https://h.example/a+b", "a+b"),
        ("https://h.example/groups/1/user/99/", "99"), ("https://h.example/%zz", None), (None, None),
    ]:
        assert one(spark, urls.handle, url) == want


def test_comment_bodies(spark):
    names = F.array(F.lit("Ann Lee"))
    assert one(spark, lambda x: comments.without_author_lines(x, names), "Ann Lee\nAnn Lee\nhello") == "hello"
    assert one(spark, lambda x: comments.without_author_lines(x, names), "Ann Lee") == "Ann Lee"
    assert one(spark, lambda x: comments.without_author_lines(x, names), None) is None
    body = lambda blocks: one(spark, lambda x: comments.comment_body(x, names), blocks, "array<string>")
    assert body(["Ann Lee", "so  true", "so true", "3h", None]) == "so true"
    assert body(["Ann Lee", "Reply"]) is None and body([]) is None and body(None) is None
    assert one(spark, comments.author_and_age, "Ann Lee 8 hours ago").asDict() == {"name": "Ann Lee", "age": "8 hours ago"}



def test_resolved_time(spark):
    got = one(spark, lambda x: times.resolved_time(x, F.col("now")), ["hello", "2h", "9/8/2023"], "array<string>")
    assert (got["at"], got["approximated"]) == (dt.datetime(2023, 9, 8), False)
    got = one(spark, lambda x: times.resolved_time(x, F.col("now")), ["9/8/2029", "2h"], "array<string>")
    assert (got["at"], got["approximated"]) == (dt.datetime(2024, 2, 1, 10), True)


def test_texts(spark):
    assert one(spark, text.normalized_space, "a  b \n\n\n\n c ") == "a b\n\nc"
    assert one(spark, text.normalized_space, None) == ""
    assert one(spark, text.skeleton, "Élan, 12!") == "élan12"
    assert one(spark, text.hashtags, "#a #b_1 x#a ##c") == ["a", "b_1", "c"]
    for line, chrome in [("All reactions:", True), ("24 reactions 1 share", True), ("12", True), ("3h", True), ("hello there", False)]:
        assert one(spark, text.is_chrome_line, line) is chrome
    assert one(spark, text.slug, "  Hello, World! ") == "hello-world"


def test_urls(spark):
    assert one(spark, urls.clean_url, "https://h.example/p?ref=x&page=2#t") == "https://h.example/p?page=2"
    assert one(spark, urls.clean_url, "no link?ref=x#y") == "no link?ref=x#y"
    for url, want in [("https://h.example/groups/g/user/42/", "42"), ("https://h.example/some.name?x=1", "some.name"), ("https://h.example/profile.php?id=7", "7")]:
        assert one(spark, urls.handle, url) == want
    got = one(spark, urls.post_id, ["https://h.example/watch/?v=12", "https://h.example/groups/g/posts/99/"], "array<string>")
    assert (got["id"], got["pattern"]) == ("99", 0)


IDS = {
    "feed:1:10": "568990e0-a8dc-8987-b914-1a4ef28d88ff", "feed:g7:12345678901": "90140eb3-b5de-89aa-b1f1-d5d4515d0342",
    "https://h.example/groups/g/posts/99/": "c87ae9c9-acf8-8745-9508-1659b484b805", "é☃": "97505296-4f2c-82dc-851f-0599b63aee8c",
    "😀x": "7e0533ed-18a3-8a73-b588-ae9095dcc6f3", "": "92ca2f0e-cb72-870f-8c66-c0248c03471f",
}


def test_record_ids(spark):
    assert record_ids(list(IDS)) == list(IDS.values())
    rows = spark.createDataFrame([(k,) for k in IDS] + [(None,)], "x string").select("x", record_id("x").alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == {**IDS, None: None}


SETTLED = [
    ((0, 0, 0, 0, True), True), ((0, 0, 0, 4, True), True), ((0, 0, 93, 54, True), False), ((53, 1, 54, 54, True), False),
    ((0, 0, 93, 0, True), True), ((0, 0, 0, 10, False), False),
]


def test_settled(spark):
    rows = spark.createDataFrame([c for c, _ in SETTLED], "a int, b int, c int, d int, e boolean")
    got = rows.select(threads.settled(*(F.col(x) for x in "abcde")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [(True, w, w, w) for _, w in SETTLED]


def test_merges(spark):
    rows = spark.createDataFrame(
        [(1, 1, 12, "a", "abc", 1, "g9"), (1, 2, None, None, "abd", 0, "own7"), (1, 3, 40, "b", "abcd", 0, "late5"), (None, 4, 1, "x", "x", 0, "x")],
        "k int, seq int, likes int, name string, caption string, rank int, id string",
    )
    got = merge.merge_readings(rows, "k", "seq", most=["likes"], first=["name"], long=["caption"], ranked={"id": "rank"}).collect()
    assert [tuple(r) for r in got] == [(1, 3, 40, "a", "abcd", "own7")]


def test_streak_is_broken_by_new_rows_only(spark):
    old, new = dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1)
    walk = [old] * 7 + [new] + [old] * 7 + [None, old, new]
    rows = spark.createDataFrame([("r", i, at) for i, at in enumerate(walk)], "run string, pos int, at timestamp")
    left = cutoff.until_streak(rows, "run", "pos", "at", F.lit("2023-01-01").cast("timestamp")).collect()
    assert sorted(r["pos"] for r in left) == [7, 15]


def test_ambiguous_heads_match_nothing(spark):
    long = "abcdefghijklmnopqrstuvwxyz0123456789abcdefghij"
    stories = spark.createDataFrame([(1, long + "x"), (2, long + "y"), (3, "the quick brown fox jumps over the lazy dog again"), (4, "twentyletterslongxx22"), (5, "short")], "id int, text string")
    units = spark.createDataFrame([(10, "zz " + long), (11, "so The quick brown fox, jumps over the lazy dog again!"), (12, "a twentyletterslongxx22 b"), (13, None), (14, "short")], "id int, text string")
    got = resolve.contained_heads(units, "id", "text", resolve.heads_of(stories, "id", "text"), 40).collect()
    assert sorted(tuple(r) for r in got) == [(11, 3), (12, 4)]


def test_thread_merge(spark):
    rows = spark.createDataFrame(
        [("t", "a", "x", 1, 0, 5, None), ("t", "b", "y", 1, 1, 1, None), ("t", "a", "x", 2, 1, 3, NOW), ("t", "c", "z", 2, 0, 1, None)],
        "thread string, who string, text string, seq int, pos int, likes int, at timestamp",
    )
    got = merge.merge_comments(rows, ["thread", "who", "text"], "seq", "pos", "likes", "at").orderBy("place").collect()
    assert [(r["who"], r["likes"], r["at"]) for r in got] == [("c", 1, None), ("a", 5, NOW), ("b", 1, None)]


def test_pages_and_payloads():
    nodes = page_of('<div class=a><p>one<b>two<p>three<br><li>x</div></i><img src="y">', "https://h.example/a/b?c")["nodes"]
    assert [n["tag"] for n in nodes] == ["div", "p", "b", "p", "br", "li", "img"]
    assert all(n["pre"] < n["post"] for n in nodes) and nodes[3]["parent"] in (0, 2) and nodes[6]["href"] == "https://h.example/a/y"
    assert page_of(None) == {"nodes": [], "said": []}
    assert first_json('noise {"a": [1, 2]} tail') == '{"a":[1,2]}' and first_json("[1]") == "[1]" and first_json("{x") is None and first_json(None) is None
    text_ = '{"post_id": 1, "message": {"text": "a"}, "actors": [{"id": "9"}], "kids": [{"message_text": "b"}, {"legacy_story_id": "pfbidX", "post_id": true, "comments": [{"post_id": 3}]}]}'
    assert stories_of(text_) == [("own", "1", "a", None, 0), ("author", "1", None, "9", 1), ("own", "1", "b", None, 2)]
    long = "a text of more than twenty letters"
    shared = {"post_id": 5, "top_level_comments": 3, "comments": {"message": {"text": "an answer " + long}}, "attached_story": {"post_id": 6, "media": [{"message": {"text": "short"}}, {"message_text": long}]}}
    assert stories_of(json.dumps(shared)) == [("shared", "5", long, None, 0)]
    deep = json.dumps({"post_id": 1, "message": {"text": long}})
    for _ in range(400):
        deep = '{"x": [' + deep + "]}"
    assert stories_of(deep) == [("own", "1", long, None, 0)]
    assert stories_of("{") == [] and stories_of(None) == [] and stories_of("3") == []


def test_release_and_budget(spark):
    def reason(*values):
        rows = spark.createDataFrame([values], "waiting boolean, there boolean, owed boolean, age int, waited int")
        return rows.select(threads.release_reason(*(F.col(c) for c in rows.columns)).alias("x")).first()["x"]

    assert reason(False, False, False, 1, 1) == "not_waiting" and reason(True, True, True, 1, 1) == "result"
    assert reason(True, False, False, 10, 61) == "comments:worker_lost" and reason(True, False, False, None, 61) is None
    assert reason(True, False, True, 10, 2_400) == "comments:worker_timeout" and reason(True, False, True, 10, 60) is None
    goals = [one(spark, threads.budget_seconds, n, "int") for n in (5, 100, 400, 0)]
    assert goals == [8, 40, 90, 40]


def test_needles_that_begin_alike_meet_only_what_holds_them(spark):
    """Texts that differ in their last letters only: all tails begin alike, so that their beginnings match every unit."""
    n = 400
    rows = spark.range(n).select(F.col("id").alias("unit"), F.format_string("this text begins as all the others do and ends with %09d", "id").alias("text"))
    bare = rows.select("unit", F.regexp_replace("text", " ", "").alias("bare"))
    needles = bare.select(F.col("unit").alias("id"), F.right("bare", F.lit(40)).alias("needle")).union(spark.createDataFrame([(-1, "asalltheothersdoandends"), (-2, "nowherethereinanyofthem")], "id long, needle string"))
    found = resolve._contained(bare, needles)
    assert sorted((r["unit"], r["id"]) for r in found.collect()) == sorted([(i, i) for i in range(n)] + [(i, -1) for i in range(n)])
    pairs = resolve._met(bare, needles)
    assert pairs.count() <= 4 * n


def test_stories_and_units_do_not_go_through_the_driver(spark):
    """Both are as many as the input has rows; packed they seem small enough to be broadcast."""
    n, most = 400, "spark.sql.maxBroadcastTableSize"
    text = F.format_string("story %09d begins unlike any other and all of them end under number %09d", "id", "id")
    rows = spark.range(n).select(F.col("id").alias("unit"), text.alias("said"), (F.col("id") + n).alias("author"))
    own = rows.select(F.lit("own").alias("kind"), F.col("unit").cast("string").alias("story"), F.col("said").alias("text"), F.lit(None).cast("string").alias("author"), F.struct(F.col("unit").alias("payload"), F.lit(0).alias("place")).alias("ord"))
    silent = own.select(F.lit("author").alias("kind"), F.concat(F.lit("9"), "story").alias("story"), F.lit(None).cast("string").alias("text"), (F.col("ord.payload") + 2 * n).cast("string").alias("author"), "ord")
    units = rows.union(rows.select(F.col("unit") + n, F.lit("hi"), F.col("author") + n))
    spark.conf.set(most, "4k")
    try:
        found = resolve.matched_stories(units, "unit", "said", "author", own.union(silent)).collect()
    finally:
        spark.conf.unset(most)
    assert sorted(map(tuple, found)) == [(i, str(i), "text") for i in range(n)] + [(n + i, f"9{i}", "author") for i in range(n)]
