import datetime as dt
import random
import re

from pyspark.sql import functions as F

from weftline.operators.posts import COMMENT_LINK, POST_LINK, comment_rows, read_units, records, units
from weftline.sources.html import page_of, shown

NOW = dt.datetime(2024, 2, 1, 12)
AGO = {n: NOW - dt.timedelta(hours=n) for n in range(30)}


def pages_of(spark, pages):
    return spark.createDataFrame(pages, "page_id long, html string, url string").repartition(3)


def read(spark, pages):
    return read_units(pages_of(spark, pages), F.lit(NOW.isoformat()).cast("timestamp"))


# --- which nodes are posts, by a walk over the tree


def detected(html):
    """The numbers of the nodes that are posts: parents and children followed one by one."""
    page = page_of(html)
    nodes = page["nodes"]
    kids = {n["node"]: [m for m in nodes if m["parent"] == n["node"]] for n in nodes}
    role = lambda n: n["attrs"].get("role", "")

    def inside(n):
        return [d for k in kids[n["node"]] for d in (k, *inside(k))]

    def above(n):
        while n["parent"] is not None:
            n = nodes[n["parent"]]
            yield n

    def article(n):
        return n["tag"] == "div" and role(n) == "article"

    def href(n):
        return n["attrs"].get("href", "") if n["tag"] == "a" else ""

    def comment(n):
        near = lambda a: next((x for x in (a, *above(a)) if article(x)), None)
        return article(n) and (n["attrs"].get("aria-label", "").lower().startswith("comment by") or any(re.search(COMMENT_LINK, href(a)) and near(a) is n for a in inside(n)))

    def author(n):
        heads = [a for a in inside(n) if href(a) and any(x["tag"] in ("h2", "h3", "h4", "strong") for x in above(a))]
        if heads and heads[0]["text"]:
            return True
        return any(re.match(r"/[A-Za-z0-9.\-]+/?(?:\?|$)", href(a)) and not re.search(POST_LINK, href(a)) and 1 < len(a["text"]) < 80 and not re.match(r"\d", a["text"]) for a in inside(n))

    def text(n):
        return shown("".join(p["text"] for p in page["said"][n["first"] : n["after"]]))

    feed = next((n for want in ("feed", "main") for n in nodes if n["tag"] == "div" and role(n) == want), None) or next((n for n in nodes if n["tag"] == "body"), None)
    scope = inside(feed) if feed else nodes
    tops = kids[feed["node"]] if feed else [n for n in nodes if n["parent"] is None]
    pool = [n for n in scope if article(n) and not comment(n)] + [n for n in tops if n["tag"] == "div"]
    for a in scope:
        if re.search(POST_LINK, href(a)):
            pool += [n for n in (a, *above(a)) if n in tops]
    pool = [nodes[i] for i in sorted({n["node"] for n in pool})]

    def looks(n):
        if role(n) == "feed" or comment(n) or any(x["tag"] == "div" and role(x) == "dialog" for x in (n, *above(n))):
            return False
        if "content isn't available right now" in text(n) and len(text(n)) < 60:
            return False
        return any(re.search(POST_LINK, href(a)) for a in inside(n)) or len(text(n)) > 40 and author(n)

    pool = [n for n in pool if looks(n)]

    def region(n):
        direct = [m for m in inside(n) if article(m) and not comment(m) and next(x for x in above(m) if article(x)) is n]
        return any(m["tag"] == "div" and role(m) == "feed" for m in inside(n)) or len(direct) >= 2

    pool = [n for n in pool if not (article(n) and any(article(o) and n in inside(o) and not region(o) for o in pool))]
    return [n["node"] for n in pool if not any(o in inside(n) for o in pool)]


def random_page(rng):
    def part(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.25:
            return rng.choice(["word ", "a text that is long enough to be a post of its own ", '<a href="/groups/7/posts/5/">3h</a>', '<a href="/ann.lee">Ann Lee</a>', '<a href="/x?comment_id=4">re</a>', '<h3><a href="/bo">Bo</a></h3>', '<strong><a href="/c"></a></strong>'])
        tag = rng.choice(["div"] * 5 + ["section", "span"])
        attrs = rng.choice(["", "", "", ' role="article"', ' role="article"', ' role="article"', ' role="article" aria-label="Comment by X"', ' role="dialog"', ' role="feed"'][: 8 + (depth > 1)])
        return f"<{tag}{attrs}>" + "".join(part(depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    body = "".join(part(1) for _ in range(rng.randint(1, 5)))
    return rng.choice(["<html><body>{}</body></html>", '<body><nav>x</nav><div role="main">{}</div></body>', '<div role="feed">{}</div>', "{}"]).format(body)


def test_posts_like_a_tree_walk(spark):
    rng = random.Random(8)
    pages = [(i, random_page(rng), "https://h.example/groups/7/") for i in range(250)]
    got = {}
    for r in units(pages_of(spark, pages)).select("page_id", "unit").collect():
        got.setdefault(r["page_id"], []).append(r["unit"])
    want = {i: detected(html) for i, html, _ in pages}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert sum(map(len, want.values())) > 150 and any(len(x) > 1 for x in want.values())


def test_placeholders_are_no_posts(spark):
    gone = "<div role=article><a href='/groups/7/posts/1/'>x</a><p>This content isn't available right now</p></div>"
    assert units(pages_of(spark, [(1, f"<div role=feed>{gone}</div>", None)])).count() == 0


# --- when a post was published


def post(*inside):
    return '<div role="feed"><div role="article">' + "".join(inside) + "</div></div>"


HEAD = '<h3><a href="/ann">Ann Lee</a></h3>'
LINK = '<a href="/groups/7/posts/5/">{}</a>'
UTIME = '<abbr data-utime="1700000000"></abbr>'


def test_time_ladder(spark):
    body = '<div dir="auto">a body that is quite long, with words of all kinds</div>'
    cases = [
        (post(HEAD, LINK.format("3h"), UTIME, body), (AGO[3], "header", True)),
        (post(HEAD, body, UTIME, LINK.format("3h")), (AGO[3], "header", True)),
        (post(HEAD, '<div dir="auto"><a href="/tag">2h</a> said in the body</div>', UTIME, LINK.format("5h")), (dt.datetime(2023, 11, 14, 22, 13, 20), "utime", False)),
        (post(HEAD, '<a href="/bo">Bo Original</a>', LINK.format("5h"), UTIME), (dt.datetime(2023, 11, 14, 22, 13, 20), "utime", False)),
        (post(HEAD, '<div role="button"><a href="/x/y">2h</a></div>', '<span tabindex="0" aria-label="4 hours ago">.</span>', body), (AGO[4], "header", True)),
        (post(HEAD, '<time datetime="2024-01-05T10:00:00Z">x</time>', body), (dt.datetime(2024, 1, 5, 10), "own", False)),
        (post(HEAD, '<div role="article" aria-label="Comment by Bo"><a href="/z?comment_id=1">1h</a></div>', body), (None, "missing", False)),
        (post(LINK.format("<span>Ann</span> 6h"), body), (AGO[6], "own", True)),
        (post("<h3>Ann Lee</h3>", LINK.format("no time"), "<div>7 hours</div>", body), (AGO[7], "body", True)),
        (post(HEAD, '<span>8h</span>', body), (AGO[8], "body", True)),
        (post(HEAD, LINK.format("December 31, 2031"), body), (None, "unresolved", False)),
        (post(HEAD, '<div dir="auto">nothing here to tell the hour by, only long words</div>'), (None, "missing", False)),
    ]
    got = read(spark, [(i, html, "https://h.example/groups/7/") for i, (html, _) in enumerate(cases)]).select("page_id", "published.*").collect()
    assert {r["page_id"]: (r["at"], r["source"], r["approximated"]) for r in got} == {i: want for i, (_, want) in enumerate(cases)}


# --- records


def test_records_of_odd_pages(spark):
    block = lambda x: f'<div dir="auto">{x}</div>'
    nested = f'<div role="article"><h3>Ann Lee</h3>{LINK.format("x")}{block("a post about something")}<div role="article" aria-label="Comment by Bo">{block("first")}</div>'
    nested += f'<div role="article" aria-label="Comment by Cy 2 hours ago">{block("Cy")}{block("a reply")}</div><div role="article" aria-label="Comment by Di"></div></div>'
    signed = '<div role="article"><b><a href="/ed">Ed Poe</a></b> {}</div>'
    pages = [
        (1, nested, "https://h.example/groups/7/"), (2, "<p>no article</p>", None), (3, None, None), (4, '<div role="article"></div>', None), (8, "", "x"),
        (5, f'<div role="dialog">{nested}</div>', None), (6, signed.format("a text without end <b>x and still more of the same"), "https://h.example/groups/7/"),
        (6, signed.format("another page of the same number, told apart"), "https://h.example/groups/7/"), (7, signed.format("on a page that has no link of its own at all"), None),
    ]
    rows = read(spark, pages)
    got = {}
    for r in records(rows, cap=1).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert set(got) == {1, 6, 7} and len(got[6]) == 2
    one = got[1][0]
    assert one["author"]["name"] == "Ann Lee" and one["caption"] == "a post about something" and one["key"] == "https://h.example/groups/7/posts/5/"
    assert one["alt_keys"] == ["Ann Lee::a post about something"] and [c["text"] for c in one["comments"]] == ["first"] and not one["comments_complete"]
    assert "comments:capped" in one["warnings"] and "comments:dropped_without_text" not in one["warnings"]
    assert {r["caption"] for r in got[6]} == {"a text without end x and still more of the same", "another page of the same number, told apart"} or all("Ed Poe" in r["caption"] for r in got[6])
    assert got[7][0]["source_url"] is None and got[7][0]["record_id"] is None and "captureId:random" in got[7][0]["warnings"]
    said = {(r["author"], r["text"], r["at"], r["said_at"]) for r in comment_rows(rows).collect()}
    assert said == {("Bo", "first", None, None), ("Cy", "a reply", AGO[2], "2 hours ago")}
    whole = {r["page_id"]: r for r in records(rows, cap=9).collect()}
    assert "comments:dropped_without_text" in whole[1]["warnings"] and "comments:capped" not in whole[1]["warnings"]


def test_likes_and_pictures(spark):
    block = '<div dir="auto">a text that is said here and that has no end</div>'
    pile = '<div role="button"><span aria-label="See who reacted to this"><i></i></span><span>41</span></div>'
    img = lambda w, src, more="": f'<img src="{src}" width="{w}" height="200"{more}>'
    cases = {
        1: (pile, 41, None), 2: ("<div>All reactions:</div><div>1.2K</div>" + pile, 1_200, None), 3: ('<i aria-label="Like: 3 people"></i><i aria-label="Love: 4 people"></i>', 7, None),
        4: ('<div role="button" aria-label="Like"><span>9</span></div><i aria-label="Like: 3 people"></i>', 9, None), 5: ("", None, None),
        6: (img(100, "/a.jpg") + img(300, "b.jpg") + img(300, "/c.jpg"), None, "https://h.example/groups/7/b.jpg"), 7: (img(20, "/a.jpg") + img("", "/free.jpg"), None, "https://h.example/free.jpg"),
        8: ('<video poster="/v.jpg"></video>' + img(300, "/b.jpg"), None, "/v.jpg"), 9: (f'<div role="button">{img(900, "/a.jpg")}</div>{img(300, "data:x")}', None, None),
    }
    got = read(spark, [(i, post(HEAD, block, x), "https://h.example/groups/7/") for i, (x, _, _) in cases.items()]).select("page_id", "metrics.likes", "thumbnail").collect()
    assert {r["page_id"]: (r["likes"], r["thumbnail"]) for r in got} == {i: (n, t) for i, (_, n, t) in cases.items()}


def test_pages_of_one_file_are_read_by_all_cores(spark):
    pages = pages_of(spark, [(i, '<div role="article"><h3><a href="/A">Ann</a></h3><a href="/groups/7/posts/5/">5h</a></div>', "https://h.example/groups/7/") for i in range(40)])
    found = units(pages.coalesce(1))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["page_id"] for r in found.collect()) == list(range(40))
