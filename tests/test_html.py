import random
import re
from urllib.parse import urljoin

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import urls
from weftline.sources.html import BLOCKS, BREAKS, VOID, block_text, joined, node_table, page_of, parse_batches, titles


def grown(rng, depth=0):
    """A tree: (tag, hidden, children), children being trees or texts."""
    tag = rng.choice(["div", "ul", "h2", "blockquote", "section", "b", "i", "a", "span", "br", "script", "figcaption"]) if depth else "html"
    kids = [grown(rng, depth + 1) if depth < 5 and rng.random() < 0.6 else rng.choice([" ", "t", "\n two\t", "&nbsp;x ", "see more"]) for _ in range(rng.randint(0, 4))]
    kids = [] if tag in VOID else ["x()"] if tag == "script" else kids
    return tag, depth > 0 and rng.random() < 0.1, [k for k, before in zip(kids, [None, *kids], strict=False) if not (isinstance(k, str) and isinstance(before, str))]


def markup(tree):
    if isinstance(tree, str):
        return tree
    return f"<{tree[0]}{' hidden' * tree[1]}>" + ("" if tree[0] in VOID else f"{''.join(map(markup, tree[2]))}</{tree[0]}>")


def raw(tree):
    """What a tree shows: its texts, with breaks around blocks; hidden parts and scripts show nothing."""
    out = ""
    for kid in tree[2]:
        if isinstance(kid, str):
            out += re.sub(r"\s+", " ", kid.replace("&nbsp;", " "))
        else:
            inner = "" if kid[1] or kid[0] == "script" else raw(kid)
            out += f"\n{inner}\n" if kid[0] in BREAKS else inner
    return out


def shown(text):
    lines = [line.strip() for line in re.sub("[ \t ]+", " ", text).split("\n")]
    return re.sub(r"(?i)\s*see (?:more|less)\Z", "", re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip())


def blocks(tree, tags, seen=True):
    if isinstance(tree, str):
        return []
    seen = seen and not tree[1] and tree[0] != "script"
    own = [(tree[0], shown(raw(tree)) if seen else "")] if tree[0] in tags else []
    return own + [b for k in tree[2] for b in blocks(k, tags, seen)]


def found(spark, pages, **options):
    rows = block_text(spark.createDataFrame(pages, "page_id long, html string").repartition(3), **options).collect()
    return {p: [(r["tag"], r["text"]) for r in sorted(rows, key=lambda r: r["start"]) if r["page_id"] == p] for p, _ in pages}


def test_nested_and_trailing_text(spark):
    page = "<ul><li>intro <p>x</p> <b>tail</b></li><li>two</ul><div>a<br>b<!-- c -->&amp; c<table><td>d</table>e</div><p></p>out"
    got = found(spark, [(1, page), (2, None), (3, "<p>one")])
    assert got[1] == [
        ("ul", "intro\nx\ntail\n\ntwo"), ("li", "intro\nx\ntail"), ("p", "x"), ("li", "two"), ("div", "a\n\nb& c\n\nd\n\ne"), ("table", "d"), ("td", "d"), ("p", ""),
    ]
    assert got[2] == [] and got[3] == [("p", "one")]


def test_like_tree_walk(spark):
    rng = random.Random(5)
    trees = {i: grown(rng) for i in range(60)}
    pages = [(i, markup(t)) for i, t in trees.items()]
    assert found(spark, pages) == {i: blocks(t, BLOCKS) for i, t in trees.items()}
    assert found(spark, pages, tags=("b", "h2")) == {i: blocks(t, ("b", "h2")) for i, t in trees.items()}


@pytest.mark.parametrize("base", ["https://h.example/groups/7/?a=b#c", "http://h.example", "https://h.example/a/b.html"])
def test_links_are_resolved(spark, base):
    links = ["/x?y=1", "//other.example/z", "https://a.example/q#f", "?p=2", "#top", "leaf/two", "mailto:a@b.example"]
    rows = spark.createDataFrame([(x, base) for x in links], "x string, b string").select("x", urls.resolved(F.col("x"), F.col("b")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == {x: urljoin(base, x) for x in links} == {x: joined(base, x) for x in links}


def test_relative_links_are_cleaned(spark):
    cleaned = urls.clean_url(F.lit("/groups/7/posts/5/?ref=x&a=1#c"), F.lit("https://h.example/groups/7/"))
    assert spark.range(1).select(cleaned.alias("y")).first()["y"] == "https://h.example/groups/7/posts/5/?a=1"


def test_few_pages_are_read_together():
    pages = [f'<div id="{i}"><a href="/{i}">link {i}</a></div>' for i in range(500)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(502)), pa.array(["https://h.example/"] * 502), pa.array(pages)], names=["id", "url", "html"])
    got = list(parse_batches(iter([batch]), held_chars=1_000))
    assert len(got) > 15 and max(b.num_rows for b in got) < 40
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == list(range(502))
    for row, html in zip(rows, pages, strict=True):
        want = page_of(html, "https://h.example/")
        assert row["said"] == want["said"]
        assert [{**n, "attrs": dict(n["attrs"])} for n in row["nodes"]] == want["nodes"]


def test_titles_resolve_the_references_asked_for(spark):
    pages = spark.createDataFrame([(1, "<html><head><title> a &quot;b&quot;  &lt;c&amp</title></head><p>x")], "page_id long, html string")
    nodes = node_table(pages)
    assert titles(nodes).first()["title"] == 'a "b" <c&'
    assert titles(nodes, {"&lt;": "<", "&gt;": ">", "&amp;": "&"}).first()["title"] == "a &quot;b&quot; <c&amp"
