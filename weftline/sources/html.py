"""Landed pages as tables of nodes with nested-set numbers, so that `inside` is a range of numbers.

The parser only numbers things: which nodes and which pieces of text stand inside a node, and its nearest nodes of some kinds
above. What a page says is read from these numbers by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import read_text

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Tags that end an open one of the first kind.
CLOSES = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
# A paragraph outside one of these is not ended by what stands inside.
SCOPES = frozenset("button caption html marquee object table td template th".split())
BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
# Tags with a line break before and behind them.
BREAKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)
UNSEEN = frozenset("head noscript script style template title".split())
HEADINGS = frozenset(("h2", "h3", "h4"))
INT, TEXT = T.IntegerType(), T.StringType()
NODE = (
    T.StructType()
    .add("node", INT).add("parent", INT).add("grand", INT)  # the parent's parent
    .add("end", INT)  # the number behind the last node inside
    .add("pre", INT).add("post", INT).add("depth", INT).add("tag", TEXT).add("attrs", T.MapType(TEXT, TEXT)).add("own_text", TEXT)
    .add("raw", TEXT)  # of a closed title: what stands between its tags, references unresolved
    .add("text", TEXT)  # inside it, as a browser shows it; null for plain containers
    .add("href", TEXT)  # of a link, or the source of a picture: resolved against the page's link
    .add("first", INT).add("after", INT)  # of the page's pieces of text, those inside
    .add("article", INT).add("outer", INT)  # nearest div with role article: itself included, or only above
    .add("heading", INT).add("strong", INT).add("control", INT).add("press", INT).add("auto", INT)  # nearest, itself included
    .add("dialog", T.BooleanType()).add("box_leaf", T.BooleanType()).add("auto_leaf", T.BooleanType())  # in a dialog; no div or span inside, no dir=auto inside
)
PAGE = T.StructType().add("nodes", T.ArrayType(NODE)).add("said", T.ArrayType(T.StructType().add("text", TEXT).add("article", INT)))
NEAREST = ("article", "outer", "heading", "strong", "control", "press", "auto", "dialog")


READ_TAGS, READ_ROLES = frozenset("a abbr h2 h3 h4 span strong time".split()), frozenset(("button", "link"))
READ_ATTRS = frozenset("aria-label data-ad-comet-preview data-ad-preview data-testid dir tabindex title".split())


def shown(text: str) -> str:
    """White space normalised, and a control at the end that shows or hides the rest cut off; `read_text` of columns."""
    lines = [line.strip() for line in re.sub("[ \t\u00a0]+", " ", text).split("\n")]
    return re.sub(r"(?i)\s*See (?:more|less)\Z", "", re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip())


def joined(base: str | None, link: str) -> str:
    """A link resolved against a page's; what can't be resolved stays as it is."""
    try:
        return urljoin(base or "", link.strip())
    except ValueError:
        return link


class _Nodes(HTMLParser):
    """Tolerant: unclosed tags end with their parents, stray end tags count for nothing."""

    def __init__(self, url: str | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.url = url
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.clock = 0
        self.said: list[list] = []  # text, and the nearest article around it
        self.running = False  # the last piece can still grow: no tag has ended it
        self.unseen = 0  # open nodes whose text is not shown
        self.title_at = 0  # where the text of the last title begins

    def _tick(self) -> int:
        self.clock += 1
        return self.clock

    def _say(self, text: str, article: int | None) -> None:
        if not self.unseen:
            if self.running:
                self.said[-1][0] += text
            else:
                self.said.append([text, article])

    def _end(self) -> None:
        row = self.open.pop()
        row["post"], row["end"], row["after"], self.running = self._tick(), len(self.rows), len(self.said), False
        self.unseen -= row.pop("unseen")
        if self.open:
            up = self.open[-1]
            up["box_leaf"] &= row["box_leaf"] and row["tag"] not in ("div", "span")
            up["auto_leaf"] &= row["auto_leaf"] and row["attrs"].get("dir") != "auto"
        own = row["attrs"]
        if row["tag"] in READ_TAGS or row["box_leaf"] and row["tag"] == "div" or own.get("role", "").lower() in READ_ROLES or not READ_ATTRS.isdisjoint(own):
            row["text"] = shown("".join([t for t, _ in self.said[row["first"] : row["after"]]]))
        if row["tag"] in BREAKS:
            self._say("\n", row["outer"])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:  # ends a paragraph, whatever bold or linked text is open in it
            for row in reversed(self.open):
                if row["tag"] == "p":
                    while self.open[-1] is not row:
                        self._end()
                    self._end()
                if row["tag"] in SCOPES or row["tag"] == "p":
                    break
        while self.open and self.open[-1]["tag"] in CLOSES.get(tag, ()):
            self._end()
        known, up, number = {k: v or "" for k, v in attrs}, self.open[-1] if self.open else None, len(self.rows)
        near = {k: up[k] if up else None for k in NEAREST}
        self.running = False
        if tag in BREAKS:
            self._say("\n", near["article"])
        self.running, near["outer"], role = False, near["article"], known.get("role", "").lower()
        if role == "article" and tag == "div":
            near["article"] = number
        for kind, here in (("heading", tag in HEADINGS), ("strong", tag == "strong"), ("control", role in ("button", "toolbar")), ("press", role in ("button", "link")), ("auto", known.get("dir") == "auto")):
            near[kind] = number if here else near[kind]
        near["dialog"] = bool(near["dialog"]) or role == "dialog" and tag == "div"
        link = known.get("href") if tag == "a" else known.get("src") if tag == "img" else None
        unseen = int(tag in UNSEEN or "hidden" in known)
        self.rows.append({
            "node": number, "parent": up and up["node"], "grand": up and up["parent"], "end": None, "pre": self._tick(), "post": None, "depth": len(self.open), "tag": tag, "attrs": known,
            "own_text": "", "raw": None, "text": None, "href": None if link is None else joined(self.url, link), "first": len(self.said), "after": None, **near, "box_leaf": True, "auto_leaf": True, "unseen": unseen,
        })
        self.open.append(self.rows[-1])
        self.unseen += unseen
        if tag in VOID:
            self._end()

    def parse_starttag(self, i: int) -> int:
        end = super().parse_starttag(i)
        if end > 0 and self.open and self.open[-1]["tag"] == "title":
            self.title_at = end
        return end

    def parse_endtag(self, i: int) -> int:
        if self.open and self.open[-1]["tag"] == "title":
            self.open[-1]["raw"] = self.rawdata[self.title_at : i]
        return super().parse_endtag(i)

    def handle_endtag(self, tag: str) -> None:
        if any(row["tag"] == tag for row in self.open):
            while self.open[-1]["tag"] != tag:
                self._end()
            self._end()

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1]["own_text"] += data
            self._say(re.sub(r"\s+", " ", data), self.open[-1]["article"])
            self.running = not self.unseen


def page_of(html: str | None, url: str | None = None) -> dict:
    """{nodes, said}: nodes in document order and the pieces of text between tags, with a line break where a block begins or ends."""
    parser = _Nodes(url)
    parser.feed(html or "")
    parser.close()
    while parser.open:
        parser._end()
    return {"nodes": parser.rows, "said": [{"text": t, "article": a} for t, a in parser.said]}


HELD_CHARS = 500_000  # of pages whose nodes are held together, if more than one
TASKS_A_CORE = 4
_ARROW = {INT: pa.int32(), TEXT: pa.string(), T.BooleanType(): pa.bool_()}


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values)


def _structs(rows: list[dict], kind: T.StructType) -> pa.Array:
    def column(field: T.StructField) -> pa.Array:
        if field.dataType in _ARROW:
            return pa.array([r[field.name] for r in rows], _ARROW[field.dataType])
        maps = [r[field.name] for r in rows]
        ends = pa.array([0, *accumulate(map(len, maps))], pa.int32())
        return pa.MapArray.from_arrays(ends, pa.array([k for m in maps for k in m], pa.string()), pa.array([v for m in maps for v in m.values()], pa.string()))

    return pa.StructArray.from_arrays([column(f) for f in kind], names=kind.fieldNames())


def arrow_pages(found: list[dict]) -> list[pa.Array]:
    """The columns of PAGE for some pages as `page_of` reads them."""
    return [_lists([len(x[f.name]) for x in found], _structs([r for x in found for r in x[f.name]], f.dataType.elementType)) for f in PAGE]


def parse_batches(batches: Iterator[pa.RecordBatch], held_chars: int = HELD_CHARS) -> Iterator[pa.RecordBatch]:
    """(id, url, html) to (page_id, page_url, nodes, said). The nodes of a page take many times its room, so that a few pages are read at a time
    however many Spark sends together."""
    for batch in batches:
        ids, links, pages = batch.columns
        found, size, first = [], 0, 0
        for row in range(batch.num_rows):
            html = pages[row].as_py()
            found.append(page_of(html, links[row].as_py()))
            size += len(html or "")
            if size >= held_chars or row + 1 == batch.num_rows:
                n = len(found)
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), links.slice(first, n), *arrow_pages(found)], names=["page_id", "page_url", *PAGE.fieldNames()])
                found, size, first = [], 0, row + 1


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores, however few files and row groups they come from: for work that takes milliseconds a row."""
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def parsed_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """page_id, page_url, nodes, said. Each row is a page of its own, also where ids repeat; null or empty pages have no nodes."""
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    asked = pages.select(F.col(id_col).alias("page_id"), url.alias("page_url"), F.col(html_col).cast("string").alias("html"))
    kind = T.StructType([T.StructField("page_id", asked.schema["page_id"].dataType), T.StructField("page_url", TEXT), *PAGE.fields])
    return asked.mapInArrow(parse_batches, kind)


def node_table(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = None) -> DataFrame:
    """page_id and the columns of NODE, one row a node."""
    return parsed_pages(pages, id_col, html_col, url_col).select("page_id", F.explode_outer("nodes").alias("x")).select("page_id", "x.*").where("node is not null")


def pieces(said: Column, node: Column, base: Column | int = 0) -> Column:
    """The pieces of text inside a node; `said` begins with piece `base` of the page."""
    return F.slice(said, node["first"] - base + 1, node["after"] - node["first"])


def text_inside(said: Column, node: Column, base: Column | int = 0) -> Column:
    """A node's text as a browser shows it: line breaks around blocks, no hidden nodes, white space made single."""
    return read_text(F.array_join(F.transform(pieces(said, node, base), lambda p: p["text"]), ""))


def anchors(nodes: DataFrame) -> DataFrame:
    return nodes.where("tag = 'a' and attrs['href'] is not null").select("page_id", "node", "pre", F.col("attrs")["href"].alias("href"), "own_text")


def block_text(pages: DataFrame, tags: tuple[str, ...] = tuple(sorted(BLOCKS)), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, start, tag, text: of each node of these tags, the text inside it. Text counts for every block around it.

    A page stays one row until its blocks are read: inside a node stand consecutive pieces of its page's text.
    """
    read = parsed_pages(pages, id_col, html_col, None)
    blocks = F.filter("nodes", lambda n: n["tag"].isin(*tags))
    found = F.transform(blocks, lambda n: F.struct(n["pre"].alias("start"), n["tag"].alias("tag"), text_inside(F.col("said"), n).alias("text")))
    return read.select("page_id", F.explode_outer(found).alias("x")).select("page_id", "x.*").where("start is not null")


def titles(nodes: DataFrame, references: dict[str, str] | None = None) -> DataFrame:
    """page_id, title: the text of a page's first title node, white space made single; pages without one are left out. Character references are
    resolved as browsers do, or only those given, one after the other."""
    said = F.col("own_text") if references is None else F.coalesce("raw", "own_text")
    first = nodes.where("tag = 'title'").groupBy("page_id").agg(F.min_by(said, "pre").alias("title"))
    title = F.trim(F.regexp_replace("title", r"\s+", " "))
    for name, letter in (references or {}).items():
        title = F.replace(title, F.lit(name), F.lit(letter))
    return first.select("page_id", title.alias("title"))
