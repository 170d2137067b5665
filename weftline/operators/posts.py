"""Posts of landed pages: which nodes are posts, and one record for each.

A page stays one row until its posts are known, and a post is one row with the nodes and pieces of text inside it: all is read
in place, nothing is shuffled but the pages themselves over all cores, and pages whose ids repeat stay apart. Nodes lie in document order, so that what is inside a node is
a slice, and every fact is one pass over a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import comments, text, times, urls
from weftline.functions.counts import parsed_count
from weftline.functions.ids import record_id
from weftline.functions.times import bound
from weftline.sources.html import NODE, parsed_pages, pieces, spread, text_inside

# Kinds of links.
COMMENT_LINK = r"comment_id=|/comment/"
POST_LINK = r"/(?:groups/[^/]+/(?:posts|permalink)/|permalink\.php|story\.php|photo(?:\.php)?/|watch/?\?v=|videos/|reel/)"
GROUP_LINK = r"/groups/[^/]+/?$"
PROFILE_PATH = r"/(?:profile\.php\?id=\d+|groups/[^/]+/user/\d+|[A-Za-z0-9.\-]+/?(?:\?|$))"
TIME_LINK = r"multi_permalinks=|story_fbid=|[?&]fbid=|/groups/[^/]+/(?:posts|permalink)/"
OWN_POST = rf"/groups/[^/]+/(?:posts|permalink)/{urls.POST_ID}"
# Counts, what the label of a button says about the bare number in it, and labels of an emoji pile.
NUMBER = r"([\d.,]+\s*[KkMm]?)\s*"
BARE_COUNT = r"^[\d.,]+\s*[KkMm]?$"
TALLY = rf"(?i)^(?:like|love|care|haha|wow|sad|angry):\s*{NUMBER}(?:person|people)\b"
PILE = r"(?i)reaction|Like:|see who reacted"
COUNT_LABELS = {
    "likes": r"(?i)reaction|^like:|^like$",
    "comments": r"(?i)^(?:leave a )?comments?$",
    "shares": r"(?i)^(?:share|send this to friends)",
    "views": r"(?i)\bviews?\b",
}
# Controls that show more of a thread.
MORE = (
    r"(?i)(view|see)\s+(all|more|previous|[\d.,]+[km]?)\s*(more\s+)?comments?|more comments|previous comments",
    r"(?i)(view|see)\s+(all\s+)?([\d.,]+[km]?\s+)?(more\s+|previous\s+)?repl(y|ies)|[\d.,]+[km]?\s+(more\s+|previous\s+)?repl(y|ies)",
    r"(?i)(view|see|show)\s+(all\s+)?([\d.,]+[km]?\s+)?hidden\s+(comments?|repl(y|ies))|[\d.,]+[km]?\s+hidden\s+(comments?|repl(y|ies))",
)
# The patterns of `urls.post_id` that name a post itself; those after them name what is attached to one.
OWN_PATTERNS = 4
LEAST_PICTURE = 100 * 100


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _known(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def _attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def _inside(nodes: Column, node: Column, first: Column | int = 0) -> Column:
    """The nodes inside a node; `nodes` begins with node `first` of the page."""
    return F.slice(nodes, node["node"] - first + 2, node["end"] - node["node"] - 1)


def _below(kind: Column, unit: Column) -> Column:
    """Whether the nearest node of a kind is the unit or inside it."""
    return F.coalesce(kind >= unit, F.lit(False))


def _last_line(value: Column) -> Column:
    return F.element_at(F.split(value, "\n", -1), -1)


def is_profile(href: Column, host: Column) -> Column:
    """Whether a link of the host (null: any) leads to a profile. On a page without link its links are paths."""
    there = F.regexp_extract(href, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(href, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?(/.*)", 1)
    return path.rlike("^" + PROFILE_PATH) & F.coalesce(there == host, F.lit(True))


#: Where a node may say a time: the places of `times`.
DATETIME, LABEL, TITLE, TOOLTIP, LAST_LINE, WHOLE, SECONDS = range(7)


def noted(nodes: Column, host: Column) -> Column:
    """The nodes with what is asked for again and again: role, label, kinds of links, and what of a node may be a time and whether it
    reads like one, by place."""
    def note(n: Column) -> Column:
        role, label, raw = F.lower(F.coalesce(_attr(n, "role"), F.lit(""))), F.coalesce(_attr(n, "aria-label"), F.lit("")), _attr(n, "href")
        link = (n["tag"] == "a") & raw.isNotNull()
        carrier = link | (role == "link") | (n["tag"].isin("span", "div") & _attr(n, "tabindex").isNotNull())
        speaks = link | (role == "link") | n["tag"].isin("span", "time", "abbr") | _attr(n, "aria-label").isNotNull() | _attr(n, "title").isNotNull()
        lines = F.when(F.contains(n["text"], F.lit("\n")), n["text"])  # else the whole is the last line
        places = F.array(*(F.nullif(x, F.lit("")) for x in (*(_attr(n, a) for a in ("datetime", "aria-label", "title", "data-tooltip-content")), _last_line(n["text"]), lines, _attr(n, "data-utime"))))
        candidate = lambda c: F.struct(c.alias("said"), F.coalesce(times.looks_like_time(c), F.lit(False)).alias("like"))
        read = F.transform(places, lambda x: F.when(x.isNotNull(), F.transform(times.label_candidates(x), candidate)))
        kinds = {"to_post": POST_LINK, "to_comment": COMMENT_LINK, "to_time": TIME_LINK, "to_group": GROUP_LINK}
        flags = (F.coalesce(link & raw.rlike(pattern), F.lit(False)).alias(name) for name, pattern in kinds.items())
        kept = (c for c in NODE.fieldNames() if c not in ("parent", "outer", "dialog", "own_text", "raw"))
        return F.struct(
            *(n[c].alias(c) for c in kept), n["parent"].alias("parent"), n["outer"].alias("outer"), n["dialog"].alias("dialog"), F.trim(n["own_text"]).alias("own_text"),
            role.alias("role"), label.alias("label"), link.alias("link"), *flags, F.coalesce(link & is_profile(n["href"], host), F.lit(False)).alias("to_profile"),
            carrier.alias("carrier"), speaks.alias("speaks"), (n["article"] == n["node"]).alias("is_article"), F.when(carrier | speaks, read).alias("times"),
        )

    return F.transform(nodes, note)


def author_link(inside: Column) -> Column:
    """The link that names a unit's author: the first in a heading or in bold type, if it has text; else the first link to a profile
    with 2 to 79 letters that begin with no digit. Null without one."""
    def named(n: Column) -> Column:
        return n["to_profile"] & ~n["to_post"] & ~n["to_group"] & F.length(n["text"]).between(2, 79) & ~n["text"].rlike(r"^\d")

    head = F.slice(F.filter(inside, lambda n: n["link"] & (n["heading"].isNotNull() | n["strong"].isNotNull())), 1, 1)
    found = F.concat(F.filter(head, lambda n: n["text"] != ""), F.slice(F.filter(inside, named), 1, 1))
    return _first(F.transform(found, lambda n: F.struct(*(n[c].alias(c) for c in ("node", "end", "href", "heading", "strong", "text")))))


def feed_of(nodes: Column) -> Column:
    """The number of the node that holds the posts: the first feed, else the first main part, else the body; -1 is the page."""
    def first(when) -> Column:
        return _first(F.filter(nodes, when))["node"]

    role = lambda name: lambda n: (n["tag"] == "div") & (n["role"] == name)
    return F.coalesce(first(role("feed")), first(role("main")), first(lambda n: n["tag"] == "body"), F.lit(-1))


def comment_articles(nodes: Column) -> Column:
    """The numbers of articles that are comments: by their label, or by a link to a comment whose nearest article they are."""
    labelled = F.filter(nodes, lambda n: n["is_article"] & n["label"].rlike("(?i)^comment by"))
    linked = F.filter(nodes, lambda n: n["to_comment"] & n["article"].isNotNull())
    return F.array_distinct(F.concat(F.transform(labelled, lambda n: n["node"]), F.transform(linked, lambda n: n["article"])))


def post_nodes(nodes: Column, said: Column, feed: Column, commented: Column) -> Column:
    """The nodes that are posts, in document order.

    Three ways find candidates inside the feed: articles that are no comments; boxes directly in the feed; and, for each link to a post,
    the node around it directly in the feed. Those that look like posts and are in no dialog stay. An article inside another is
    part of it, unless the outer one is a region of a feed; of the rest, what contains another is a container.
    """
    def looks(links: Column):
        def wanted(n: Column) -> Column:
            child = F.coalesce(n["parent"], F.lit(-1)) == feed
            article = n["is_article"] & ~F.array_contains(commented, n["node"])
            holds = F.exists(links, lambda x: (x >= n["node"]) & (x < n["end"]))
            within = (n["node"] > feed) & ((feed < 0) | (n["node"] < F.get(nodes, feed)["end"])) & ~n["dialog"]
            return within & (article | (child & ((n["tag"] == "div") | holds)))

        def fits(n: Column) -> Column:
            def read(x: Column) -> Column:
                gone = F.coalesce(comments.is_tombstone(x["whole"], text.first_line(x["link"]["text"])), F.lit(False))
                count = F.size(F.filter(links, lambda y: (y > n["node"]) & (y < n["end"])))
                return comments.looks_like_post(n["role"], F.array_contains(commented, n["node"]), gone, count, x["whole"], x["link"].isNotNull())

            return bound(F.struct(text_inside(said, n).alias("whole"), author_link(_inside(nodes, n)).alias("link")), read)

        return F.filter(nodes, lambda n: F.coalesce(wanted(n), F.lit(False)) & fits(n))

    def region(o: Column) -> Column:
        feeds = F.exists(_inside(nodes, o), lambda m: (m["tag"] == "div") & (m["role"] == "feed"))
        parts = F.filter(_inside(nodes, o), lambda m: m["is_article"] & (m["outer"] == o["node"]) & ~F.array_contains(commented, m["node"]))
        return feeds | (F.size(parts) >= 2)

    def contains(o: Column, c: Column) -> Column:
        return (o["node"] < c["node"]) & (c["node"] < o["end"])

    def outer(pool: Column) -> Column:
        closed = F.filter(pool, lambda o: F.coalesce(o["is_article"], F.lit(False)) & ~region(o))
        return F.filter(pool, lambda c: ~(F.coalesce(c["is_article"], F.lit(False)) & F.exists(closed, lambda o: contains(o, c))))

    def bare(pool: Column) -> Column:
        return F.filter(pool, lambda c: ~F.exists(pool, lambda o: contains(c, o)))

    links = F.transform(F.filter(nodes, lambda n: n["to_post"]), lambda n: n["node"])
    return bound(bound(bound(links, looks), outer), bare)


def units(pages: DataFrame, host: str | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, page_url, unit (the post's node), own (its nodes, itself first, as `noted` leaves them), said and base (its pieces of text and
    the number of the first), commented (which articles are comments). A page without posts has no row."""
    read = parsed_pages(spread(pages), id_col, html_col, url_col)
    there = F.lit(host) if host else F.nullif(F.regexp_extract("page_url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    steps = read.select("page_id", "page_url", noted(F.col("nodes"), there).alias("nodes"), "said")
    nodes, said = F.col("nodes"), F.col("said")
    steps = steps.select("*", feed_of(nodes).alias("feed"), comment_articles(nodes).alias("commented"))

    def cut(n: Column) -> Column:
        own = F.slice(nodes, n["node"] + 1, n["end"] - n["node"])
        return F.struct(n["node"].alias("unit"), n["first"].alias("base"), own.alias("own"), pieces(said, n).alias("said"))

    found = F.transform(post_nodes(nodes, said, F.col("feed"), F.col("commented")), cut)
    return steps.select("page_id", "page_url", "commented", F.explode_outer(found).alias("x")).select("page_id", "page_url", "commented", "x.*").where("unit is not null")


def _places(node: Column, *places: int) -> Column:
    """What a node may say of a time at some places."""
    found = (F.get(node["times"], F.lit(p)) if p != WHOLE else F.coalesce(F.get(node["times"], F.lit(WHOLE)), F.get(node["times"], F.lit(LAST_LINE))) for p in places)
    return F.flatten(_known(F.array(*found)))


def _like(found: Column) -> Column:
    return F.exists(found, lambda x: x["like"])


class _Unit:
    """Columns of one row of `units`, as far as they have been read."""

    def __init__(self) -> None:
        self.own, self.unit, self.link = F.col("own"), F.col("unit"), F.col("author_link")

    def nested(self, node: Column) -> Column:
        """Whether a node is in an article inside the unit."""
        return F.coalesce(node["article"] > self.unit, F.lit(False))

    def within(self, node: Column) -> Column:
        return _inside(self.own, node, self.unit)

    def inner(self, when) -> Column:
        """The nodes inside the unit of some kind."""
        return F.filter(self.own, lambda n: (n["node"] > self.unit) & F.coalesce(when(n), F.lit(False)))

    def scope(self, when) -> Column:
        """Those of them that are in no article inside the unit."""
        return self.inner(lambda n: ~self.nested(n) & when(n))


def _author(u: _Unit) -> Column:
    name = F.coalesce(u.link["text"], _first(u.inner(lambda n: n["tag"].isin("h2", "h3", "h4")))["text"])

    def badge(n: Column) -> Column:
        said = F.lower(n["label"])
        return (F.contains(said, F.lit("verified")) & ~F.contains(said, F.lit("unverified"))) | F.contains(F.lower(F.coalesce(_attr(n, "title"), F.lit(""))), F.lit("verified"))

    profile = urls.clean_url(u.link["href"])
    return F.struct(
        urls.handle(profile).alias("handle"), F.nullif(text.first_line(name), F.lit("")).alias("name"), profile.alias("profile"), F.when(F.size(u.inner(badge)) > 0, True).alias("verified")
    )


def _block(n: Column) -> Column:
    """Leaves of user text: boxes with dir=auto and no such box inside."""
    return n["tag"].isin("div", "span") & (_attr(n, "dir") == "auto") & n["auto_leaf"]


def _caption(u: _Unit) -> Column:
    """The marked message; else leaf blocks joined under the parent of their parent, the longest group; else all lines without
    furniture and the author's name. Null if nothing is left."""
    name = F.col("author.name")

    def useful(x: Column) -> Column:
        return (x != "") & ~text.is_chrome_line(x) & ~F.coalesce(x == name, F.lit(False))

    def longest_group(said: Column) -> Column:
        groups = F.array_distinct(F.transform(said, lambda x: x["under"]))
        joined = F.transform(groups, lambda g: F.array_join(F.transform(F.filter(said, lambda x: x["under"] == g), lambda x: x["text"]), "\n"))
        return F.aggregate(joined, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))

    def marked(n: Column) -> Column:
        return F.coalesce(_attr(n, "data-ad-preview") == "message", F.lit(False)) | F.coalesce(_attr(n, "data-ad-comet-preview") == "message", F.lit(False)) | (_attr(n, "data-testid") == "post_message")

    free = u.scope(lambda n: _block(n) & ~_below(n["heading"], u.unit) & ~_below(n["control"], u.unit))
    read = F.transform(free, lambda n: F.struct(F.greatest(F.coalesce(n["grand"], u.unit), u.unit).alias("under"), n["text"].alias("text")))
    whole = F.array_join(F.filter("lines", useful), "\n")
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (_first(u.scope(marked))["text"], bound(F.filter(read, lambda x: useful(x["text"])), longest_group), whole)))


def _link_times(u: _Unit, link: Column) -> Column:
    """What a link says of a time: its labels and titles, those inside it, and its last line."""
    return F.concat(_places(link, LABEL, TITLE, LAST_LINE), F.flatten(F.transform(F.filter(u.within(link), lambda n: n["times"].isNotNull()), lambda n: _places(n, LABEL, TITLE))))


def _permalink(u: _Unit) -> Column:
    """A post's link: among links to posts outside comments those that read as a time come first, then those of the own group, then
    the first."""
    def preferred(links: Column) -> Column:
        own = F.filter(links, lambda h: h.rlike(OWN_POST) & ~urls.is_foreign_group(h, F.col("group")))
        return F.coalesce(_first(own), _first(links))

    href = lambda n: n["href"]
    timed = F.transform(F.filter("post_links", lambda n: _like(_link_times(u, n))), href)
    return F.coalesce(*(bound(x, preferred) for x in (timed, F.transform("post_links", href))))


def _stamp(u: _Unit, name: str) -> Column:
    """The id that page state put on the unit; else on the one node inside it."""
    inside = u.inner(lambda n: _attr(n, name).isNotNull())
    return F.coalesce(F.nullif(_attr(_first(u.own), name), F.lit("")), F.when(F.size(inside) == 1, _attr(_first(inside), name)))


def checked_stamp(stamp: Column, hrefs: Column, commented: Column) -> Column:
    """{id, mismatch} of the id that the page state names: null if it is a comment's, a mismatch if an own link names another."""
    good = stamp.rlike(rf"^{urls.POST_ID}$") & ~F.array_contains(commented, stamp)
    owned = urls.post_id(hrefs)
    differs = F.coalesce(good & (owned["pattern"] < OWN_PATTERNS) & (owned["id"] != stamp), F.lit(False))
    return F.struct(F.when(good & ~differs, stamp).alias("id"), differs.alias("mismatch"))


def _button_counts(u: _Unit) -> Column:
    """{likes, comments, shares, views}: the first bare number whose nearest button or link has a label of that kind."""
    numbers = u.scope(lambda n: n["tag"].isin("span", "div") & n["box_leaf"] & _below(n["press"], u.unit) & n["text"].rlike(BARE_COUNT))
    said = F.transform(numbers, lambda n: F.struct(F.get(u.own, n["press"] - u.unit)["label"].alias("label"), n["text"].alias("said")))

    def read(pairs: Column) -> Column:
        hit = {k: _first(F.filter(pairs, lambda x: x["label"].rlike(p))) for k, p in COUNT_LABELS.items()}  # noqa: B023
        return F.struct(*(parsed_count(v["said"]).alias(k) for k, v in hit.items()))

    return bound(said, read)


def _metrics(u: _Unit) -> Column:
    """{likes, comments, shares, views}: what a line states, else what a button holds; for likes then the sum of single tallies, at
    last the number beside the emoji pile."""
    labels = F.flatten(F.transform(u.scope(lambda n: n["label"] != ""), lambda n: F.transform(F.split(n["label"], "\n", -1), text.trimmed)))
    pile = _first(u.scope(lambda n: n["label"].rlike(PILE)))
    around = bound(pile, lambda n: F.get(u.own, F.greatest(F.when(_below(n["press"], u.unit) & (F.get(u.own, n["press"] - u.unit)["role"] == "button"), n["press"]).otherwise(n["parent"]) - u.unit, F.lit(0))))
    beside = bound(around, lambda n: F.coalesce(n["text"], text_inside(F.col("said"), n, F.col("base"))))

    def read(x: Column) -> Column:
        said, held = x["lines"], x["held"]

        def stated(pattern: str) -> Column:
            return comments.first_count(said, f"(?i){pattern}")

        at = F.array_position(F.transform(said, lambda y: y.rlike(r"(?i)^all reactions:?$")), True).cast("int")
        below = F.get(said, at)
        tallies = F.transform(F.filter(said, lambda y: y.rlike(TALLY)), lambda y: parsed_count(F.regexp_extract(y, TALLY, 1)))
        likes = F.coalesce(
            stated(rf"all reactions:?\s*{NUMBER}"), F.when((at > 0) & below.rlike(BARE_COUNT), parsed_count(below)), stated(rf"{NUMBER}(?:reactions?|people reacted)"), held["likes"],
            F.when(F.size(tallies) > 0, F.aggregate(tallies, F.lit(0).cast("long"), lambda a, y: a + y)), parsed_count(F.regexp_extract(x["beside"], r"[\d.,]+[KkMm]?", 0)),
        )
        rest = (F.coalesce(stated(rf"{NUMBER}{k}?\b"), held[k]).alias(k) for k in ("comments", "shares", "views"))
        return F.struct(likes.alias("likes"), *rest)

    return bound(F.struct(F.concat(F.filter(labels, lambda x: x != ""), F.col("lines")).alias("lines"), _button_counts(u).alias("held"), beside.alias("beside")), read)


def _profile_only(n: Column) -> Column:
    return n["to_profile"] & ~n["to_post"] & ~n["to_time"]


def _header_age(u: _Unit) -> Column:
    """Labels of the first carrier of a time behind the author's name: before the body (dir=auto) and before another author's row."""
    def read(block: Column) -> Column:
        after = F.get(u.own, block - u.unit)["end"]
        some = u.scope(lambda n: (n["carrier"] | n["tag"].isin("time", "abbr")) & (n["node"] >= after))

        def before_body(rows: Column) -> Column:
            stop = F.array_position(F.transform(rows, lambda n: n["auto"].isNotNull() | _profile_only(n)), True).cast("int")
            return F.when(stop > 0, F.slice(rows, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(rows)

        usable = F.filter(bound(some, before_body), lambda n: n["control"].isNull() & ~_profile_only(n))
        # Of each place only a label that reads like a time as a whole.
        said = F.transform(usable, lambda n: F.flatten(F.filter(F.slice(n["times"], 1, LAST_LINE + 1), lambda x: F.coalesce(_first(x)["like"], F.lit(False)))))
        return _first(F.filter(said, lambda x: F.size(x) > 0))

    head = F.greatest(*(F.when(_below(u.link[k], u.unit), u.link[k]) for k in ("heading", "strong")))
    return F.when(u.link.isNotNull(), bound(F.coalesce(head, u.link["node"]), read))


def _header_nodes(u: _Unit) -> Column:
    """The nodes of the post's head outside articles inside it, its author's link, controls and profiles. The head is the article around
    the author's heading, else the heading's parent; without a heading the whole unit."""
    heading = F.when(_below(u.link["heading"], u.unit), F.get(u.own, u.link["heading"] - u.unit))
    around = F.coalesce(F.when(heading["article"] >= u.unit, heading["article"]), heading["parent"], u.unit)

    def read(head: Column) -> Column:
        apart = lambda n: ~u.nested(n) & ~F.coalesce((n["node"] >= u.link["node"]) & (n["node"] < u.link["end"]), F.lit(False)) & n["control"].isNull() & ~_profile_only(n)
        return F.filter(u.within(head), apart)

    return bound(F.get(u.own, F.greatest(around - u.unit, F.lit(0))), read)


def _own_times(u: _Unit) -> Column:
    """What nodes that state a time say, links to posts and other carriers of times, and labels in the head."""
    stated = u.scope(lambda n: ((n["tag"] == "time") & _attr(n, "datetime").isNotNull()) | ((n["tag"] == "abbr") & (_attr(n, "title").isNotNull() | _attr(n, "data-utime").isNotNull())))
    # A carrier counts if it leads to a post or if its label, title and text read like a time.
    carries = lambda n: n["carrier"] & (n["to_post"] | n["to_time"] | _like(_places(n, LABEL, TITLE, WHOLE)))
    links = F.concat(F.filter("post_links", lambda n: ~u.nested(n)), F.filter("header", carries))
    return F.concat(
        F.flatten(F.transform(stated, lambda n: _places(n, DATETIME, TITLE, SECONDS, WHOLE))), F.flatten(F.transform(links, lambda n: _link_times(u, n))),
        F.flatten(F.transform(F.filter("header", lambda n: n["speaks"]), lambda n: _places(n, DATETIME, LABEL, TITLE, TOOLTIP))),
    )


def _body_times(u: _Unit) -> Column:
    """What the texts of the head say, and the first of the short lines behind the first that reads like a time."""
    def short(lines: Column) -> Column:
        long = F.array_position(F.transform(lines, lambda x: F.length(x) > 80), True).cast("int")
        return F.when(long > 0, F.slice(lines, 1, F.greatest(long - 1, F.lit(0)))).otherwise(lines)

    lines = F.transform(bound(F.slice("lines", 2, 7), short), lambda x: F.struct(x.alias("said"), F.coalesce(times.looks_like_time(x), F.lit(False)).alias("like")))
    return F.concat(F.flatten(F.transform(F.filter("header", lambda n: n["speaks"]), lambda n: _places(n, WHOLE))), F.slice(F.filter(lines, lambda x: x["like"]), 1, 1))


def _replies(u: _Unit) -> Column:
    """{position, label, author, text, likes, said} of every article inside the unit, in document order; said: what it says of its time.

    The author is the label's, without the age that may follow; likes are those the label states.
    """
    def read(n: Column) -> Column:
        label = F.coalesce(comments.comment_author(n["label"]), F.nullif(text.first_line(author_link(u.within(n))["text"]), F.lit("")))

        def whole(y: Column) -> Column:
            names = F.array_distinct(_known(F.array(y["label"], y["split"]["name"])))
            blocks = F.transform(F.filter(u.within(n), _block), lambda b: b["text"])
            anchor = _first(F.filter(u.within(n), lambda a: a["to_comment"]))
            said = F.array_distinct(F.filter(F.array(_attr(anchor, "aria-label"), _attr(anchor, "title"), _last_line(anchor["text"]), y["split"]["age"]), lambda z: F.coalesce(z != "", F.lit(False))))
            likes = parsed_count(F.regexp_extract(n["label"], r"(?i)([\d.,]+[KkMm]?)\s*reactions?", 1))
            return F.struct(
                n["pre"].alias("position"), y["label"].alias("label"), y["split"]["name"].alias("author"), y["split"]["age"].alias("age"),
                comments.comment_body(blocks, names).alias("text"), likes.alias("likes"), said.alias("said"),
            )

        return bound(bound(label, lambda x: F.struct(x.alias("label"), comments.author_and_age(x).alias("split"))), whole)

    return F.transform(u.inner(lambda n: n["is_article"]), read)


def _said(found: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<struct<said:string,like:boolean>>")), lambda x: x["said"]))


def _resolved(now: Column) -> Column:
    """{exact, rough, said} of each set of labels: those that read as dates, and the first that reads as an age. All labels of a unit
    go through one reading: of its head, its own, its body's, then of each comment."""
    sets = F.concat(F.array(_said(F.col("head_times")), _said(F.col("own_times")), _said(F.col("body_times"))), F.transform("read_replies", lambda r: r["said"]))

    def read(labels: Column) -> Column:
        rough = F.filter(F.transform(labels, lambda x: F.struct(times.relative_time(x, now).alias("at"), x.alias("said"))), lambda x: x["at"].isNotNull())
        return F.struct(_known(F.transform(labels, lambda x: times.absolute_time(x, now))).alias("exact"), _first(rough).alias("rough"))

    return F.transform(sets, read)


def _published(now: Column) -> Column:
    """{at, approximated, source}: an age in the post's head, else the page's own seconds, else labels, else texts; without a time
    source says whether anything read like one (`unresolved`) or not (`missing`). Dates in the future don't count."""
    def of(at: Column, approximated: Column, source: Column) -> Column:
        return F.struct(at.alias("at"), approximated.alias("approximated"), source.alias("source"))

    def read(place: int, source: str) -> Column:
        def first(x: Column) -> Column:
            exact = _first(_known(F.transform(x["exact"], lambda y: times.not_in_future(y, now))))
            return F.when(exact.isNotNull() | x["rough"].isNotNull(), of(F.coalesce(exact, x["rough"]["at"]), exact.isNull(), F.lit(source)))

        return bound(F.get("resolved", F.lit(place)), first)

    utime = F.col("utime")
    like = _like(F.concat("own_times", "body_times"))
    none = of(F.lit(None).cast("timestamp"), F.lit(False), F.when(like, "unresolved").otherwise("missing"))
    return F.coalesce(read(0, "header"), F.when(utime > 0, of(F.timestamp_seconds(utime), F.lit(False), F.lit("utime"))), read(1, "own"), read(2, "body"), none)


def _timed_replies() -> Column:
    """The replies with `at`, the first date or else the first age, and `said_at`, what was said where it is no date."""
    def read(r: Column, i: Column) -> Column:
        def timed(x: Column) -> Column:
            exact = _first(x["exact"])
            kept = (r[c].alias(c) for c in ("position", "label", "author", "text", "likes"))
            return F.struct(*kept, F.coalesce(exact, x["rough"]["at"]).alias("at"), F.when(exact.isNull(), F.coalesce(x["rough"]["said"], r["age"])).alias("said_at"))

        return bound(F.get("resolved", i + 3), timed)

    return F.transform("read_replies", read)


def _thumbnail(u: _Unit) -> Column:
    """A video's poster; else the largest picture, of equals the first, outside headings and controls; small ones don't count."""
    poster = _attr(_first(u.scope(lambda n: (n["tag"] == "video") & (_attr(n, "poster") != ""))), "poster")
    area = lambda n: F.coalesce(_attr(n, "width").try_cast("double"), F.lit(0.0)) * F.coalesce(_attr(n, "height").try_cast("double"), F.lit(0.0))
    apt = u.scope(lambda n: (n["tag"] == "img") & n["href"].isNotNull() & ~_below(n["heading"], u.unit) & ~_below(n["control"], u.unit) & ~_attr(n, "src").startswith("data:"))
    return F.coalesce(poster, urls.clean_url(largest_picture(F.transform(apt, lambda n: F.struct(n["href"].alias("url"), area(n).alias("area"))))))


def largest_picture(pictures: Column, least: int = LEAST_PICTURE) -> Column:
    """The url of `largest_of`."""
    return largest_of(pictures, least)["url"]


def largest_of(pictures: Column, least: int = LEAST_PICTURE) -> Column:
    """Of {url, area} the largest, of equals the first; known areas below `least` don't count, unknown ones are 0."""
    def largest(fine: Column) -> Column:
        return F.aggregate(fine, _first(fine), lambda a, x: F.when(x["area"] > a["area"], x).otherwise(a))

    return bound(F.filter(pictures, lambda x: (x["area"] == 0) | (x["area"] >= least)), largest)


def read_units(pages: DataFrame, now: Column, stamp: str = "data-post-id", host: str | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """What each post of the pages says: author, caption, link, ids, time, metrics, comments. One row a post.

    host: where profiles are; without it the page's own host. A page without link has no group, and nothing is foreign to it.
    """
    u = _Unit()
    foreign = lambda h: urls.is_foreign_group(h, F.col("group"))
    in_comment = lambda n: u.nested(n) & F.exists("roots", lambda r: (n["node"] >= r["node"]) & (n["node"] < r["end"]))
    pressed = lambda n: n["role"].isin("button", "link")
    more = u.inner(lambda n: pressed(n) & (n["text"].rlike("|".join(MORE)) | n["label"].rlike("|".join(MORE))))
    shows = u.scope(lambda n: text.trimmed_label(n["own_text"]).rlike(comments.SEE_MORE) | (pressed(n) & n["label"].rlike(comments.SEE_MORE)))
    hrefs = lambda when: F.filter(F.transform(F.filter("links", when), lambda n: n["href"]), lambda h: ~foreign(h))
    whole = F.array_join(F.transform(F.filter("said", lambda p: F.coalesce(p["article"] <= u.unit, F.lit(True))), lambda p: p["text"]), "")
    roots = u.inner(lambda n: n["is_article"] & F.array_contains("commented", n["node"]))
    # Each step reads what those before it have found.
    steps = (
        {
            "group": urls.group_slug(F.col("page_url")), "links": u.inner(lambda n: n["link"]), "author_link": author_link(F.slice("own", 2, F.size("own"))),
            "roots": F.transform(roots, lambda n: F.struct(n["node"].alias("node"), n["end"].alias("end"))),
            "lines": F.filter(F.transform(F.split(text.read_text(whole), "\n", -1), text.trimmed), lambda x: x != ""),
            "utime": F.array_max(F.transform(u.scope(lambda n: _attr(n, "data-utime").isNotNull()), lambda n: _attr(n, "data-utime").try_cast("long"))),
            "read_replies": _replies(u),
        },
        {"author": _author(u), "post_links": F.filter("links", lambda n: n["to_post"] & ~in_comment(n)), "header": _header_nodes(u), "head_times": _header_age(u)},
        {
            "permalink": _permalink(u), "caption": _caption(u), "own_times": _own_times(u), "body_times": _body_times(u), "to_self": hrefs(lambda n: in_comment(n) & n["to_comment"]),
            "hrefs": hrefs(lambda n: ~in_comment(n)), "pasted": hrefs(lambda n: in_comment(n) & ~n["to_comment"]),
            "comment_ids": F.flatten(F.transform("links", lambda n: F.regexp_extract_all(_attr(n, "href"), F.lit(r"comment_id=(\d+)"), F.lit(1)))),
        },
        {"resolved": _resolved(now)},
    )
    found = units(pages, host, id_col, html_col, url_col)
    for step in steps:
        found = found.withColumns(step)
    video = lambda n: ~u.nested(n) & _attr(n, "href").rlike(comments.VIDEO_LINK) & ~foreign(n["href"])
    tags = F.transform(F.filter("links", lambda n: F.contains(_attr(n, "href"), F.lit("/hashtag/"))), lambda n: _attr(n, "href"))
    return found.select(
        "page_id", "page_url", "unit", "group", "author", "caption", "hrefs", "to_self", "pasted", "comment_ids", urls.clean_url(F.col("permalink")).alias("link"),
        urls.comment_parent(F.col("permalink")).alias("parent_url"), _stamp(u, stamp).alias("stamp"), (F.size(shows) > 0).alias("truncated"),
        text.hashtags(F.col("caption"), tags).alias("hashtags"), _metrics(u).alias("metrics"), F.exists("links", video).alias("has_video"), _thumbnail(u).alias("thumbnail"),
        _published(now).alias("published"), _timed_replies().alias("replies"), (F.size(more) > 0).alias("more"),
    )


def comment_rows(read: DataFrame) -> DataFrame:
    """page_id, post (its unit), position, author, text, likes, at, said_at: the articles inside posts. Those without text are left out; `records`
    says that there were some."""
    rows = read.select("page_id", F.col("unit").alias("post"), F.explode_outer("replies").alias("x")).select("page_id", "post", "x.*")
    return rows.drop("label").where("text is not null")


def records(read: DataFrame, cap: int = 100, platform: str = "page") -> DataFrame:
    """One row a post, with the first `cap` of its comments that have text, whether they are all, and its warnings.

    The id is that of the page state if it holds, else of the links: its own link first, then those of its comments to
    themselves, then its others, then what is linked in comments. The link is the post's own, else made of the id that the
    page state named, else the page's. Without id and link record_id is null: the caller gives a random one. A post that
    neither id, link, author nor caption names is no record. `alt_keys` are other keys it may be known by; `parent_url` is the post that
    a unit whose own link is a comment's stands under.
    """
    link = _known(F.array("link"))
    texts = F.filter("replies", lambda r: r["text"].isNotNull())
    taken = F.transform(F.slice(texts, 1, cap), lambda r: F.struct(*(r[k].alias(k) for k in ("position", "author", "text", "likes", "at", "said_at"))))
    strong = urls.post_id(F.concat(F.filter(link, lambda h: ~urls.is_foreign_group(h, F.col("group"))), F.col("to_self")))
    linked = urls.post_id(F.concat(F.filter(link, lambda h: ~urls.is_foreign_group(h, F.col("group"))), F.col("to_self"), F.col("hrefs"), F.col("pasted")))
    known = (
        read.withColumn("state", checked_stamp(F.col("stamp"), F.concat(link, F.col("hrefs"), F.col("to_self")), F.col("comment_ids")))
        .withColumn("linked", linked).withColumn("strong", strong).withColumn("comments", taken)
    )
    stamped, group, link = F.col("state.id"), F.col("group"), F.col("link")
    external = F.coalesce(stamped, F.col("linked.id"))
    origin = F.regexp_extract("page_url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    derived = F.when(link.isNull(), F.concat(origin, F.lit("/groups/"), group, F.lit("/posts/"), stamped, F.lit("/")))
    identity = F.coalesce(F.concat(F.lit(platform + ":"), group, F.lit(":"), external), link)
    nodes, last = F.size("replies"), F.element_at(F.col("comments"), -1)["position"]
    # Those without text count as dropped only as far as the thread was read.
    dropped = F.exists("replies", lambda r: r["text"].isNull() & r["label"].isNotNull() & ((F.size("comments") < cap) | (r["position"] < last)))
    codes = {
        "author.displayName:missing": F.col("author.name").isNull(),
        "post.caption:missing": F.col("caption").isNull(),
        "post.caption:truncated": F.col("truncated"),
        "externalVideoId:missing": external.isNull(),
        "externalVideoId:from_attachment": stamped.isNull() & (F.col("linked.pattern") >= OWN_PATTERNS),
        "externalVideoId:borrowed_href": stamped.isNull() & F.col("linked.id").isNotNull() & ~F.coalesce(F.col("strong.pattern") == F.col("linked.pattern"), F.lit(False)),
        "externalVideoId:from_page_state": stamped.isNotNull(),
        "externalVideoId:page_state_mismatch": F.col("state.mismatch"),
        "sourceUrl:derived_from_post_id": derived.isNotNull(),
        "sourceUrl:fallback_group_url": link.isNull() & derived.isNull(),
        "comments:dropped_without_text": dropped,
        "comments:capped": nodes > cap,
        "metrics.likes:missing": F.col("metrics.likes").isNull(),
        "post.publishedAt:approximated_from_relative": F.col("published.approximated"),
        "post.publishedAt:from_body_text": F.col("published.source") == "body",
        "post.publishedAt:unresolved": F.col("published.source") == "unresolved",
        "post.publishedAt:missing": F.col("published.source") == "missing",
        "captureId:random": identity.isNull(),
    }
    complete = (nodes <= cap) & ~F.col("more") & (F.col("metrics.comments").isNull() | (F.size("comments") >= F.col("metrics.comments")))
    nothing = F.lit(None).cast("string")
    key = text.fallback_key(stamped, link, F.col("author.name"), F.col("caption"))
    loose = text.fallback_key(nothing, nothing, F.col("author.name"), F.col("caption"))
    fields = (
        "page_id", "unit", key.alias("key"), F.array_except(F.array_distinct(_known(F.array(link, loose))), F.array(key)).alias("alt_keys"),
        record_id(identity).alias("record_id"), external.alias("external_id"), F.coalesce(link, derived, urls.clean_url(F.col("page_url"))).alias("source_url"), "parent_url",
        "group", "author", "caption", "hashtags", F.col("published.at").alias("published_at"), "has_video", "thumbnail", "metrics", "comments", complete.alias("comments_complete"),
        F.array_compact(F.array(*(F.when(when, F.lit(code)) for code, when in codes.items()))).alias("warnings"),
    )
    # Refused inside an array: a filter on the columns would be moved below and read all that they are made of once more.
    named = F.filter(F.array(F.struct(*fields)), lambda r: r["key"] != "::")
    return known.select(F.explode_outer(named).alias("x")).select("x.*").where("key is not null")
