"""Links as Column expressions: no per-row Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = (
    "__cft__[0]", "__tn__", "comment_id", "notif_id", "notif_t", "ref", "refid", "__so__",
    "hoisted_section_header_type", "rdid", "share_url",
)
# First path segments that are features, not names.
RESERVED = (
    "groups", "profile.php", "permalink.php", "story.php", "photo", "photo.php", "watch", "reel", "videos", "hashtag",
    "events", "marketplace", "pages", "people", "search",
)
POST_ID = r"(?:\d+|pfbid[A-Za-z0-9]+)"


# The ids of posts in links, the strongest pattern first.
POST_ID_PATTERNS = (
    rf"/groups/[^/]+/(?:posts|permalink)/({POST_ID})",
    rf"multi_permalinks=({POST_ID})",
    rf"story_fbid=({POST_ID})",
    r"[?&]set=gm\.(\d+)",
    rf"/(?:videos|reel)/({POST_ID})",
    rf"[?&]v=({POST_ID})",
    rf"[?&]fbid=({POST_ID})",
)


def resolved(url: Column, base: Column) -> Column:
    """A link read on the page `base`: absolute ones stay, others get its scheme, host or folder. Without a base as it is."""
    origin = F.nullif(F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0), F.lit(""))
    bare = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.when(F.length(bare) > F.length(origin), F.regexp_replace(bare, "[^/]*$", "")).otherwise(F.concat(origin, F.lit("/")))
    absolute = url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")
    found = (
        F.when(absolute | origin.isNull(), url).when(url.startswith("//"), F.concat(F.regexp_extract(base, "^[^:]*:", 0), url))
        .when(url.startswith("/"), F.concat(origin, url)).when(url.startswith("?"), F.concat(bare, url)).when(url.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), url))
    )
    return found.otherwise(F.concat(folder, url))


def clean_url(url: Column, base: Column | None = None) -> Column:
    """Without tracking parameters and fragment, resolved against the page `base` if one is given; what does not look like a
    link stays as it is."""
    url = url if base is None else resolved(url, base)
    bare = F.regexp_replace(url, "#.*$", "")
    base = F.split(bare, r"\?", 2)[0]
    query = F.when(F.instr(bare, "?") > 0, F.split(bare, r"\?", 2)[1]).otherwise(F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=", 2)[0].isin(*TRACKING, "__cft__%5B0%5D"))
    text = F.array_join(kept, "&")
    return F.when(~url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), url).otherwise(F.concat(base, F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")))


def path_segment(url: Column, position: int) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
    return F.nullif(F.split_part(path, F.lit("/"), F.lit(position)), F.lit(""))


def query_value(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def group_slug(url: Column) -> Column:
    own = F.nullif(F.regexp_extract(url, r"/groups/([^/?#]+)", 1), F.lit(""))
    return F.coalesce(own, query_value(url, "idorvanity"), query_value(url, "group_id"))


def handle(url: Column) -> Column:
    """Member id of a group link; else the first path segment, decoded, unless that is a feature: then the id parameter. Null without a path."""
    member = F.nullif(F.regexp_extract(url, r"/groups/[^/?#]+/user/(\d+)", 1), F.lit(""))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1)
    name = F.when(F.lower(path).isin(*RESERVED), query_value(url, "id")).otherwise(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))
    return F.coalesce(member, F.when(path != "", name))


def comment_parent(url: Column) -> Column:
    return F.when(url.rlike("comment_id=|/comment/"), F.regexp_replace(url, r"[?#].*$", ""))


def is_foreign_group(url: Column, own: Column) -> Column:
    return F.coalesce(group_slug(url) != own, F.lit(False))


def _reads(pattern: str):
    return lambda url: F.regexp_extract(url, pattern, 1)


def post_id(urls: Column) -> Column:
    """Of links in order of trust: the id by the first pattern that any of them has, and that pattern's number."""
    found = []
    for number, pattern in enumerate(POST_ID_PATTERNS):
        hits = F.filter(F.transform(urls, _reads(pattern)), lambda x: x != "")
        id_ = F.try_element_at(hits, F.lit(1))
        found.append(F.when(id_.isNotNull(), F.struct(id_.alias("id"), F.lit(number).alias("pattern"))))
    return F.coalesce(*found)


def is_group_feed(url: Column, host: str) -> Column:
    """Whether a link on that host (a pattern of its end) is a group's feed: under /groups/, and no post's own page."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    fine = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)).rlike(rf"(^|\.)(?:{host})$")
    post = path.rlike(r"/(?:posts|permalink)/") | F.contains(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("multi_permalinks="))
    return F.coalesce(fine & F.contains(path, F.lit("/groups/")) & ~post, F.lit(False))


def group_name(title: Column, site: str) -> Column:
    """A group's name from its page's title: without the site's name at the end and a count of news in front."""
    bare = F.trim(F.regexp_replace(title, r"\s+", " "))
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, rf"(?i)\s*\|\s*{site}$", ""), r"^\(\d+\+?\)\s*", ""), F.lit(""))
