"""Names, bodies, placeholders and keys of posts and comments, as Column expressions over their lines and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.counts import parsed_count
from weftline.functions.text import is_chrome_line, normalized_space, trimmed
from weftline.functions.times import TRAILING, bound, looks_like_time

# Segments of a payload path that lead to another story or to a comment.
FOREIGN_SEGMENTS = (
    "attached_story",
    "attached_stories",
    "attachment",
    "attachments",
    "comment",
    "comments",
    "comment_parent",
    "nested_stories",
    "original_post",
    "parent_post",
    "parent_story",
    "shared_story",
    "share_story",
    "sub_stories",
    "target",
    "target_group",
)
# What stands where a post is gone, a control that shows the rest of a text, and links of videos.
TOMBSTONE = r"(?i)this content isn.t available right now|when this happens, it.s usually because the owner"
SEE_MORE = r"(?i)^see more[.…]*$"
VIDEO_LINK = r"/(?:videos|reel)/(?:\d+|pfbid[A-Za-z0-9]+)|[?&]v=(?:\d+|pfbid[A-Za-z0-9]+)"


def is_foreign_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, r"\."), F.array(*map(F.lit, FOREIGN_SEGMENTS)))


def is_prose(line: Column) -> Column:
    return line.rlike(r"\s")


def comment_author(label: Column) -> Column:
    """X of `Comment by X on ...`; null for other labels."""
    return F.nullif(trimmed(F.regexp_extract(label, r"(?i)^Comment by (.+?)(?:\s+on\b|$)", 1)), F.lit(""))


def author_and_age(label: Column) -> Column:
    """(name, age): an age glued to the end of a name is split off; null where nothing is left."""
    whole = F.regexp_extract(label, TRAILING, 0)
    name = normalized_space(F.substring(label, F.lit(1), F.length(label) - F.length(whole)))
    return F.struct(F.nullif(name, F.lit("")).alias("name"), F.nullif(normalized_space(F.regexp_extract(label, TRAILING, 1)), F.lit("")).alias("age"))


def without_author_lines(text: Column, names: Column) -> Column:
    """Leading lines that are one of the names go, but never the last line."""
    def cut(lines: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))

        def step(a: Column, line: Column) -> Column:
            more = a["open"] & F.coalesce(F.array_contains(names, trimmed(line)), F.lit(False))
            return F.struct((a["n"] + more.cast("int")).alias("n"), more.alias("open"))

        gone = F.least(F.aggregate(lines, start, step)["n"], F.size(lines) - 1)
        return normalized_space(F.array_join(F.slice(lines, gone + 1, F.size(lines)), "\n"))

    return F.when(text.isNotNull(), bound(F.split(text, "\n", -1), cut))


def comment_body(blocks: Column, names: Column) -> Column:
    """A comment's blocks of text without names, furniture and repeats, joined; null if nothing is left."""
    own = F.transform(F.array_distinct(blocks), normalized_space)  # equal blocks are read once
    kept = F.array_distinct(F.filter(own, lambda x: (x != "") & ~F.coalesce(F.array_contains(names, x), F.lit(False)) & ~is_chrome_line(x)))
    return F.nullif(without_author_lines(F.when(F.size(kept) > 0, normalized_space(F.array_join(kept, "\n"))), names), F.lit(""))


def is_tombstone(text: Column, author: Column) -> Column:
    """Whether a text is the placeholder of a post that is gone: fewer than 40 letters of other prose beside it."""
    def rest(lines: Column) -> Column:
        other = F.filter(
            lines, lambda x: (x != "") & ~F.coalesce(x == author, F.lit(False)) & is_prose(x) & ~x.rlike(TOMBSTONE) & ~is_chrome_line(x) & ~looks_like_time(x)
        )
        return F.length(trimmed(F.array_join(other, " "))) < 40

    return text.rlike(TOMBSTONE) & bound(F.split(text, "\n", -1), rest)


def looks_like_post(role: Column, comment: Column, tombstone: Column, post_links: Column, text: Column, has_author: Column) -> Column:
    """Neither feed, comment nor placeholder, and with a link of its own, or with an author and more than 40 letters."""
    fine = ~(F.coalesce(role, F.lit("")) == "feed") & ~comment & ~tombstone
    return fine & ((post_links > 0) | ((F.length(trimmed(text)) > 40) & has_author))


def group_key(value: Column) -> Column:
    """Lower case without slashes at the end; null for nothing."""
    return F.when(value != "", F.regexp_replace(F.lower(value), "/+$", ""))


def outlet_keys(values: Column, links: Column) -> Column:
    """All keys by which an outlet may be asked for: its names and ids, then the group names of its links, each once."""
    named = F.transform(links, lambda x: group_key(F.try_url_decode(F.regexp_extract(x, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*?/groups/([^/?#]+)", 1))))
    return F.array_distinct(F.filter(F.concat(F.transform(values, group_key), named), lambda x: x.isNotNull()))


def first_count(lines: Column, pattern: str) -> Column:
    """The count of the first line that the pattern (with one group) matches."""
    return parsed_count(F.regexp_extract(F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(1)), pattern, 1))


def settle_ms(pages: Column) -> Column:
    """How long a thread of so many pages is left to settle."""
    return F.when(pages <= 1, 450).when(pages <= 3, 800).otherwise(1_400)


def phase(holding: Column) -> Column:
    return F.when(holding, F.lit("fast")).otherwise(F.lit("full"))


def entry_key(from_page_state: Column, external_id: Column, key: Column) -> Column:
    return F.when(from_page_state, F.coalesce(F.nullif(external_id, F.lit("")), key)).otherwise(key)
