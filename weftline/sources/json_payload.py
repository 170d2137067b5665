"""Landed payloads: lines of JSON of any depth."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.comments import FOREIGN_SEGMENTS
from weftline.sources.html import spread

# Keys whose values name a post, the strongest first.
ID_KEYS = (
    "post_id",
    "postID",
    "legacy_story_id",
    "story_fbid",
    "subscription_target_id",
    "ftid",
)
# The shape of an id, and segments of a path that lead into a thread.
STORY_ID = r"\d+|pfbid[A-Za-z0-9]+"
THREAD_SEGMENTS = (
    "comment",
    "comments",
    "comment_parent",
    "feedback",
    "top_level_comments",
)
LEAST_LETTERS = 20
STORY = T.ArrayType(
    T.StructType().add("kind", T.StringType()).add("story", T.StringType()).add("text", T.StringType()).add("author", T.StringType()).add("place", T.IntegerType())
)


def payload_lines(lines: DataFrame, column: str = "value", marker: str | None = "post_id") -> DataFrame:
    """json: lines that hold the marker and parse; the others are skipped. The marker is tested before parsing."""
    kept = lines.where(F.col(column).contains(marker)) if marker else lines
    return kept.withColumn("json", F.try_parse_json(column)).where("json is not null")


def first_json(text: str | None) -> str | None:
    """The text if it is JSON, else the first object or array in it that parses."""
    decoder = json.JSONDecoder()
    for at in [0, *(i for i, c in enumerate(text or "") if c in "{[")]:
        try:
            value, end = decoder.raw_decode(text or "", at)
        except ValueError:
            continue
        if at or not (text or "")[end:].strip():
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return None


@F.udf(T.StringType(), useArrow=True)
def embedded_json(text: str) -> str:
    return first_json(text)


def json_content(text: Column) -> Column:
    """A whole JSON text is parsed by Spark; only others go through the scanner."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.when(F.try_parse_json(text).isNull(), embedded_json(text))))


def stories_of(text: str | None) -> list[tuple]:
    """(kind, story, text, author, order) of the stories that a JSON text names, in order of a depth-first walk.

    A story is an object with an id under one of ID_KEYS, and owns what stands inside it up to the next one; what leads to other
    stories and comments is not entered. Kind `own`: a text of the story itself. `shared`: of a story without text the first
    long one inside it, which it shares, outside its thread. `author`: of a story without a long text who wrote it.
    """
    try:
        stack = [(json.loads(text or "null"), None)]
    except ValueError:
        return []
    out: list[tuple] = []
    while stack:
        value, story = stack.pop()
        if isinstance(value, dict):
            named = next((str(value[k]) for k in ID_KEYS if value.get(k) is not None and not isinstance(value[k], bool) and re.fullmatch(STORY_ID, str(value[k]))), None)
            story, said = named or story, own_text(value)
            if story and said is not None:
                out.append(("own", story, said, None, len(out)))
            if named and said is None and (shared := first_text(value)) is not None:
                out.append(("shared", story, shared, None, len(out)))
            if named and len(letters(said or "")) < LEAST_LETTERS:
                actors = value["actors"] if isinstance(value.get("actors"), list) else []
                actor = next((str(a["id"]) for a in actors if isinstance(a, dict) and re.fullmatch(r"\d+", str(a.get("id", "")))), None)
                if actor:
                    out.append(("author", story, None, actor, len(out)))
            value = [v for k, v in value.items() if k not in FOREIGN_SEGMENTS]
        if isinstance(value, list):
            stack += [(x, story) for x in reversed(value) if isinstance(x, (dict, list))]
    return out


def own_text(value: dict) -> str | None:
    message = value.get("message")
    said = message.get("text") if isinstance(message, dict) else None
    said = value.get("message_text") if said is None else said
    return said if isinstance(said, str) else None


def first_text(value: object) -> str | None:
    """The first text of at least LEAST_LETTERS letters inside a value, depth first, not entering threads."""
    stack = [value]
    while stack:
        value = stack.pop()
        if isinstance(value, dict):
            said = own_text(value)
            if said is not None and len(letters(said)) >= LEAST_LETTERS:
                return said
            value = [v for k, v in value.items() if k not in THREAD_SEGMENTS]
        if isinstance(value, list):
            stack += [x for x in reversed(value) if isinstance(x, (dict, list))]
    return None


def letters(text: str) -> str:
    """Compatibility forms folded, lower case, letters and numbers only; `text.folded_skeleton` of columns."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if unicodedata.category(c)[0] in "LN")


@F.udf(STORY, useArrow=True)
def walk_json(text: str) -> list[tuple]:
    return stories_of(text)


def story_rows(payloads: DataFrame, column: str, order: str) -> DataFrame:
    """kind, story, text, author, ord of all stories in payloads; ord: (order of the payload, place in it)."""
    each = spread(payloads.select(order, column)).select(F.col(order).alias("payload_order"), F.explode_outer(walk_json(column)).alias("x")).where("x is not null")
    return each.select("x.kind", "x.story", "x.text", "x.author", F.struct(F.col("payload_order").alias("payload"), F.col("x.place").alias("place")).alias("ord"))


HITS = T.StructType().add("hits", T.ArrayType(T.StructType().add("rank", T.IntegerType()).add("depth", T.IntegerType()).add("path", T.StringType()).add("value", T.StringType())))
HITS = HITS.add("groups", T.ArrayType(T.StringType()))


def named_ids(text: str | None) -> tuple[list[tuple], list[str]] | None:
    """(hits, groups) of a JSON text: (rank, depth, path, value) of each id under a key that names posts, and the groups
    of its links, outside of paths that lead to other stories or comments. Null for what is no JSON."""
    try:
        stack = [(json.loads(text or ""), (), False)]
    except ValueError:
        return None
    hits, groups = [], set()
    while stack:
        value, path, foreign = stack.pop()
        for key, child in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
            key = str(key)
            away = foreign or key in FOREIGN_SEGMENTS
            if not away and isinstance(child, str):
                groups.update(re.findall(r"/groups/([^/?#\s\"]+)", child))
            if not away and key in ID_KEYS and isinstance(child, (str, int)) and re.fullmatch(r"\d+|pfbid[A-Za-z0-9]+", str(child)):
                hits.append((ID_KEYS.index(key), len(path), ".".join((*path, key)), str(child)))
            if isinstance(child, (dict, list)):
                stack.append((child, (*path, key), away))
    return hits, sorted(groups)


@F.udf(HITS, useArrow=True)
def id_hits(text: str) -> tuple:
    return named_ids(text)


def best_id(found: Column, group: Column) -> Column:
    """Of `id_hits`: the id of the best key, the shallowest and shortest path first. Null where that key names two ids, or where
    groups of the own group's kind (number or name) are named and it is not among them."""
    order = F.array_sort(F.transform(found["hits"], lambda h: F.struct(h["rank"], h["depth"].alias("depth"), F.length(h["path"]).alias("size"), h["value"].alias("value"))))
    best = F.try_element_at(order, F.lit(1))
    rivals = F.exists(found["hits"], lambda h: (h["rank"] == best["rank"]) & (h["value"] != best["value"]))
    like = F.filter(found["groups"], lambda g: g.rlike(r"^\d+$") == group.rlike(r"^\d+$"))
    elsewhere = F.coalesce((F.size(like) > 0) & ~F.array_contains(like, group), F.lit(False))
    return F.when(~F.coalesce(rivals, F.lit(False)) & ~elsewhere, best["value"])
