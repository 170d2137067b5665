"""Queries of scalar functions over texts, counts, times and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import counts, text, times, urls
from weftline.functions.ids import SEEDS, record_id
from weftline.plans.registry import query, table
from weftline.sources.html import anchors, block_text, node_table
from weftline.sources.json_payload import json_content

NOW = "2024-02-01 12:00:00"


# SQL of a column `text` with white space as `normalized_space` leaves it.
NORMALIZED = r"""trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(coalesce(text, ''), '[ \t\x{A0}]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(160))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"""


@query(f"SELECT doc_id, md5({NORMALIZED}) AS digest FROM documents")
def normalize_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalized_space(F.col("text"))).alias("digest"))


# One line of page furniture of each kind, and lines that are none.
LINE_FORMS = (
    "Haha", "Shares", "View previous comments", "Write a public comment…", "All reactions:", "Top contributor", "3 comments · 4 shares", "12.5K", "Just now",
    "2 hours ago", "5 weeks", "· ·", "Public", "This content isn't available right now", "When this happens, it's usually because the owner moved it",
    "hello there", "5 apples", "public house", "yesterday at noon", "12 Kilo",
)
_LINES = ", ".join("'" + x.replace("'", "''") + "'" for x in LINE_FORMS)


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || [{_LINES}][doc_id % {len(LINE_FORMS)} + 1], chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {" OR ".join(f"regexp_matches(trim(line), '(?i){x}')" for x in text.CHROME_LINES)}) AS chrome FROM l GROUP BY 1
""")
def strip_chrome(spark, sf_dir):
    form = F.element_at(F.array(*map(F.lit, LINE_FORMS)), (F.col("doc_id") % len(LINE_FORMS) + 1).cast("int"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.concat("text", F.lit("\n"), form), "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(text.is_chrome_line(F.trim("line"))).alias("chrome"))


@query("SELECT doc_id, string_split(text, chr(10))[1] AS first_line FROM documents")
def first_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_line(F.col("text")).alias("first_line"))


@query("SELECT doc_id, CASE WHEN lang = source THEN lang ELSE lang || ',' || source END AS tags FROM documents")
def hashtags(spark, sf_dir):
    tagged = F.concat(F.lit("see #"), "lang", F.lit(" and #"), "source", F.lit("! again #"), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.hashtags(tagged), ",").alias("tags"))


@query("SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 60) AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("SELECT o_orderkey, CAST(floor(round(o_totalprice / 1000, 1) * 1000 + 0.5) AS BIGINT) AS n, CAST(floor(o_totalprice) AS BIGINT) AS plain FROM orders")
def parse_count(spark, sf_dir):
    label = F.concat(F.round(F.col("o_totalprice") / 1000, 1).cast("string"), F.lit("K views"))
    plain = F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(" likes"))
    return table(spark, sf_dir, "orders").select("o_orderkey", counts.parsed_count(label).alias("n"), counts.parsed_count(plain).alias("plain"))


@query(f"""
SELECT event_id, CASE event_id % 8 WHEN 0 THEN TIMESTAMP '{NOW}' - to_seconds((event_id % 50) * 3600)
  WHEN 1 THEN TIMESTAMP '{NOW}' - to_seconds((event_id % 9) * 86400)
  WHEN 2 THEN TIMESTAMP '{NOW}' - INTERVAL 1 HOUR WHEN 3 THEN TIMESTAMP '2024-01-31 17:03:00'
  WHEN 4 THEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR WHEN 5 THEN TIMESTAMP '{NOW}' - INTERVAL 3 HOUR WHEN 6 THEN TIMESTAMP '{NOW}' END AS at FROM events
""")
def relative_time(spark, sf_dir):
    n = F.col("event_id")
    label = (
        F.when(n % 8 == 0, F.concat((n % 50).cast("string"), F.lit("h"))).when(n % 8 == 1, F.concat(F.lit("about "), (n % 9).cast("string"), F.lit(" days ago")))
        .when(n % 8 == 2, F.lit("an hour ago")).when(n % 8 == 3, F.lit("Yesterday at 5:03 PM")).when(n % 8 == 4, F.lit("yesterday"))
        .when(n % 8 == 5, F.lit("photo from today, 3h")).when(n % 8 == 6, F.lit("Just now")).otherwise(F.lit("what happened today here"))
    )
    return table(spark, sf_dir, "events").select("event_id", times.relative_time(label, F.lit(NOW).cast("timestamp")).alias("at"))


@query("SELECT o_orderkey, make_date(CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate) ELSE 2024 END, month(o_orderdate), day(o_orderdate))::TIMESTAMP + INTERVAL 9 HOUR + INTERVAL 5 MINUTE AS month_label, CAST(o_orderdate AS DATE)::TIMESTAMP AS numeric_label, CAST(o_orderdate AS DATE)::TIMESTAMP AS iso_label FROM orders")
def absolute_time(spark, sf_dir):
    now, day = F.lit(NOW).cast("timestamp"), F.col("o_orderdate")
    labels = {"month": F.date_format(day, "MMMM d, yyyy 'at' 9:05 'AM'"), "numeric": F.date_format(day, "M/d/yyyy"), "iso": F.date_format(day, "yyyy-MM-dd")}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *(v.alias(k) for k, v in labels.items()))
    return times.with_absolute_times(rows, {f"{k}_label": k for k in labels}, now).drop(*labels)


@query("SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-15 06:00:00' THEN ts END AS at FROM events")
def future_guard(spark, sf_dir):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", times.not_in_future(F.col("ts").cast("timestamp"), now).alias("at"))


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS bare FROM pages),
q AS (SELECT page_id, string_split(bare, '?')[1] AS base, list_filter(string_split(CASE WHEN contains(bare, '?') THEN regexp_replace(bare, '^[^?]*\?', '') ELSE '' END, '&'), lambda x: x <> '' AND NOT string_split(x, '=')[1] IN ('ref', 'refid', 'comment_id')) AS kept FROM p)
SELECT page_id, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS clean FROM q
""")
def clean_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.clean_url(F.col("url")).alias("clean"))


@query(r"""
SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1), '') AS handle, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
  CASE page_id % 5 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN 'Jörg+' || page_id WHEN 2 THEN CAST(page_id AS VARCHAR) END AS other FROM pages
""")
def url_handle(spark, sf_dir):
    key = F.col("page_id").cast("string")
    other = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://h.example/Profile.php?id="), key)).when(F.col("page_id") % 5 == 1, F.concat(F.lit("https://h.example/J%C3%B6rg+"), key, F.lit("/")))
        .when(F.col("page_id") % 5 == 2, F.concat(F.lit("https://h.example/groups/9/user/"), key)).when(F.col("page_id") % 5 == 3, F.concat(F.lit("https://h.example/?id="), key))
    )
    return table(spark, sf_dir, "pages").select("page_id", urls.handle(F.col("url")).alias("handle"), urls.query_value(F.col("url"), "page").alias("page"), urls.handle(other).alias("other"))


@query(r"""
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS slug, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'v' || c_custkey END AS id, CAST(CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 5 END AS INTEGER) AS pattern FROM customer
""")
def post_ids(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    own = F.concat(F.lit("https://h.example/groups/"), key, F.lit("/posts/"), key, F.lit("/"))
    watch = F.concat(F.lit("https://h.example/watch/?v=pfbid"), key)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.array(watch, own)).otherwise(F.array(watch)).alias("links"), own.alias("own"))
    found = rows.select("c_custkey", urls.group_slug(F.col("own")).alias("slug"), urls.post_id(F.col("links")).alias("x"))
    return found.select("c_custkey", "slug", F.regexp_replace("x.id", "^pfbid", "v").alias("id"), "x.pattern")


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href="[^"]*"')) AS anchors, len(list_distinct(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1))) AS links
FROM pages WHERE regexp_matches(html, '<a [^>]*href=')
""")
def page_anchors(spark, sf_dir):
    links = anchors(node_table(table(spark, sf_dir, "pages")))
    return links.groupBy("page_id").agg(F.count("*").alias("anchors"), F.countDistinct("href").alias("links"))


@query(r"""
WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '<p>((?:[^<]|</?(?:b|i|a|br|span|em|strong|img)(?:\s[^>]*)?/?>)*)', 1)) AS raw FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(raw, '\s+', ' ', 'g'), '<br/?>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g') AS marked FROM p),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(marked, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS plain FROM t)
SELECT page_id, count(*) AS paragraphs, max(length(trim(regexp_replace(regexp_replace(plain, ' *\n *', chr(10), 'g'), ' +', ' ', 'g'), ' ' || chr(10)))) AS longest FROM u GROUP BY page_id
""")
def page_paragraphs(spark, sf_dir):
    """Paragraphs of the given pages, most of which are never closed, as a browser shows them."""
    blocks = block_text(table(spark, sf_dir, "pages"), tags=("p",))
    return blocks.groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.max(F.length("text")).cast("long").alias("longest"))


@query()
def page_blocks(spark, sf_dir):
    blocks = block_text(table(spark, sf_dir, "pages"))
    return blocks.groupBy("page_id").agg(F.count("*").alias("blocks"), F.max(F.length("text")).alias("longest"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def json_props(spark, sf_dir):
    framed = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("data: "), "props", F.lit(" end"))).otherwise(F.col("props"))
    parsed = table(spark, sf_dir, "events").where("props is not null").select("event_id", json_content(framed).alias("v"))
    return parsed.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


def _unit_hash_sql(units: str, seed: int) -> str:
    """SQL of the seeded 32-bit hash over a list of UTF-16 units, in unsigned 64-bit arithmetic."""
    low = lambda x: f"(({x}) & 4294967295)"
    turn = lambda x, by: low(f"(({x}) << {by}) | (({x}) >> {32 - by})")
    block = low(f"{turn(low('u * 3432918353::UBIGINT'), 15)} * 461845907::UBIGINT")
    step = low(f"{turn('xor(h, u)', 13)} * 5::UBIGINT + 3864292196::UBIGINT")
    walk = f"list_reduce(list_prepend({seed}::UBIGINT, list_transform({units}, lambda u: {block})), lambda h, u: {step})"
    mixed = f"list_transform([xor({walk}, len({units})::UBIGINT)], lambda x: {low('xor(x, x >> 16) * 2246822507::UBIGINT')})"
    mixed = f"list_transform({mixed}, lambda x: {low('xor(x, x >> 13) * 3266489909::UBIGINT')})"
    return f"printf('%08x', list_transform({mixed}, lambda x: xor(x, x >> 16))[1])"


@query(f"""
WITH t AS (SELECT c_custkey, list_transform(string_split('feed:1:' || c_custkey, ''), lambda c: unicode(c)::UBIGINT) AS units FROM customer),
h AS (SELECT c_custkey, {" || ".join(_unit_hash_sql("units", seed) for seed in SEEDS)} AS x FROM t)
SELECT c_custkey, x[1:8] || '-' || x[9:12] || '-8' || x[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', x[17]) - 1) % 4 + 1, 1) || x[18:20] || '-' || x[21:32] AS id FROM h
""")
def capture_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", record_id(F.concat(F.lit("feed:1:"), F.col("c_custkey").cast("string"))).alias("id"))


@query(r"""
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = 1 THEN floor(l_quantity + 0.5) WHEN l_linenumber = 2 THEN floor(l_tax * 100 + 0.5) + floor(l_discount * 100 + 0.5) END AS BIGINT) AS likes FROM lineitem
""")
def metrics_ladder(spark, sf_dir):
    line = F.col("l_linenumber")
    whole = F.when(line == 1, F.concat(F.lit("All reactions: "), F.col("l_quantity").cast("string")))
    tally = lambda c: F.concat(F.lit("Like: "), F.floor(F.col(c) * 100 + 0.5).cast("string"), F.lit(" people"))
    tallies = F.when(line == 2, F.array(tally("l_tax"), tally("l_discount"))).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", counts.reaction_total(whole, none, none, tallies).alias("likes"))
