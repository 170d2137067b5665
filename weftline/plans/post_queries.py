"""Queries of whole records read from pages. Each customer has a page with one post and things that are none; the SQL states what
the page says.

Among these pages are links relative to the page, bold captions, comments with an age or a count in their label, one without
text, an older post shared inside the post (which counts as an answer), a placeholder of a post that is gone, a post opened in a dialog,
and links that only borrow an id. The page of customer 1 names the id of an answer (answers have the ids 1 and 2), which is not taken
for the post. Each part has a page whose posts are mostly no articles.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators.posts import comment_rows, read_units, records
from weftline.plans.registry import query, table
from weftline.sources.html import parsed_pages

NOW = "2024-02-01 12:00:00"
CAP = 2


def _markup(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _if(when, *parts):
    return F.when(when, _markup(*parts)).otherwise(F.lit(""))


def _read(spark, sf_dir):
    key, name = F.col("c_custkey"), F.col("c_name")
    state = F.when(key % 4 == 1, _markup(' data-post-id="', key, '"')).when(key % 4 == 2, _markup(' data-post-id="', key + 1, '"')).otherwise(F.lit(""))
    trade = F.when(key % 8 == 0, _markup("<strong>", F.col("c_mktsegment"), "</strong>")).otherwise(F.col("c_mktsegment"))
    numbers = F.sequence(F.lit(1).cast("long"), key % 3 + 1)
    said = lambda j: F.when(j % 2 == 1, F.lit("on this post, 5 reactions")).otherwise(F.lit("8 hours ago"))
    reply = lambda j: _markup('<div role="article" aria-label="Comment by Ann Lee ', said(j), '"><div dir="auto">Ann Lee</div><div dir="auto">answer ', j, " to ", name, '</div><a href="/groups/7/posts/', key, "/?comment_id=", j, '">', j, " hours ago</a></div>")
    parts = (
        '<div role="feed"><div role="article"', state, '><h3><a href="/Trader', key, '"><b>', name, "</b></a></h3>", _if(key % 2 == 0, '<i aria-label="Verified account"></i>'),
        _if(key % 5 != 0, '<a href="/groups/7/posts/', key, '/?ref=feed" aria-label="', key % 20 + 1, ' hours ago">link</a>'), _if(key % 6 == 0, '<abbr data-utime="', key + 1_700_000_000, '"></abbr>'),
        '<div><div><div dir="auto">', trade, " is the trade of ", name, '</div></div><div><div dir="auto">and #market too</div></div></div><div><div><div dir="auto">aside</div></div></div>',
        _if(key % 9 == 0, '<a href="/groups/7/videos/123/">play</a>'), _if(key % 13 == 0, '<a href="/x?story_fbid=77">more</a>'), _if(key % 14 == 0, '<a href="/hashtag/deal">deal</a>'),
        _if(key % 16 == 0, '<img src="/q.jpg" width="50" height="50"><img src="/p/', key, '.jpg" width="300" height="200">'),
        '<div role="button" aria-label="Like"><span>', key % 100, '</span></div><div role="button" aria-label="Leave a comment"><span>', key % 3 + F.when(key % 7 == 0, 1).otherwise(0), "</span></div>",
        _if(key % 11 == 0, '<div role="article" aria-label="Comment by Di on this post"></div>'), F.array_join(F.transform(F.slice(numbers, 1, (key % 3).cast("int")), reply), ""),
        _if(key % 10 == 3, '<div role="article"><h4><a href="/Origin">Origin</a></h4><div dir="auto">an older word</div></div>'), "</div>",
        _if(key % 12 == 0, '<div role="article"><a href="/groups/7/posts/1/">x</a><div dir="auto">This content isn', "'", 't available right now</div></div>'),
        _if(key % 15 == 0, '<div role="dialog"><div role="article"><h3><a href="/Zed">Zed Dialog</a></h3><a href="/groups/7/posts/99/">opened</a></div></div>'), "</div>",
    )
    pages = table(spark, sf_dir, "customer").select(key.alias("page_id"), F.lit("https://h.example/groups/7/?sorting=new").alias("url"), _markup(*parts).alias("html"))
    return read_units(pages, F.lit(NOW).cast("timestamp"))


@query(f"""
WITH c AS (
  SELECT c_custkey AS k, c_name, c_mktsegment, c_custkey % 5 <> 0 AS linked, c_custkey % 3 > 0 AS answered, c_custkey % 4 AS s, c_custkey % 9 = 0 AS video, c_custkey % 13 = 0 AS lent,
    c_mktsegment || ' is the trade of ' || c_name || chr(10) || 'and #market too' AS caption, c_custkey % 3 + CASE WHEN c_custkey % 10 = 3 THEN 1 ELSE 0 END AS texts, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS bare FROM customer
), i AS (
  SELECT *, CASE WHEN s = 1 AND NOT (answered AND k = 1) AND (linked OR answered OR NOT lent) THEN k WHEN s = 2 AND NOT linked AND NOT answered AND NOT lent THEN k + 1 END AS stamped,
    (s = 2 AND (linked OR answered OR lent)) OR (s = 1 AND lent AND NOT linked AND NOT answered) AS mismatch, linked OR answered AS named FROM c
), j AS (SELECT *, coalesce(stamped, CASE WHEN named THEN k WHEN lent THEN 77 WHEN video THEN 123 END) AS id FROM i),
u AS (SELECT *, CASE WHEN linked THEN 'https://h.example/groups/7/posts/' || k || '/' WHEN video THEN 'https://h.example/groups/7/videos/123/' END AS link FROM j)
SELECT k AS page_id, coalesce(CAST(stamped AS VARCHAR), link, c_name || '::' || left(caption, 120)) AS key, CAST(id AS VARCHAR) AS external_id,
  coalesce(link, 'https://h.example/groups/7/posts/' || stamped || '/', 'https://h.example/groups/7/?sorting=new') AS source_url,
  c_name AS author, 'Trader' || k AS handle, CASE WHEN k % 2 = 0 THEN true END AS verified, caption, substring(c_name, 10) || ',market' || CASE WHEN k % 14 = 0 THEN ',deal' ELSE '' END AS tags,
  CASE WHEN linked THEN TIMESTAMP '{NOW}' - to_seconds((k % 20 + 1) * 3600) WHEN k % 6 = 0 THEN TIMESTAMP '1970-01-01' + to_seconds(k + 1700000000) END AS published_at,
  video AS has_video, CASE WHEN k % 16 = 0 THEN 'https://h.example/p/' || k || '.jpg' END AS thumbnail, k % 100 AS likes, least(texts, {CAP}) AS answers,
  texts + bare <= {CAP} AND texts >= k % 3 + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS complete,
  array_to_string(list_filter([CASE WHEN id IS NULL THEN 'externalVideoId:missing' END, CASE WHEN id = 123 AND stamped IS NULL AND NOT named THEN 'externalVideoId:from_attachment' END,
    CASE WHEN stamped IS NULL AND NOT named AND lent THEN 'externalVideoId:borrowed_href' END,
    CASE WHEN stamped IS NOT NULL THEN 'externalVideoId:from_page_state' END, CASE WHEN mismatch THEN 'externalVideoId:page_state_mismatch' END,
    CASE WHEN link IS NULL AND stamped IS NOT NULL THEN 'sourceUrl:derived_from_post_id' END, CASE WHEN link IS NULL AND stamped IS NULL THEN 'sourceUrl:fallback_group_url' END,
    CASE WHEN bare = 1 THEN 'comments:dropped_without_text' END, CASE WHEN texts + bare > {CAP} THEN 'comments:capped' END,
    CASE WHEN linked THEN 'post.publishedAt:approximated_from_relative' END, CASE WHEN k % 6 <> 0 AND NOT linked THEN 'post.publishedAt:missing' END,
    CASE WHEN id IS NULL AND link IS NULL THEN 'captureId:random' END], lambda x: x IS NOT NULL), ',') AS warnings FROM u
""")
def unit_records(spark, sf_dir):
    out = records(_read(spark, sf_dir), cap=CAP)
    return out.select(
        "page_id", "key", "external_id", "source_url", F.col("author.name").alias("author"), F.col("author.handle").alias("handle"), F.col("author.verified").alias("verified"), "caption",
        F.array_join("hashtags", ",").alias("tags"), "published_at", "has_video", "thumbnail", F.col("metrics.likes").alias("likes"), F.size("comments").cast("long").alias("answers"),
        F.col("comments_complete").alias("complete"), F.array_join("warnings", ",").alias("warnings"),
    )


@query(f"""
WITH r AS (
  SELECT c_custkey AS page_id, j, 'Ann Lee' AS author, 'answer ' || j || ' to ' || c_name AS text, CASE WHEN j % 2 = 1 THEN 5 END AS likes, TIMESTAMP '{NOW}' - to_seconds(j * 3600) AS "at", j || ' hours ago' AS said_at
  FROM customer JOIN (VALUES (1), (2)) AS n(j) ON j <= c_custkey % 3
  UNION ALL SELECT c_custkey, 9, 'Origin', 'an older word', NULL, NULL, NULL FROM customer WHERE c_custkey % 10 = 3
)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY j) AS place, author, text, CAST(likes AS BIGINT) AS likes, "at", said_at FROM r
""")
def unit_comments(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("page_id", "post").orderBy("position")).cast("long")
    return comment_rows(_read(spark, sf_dir)).select("page_id", place.alias("place"), "author", "text", "likes", "at", "said_at")


@query(f"""
WITH u AS (
  SELECT p_partkey AS k, 1 AS j, p_brand AS author, NULL AS post, 0 AS hours FROM part
  UNION ALL SELECT p_partkey, 2, NULL, p_partkey, 1 FROM part WHERE p_partkey % 2 = 1
  UNION ALL SELECT p_partkey, 3, 'In', p_partkey + 1, 2 FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, j, CASE j WHEN 4 THEN 'Abe' ELSE 'Bea' END, p_partkey + j, j FROM part, (VALUES (4), (5)) AS n(j) WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, 6, 'Out', p_partkey + 6, 6 FROM part WHERE p_partkey % 6 = 0
)
SELECT k AS page_id, row_number() OVER (PARTITION BY k ORDER BY j) AS place, author, 'https://h.example/groups/7/posts/' || post || '/' AS link,
  CASE WHEN j > 1 THEN TIMESTAMP '{NOW}' - to_seconds(hours * 3600) END AS "at", CASE j WHEN 1 THEN 'missing' WHEN 2 THEN 'own' ELSE 'header' END AS source FROM u
""")
def feed_units(spark, sf_dir):
    """Posts of pages where most are plain boxes: by their place in the feed, by a link to a post, as articles in a wrapper and in a region."""
    key = F.col("p_partkey")
    link = lambda n, hours: ('<a href="/groups/7/posts/', key + n, f'/">{hours}h</a>')
    parts = (
        '<html><body><div role="main"><div><h2><a href="/Maker">', F.col("p_brand"), '</a></h2><div dir="auto">makes ', F.col("p_name"), " and many other things of this kind</div></div>",
        "<div><h2>no author</h2>a long text that nobody has signed and that has no link to a post</div><div>short</div>", _if(key % 2 == 1, "<section><p>", *link(0, 1), " linked</p></section>"),
        _if(key % 3 == 0, '<div><div role="article"><h3><a href="/In">In</a></h3>', *link(1, 2), "<p>inner</p></div></div>"),
        _if(key % 4 == 0, '<div role="article"><div role="article"><strong><a href="/Abe">Abe</a></strong>', *link(4, 4), '</div><div role="article"><h4><a href="/Bea">Bea</a></h4>', *link(5, 5), "</div></div>"),
        _if(key % 6 == 0, '<div role="article"><h3><a href="/Out">Out</a></h3>', *link(6, 6), '<div role="article"><h4><a href="/Shared">Shared</a></h4>', *link(7, 7), "</div></div>"), "</div></body></html>",
    )
    pages = table(spark, sf_dir, "part").select(key.alias("page_id"), F.lit("https://h.example/groups/7/").alias("url"), _markup(*parts).alias("html"))
    found = read_units(pages, F.lit(NOW).cast("timestamp"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("unit")).cast("long")
    return found.select("page_id", place.alias("place"), F.col("author.name").alias("author"), "link", F.col("published.at").alias("at"), F.col("published.source").alias("source"))


@query(r"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets, min(regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || href) AS least, max(regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || href) AS greatest FROM a GROUP BY page_id
""")
def page_links(spark, sf_dir):
    """The links of the given pages, which are relative, as the browser would follow them."""
    read = parsed_pages(table(spark, sf_dir, "pages"))
    href = F.transform(F.filter("nodes", lambda n: (n["tag"] == "a") & n["href"].isNotNull()), lambda n: n["href"])
    each = read.select("page_id", F.explode_outer(href).alias("href")).where("href is not null")
    return each.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"), F.min("href").alias("least"), F.max("href").alias("greatest"))
