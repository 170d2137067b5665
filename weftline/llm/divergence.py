"""Source divergence audit: how far the term shares of a language's sources lie apart, in relations only.

1. A text's terms are exploded and counted by (lang, source, term) with a map-side combine, together with the number of
   documents that hold them; the terms of a language that enough of its documents hold are kept.
2. Each group (lang, source) meets each kept term of its language, so that terms it lacks count as zeros. Terms are dealt
   to `SPREAD` parts of a language, each of which gets a copy of the language's groups.
3. The dense table meets itself on (lang, term), each two sources once; differences are summed, and windows rank.

Edge cases: null texts, languages and sources count as ''; a group without terms has the shares of zeros; in a language
without kept terms all sources differ by 0 and no term is listed; repeated rows count as often as they come; ties go to the
item of smaller UTF-8; an empty table gives an empty result; a language of one source has no pairs; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import free, materialise

TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
SPREAD = 64  # parts of a language's kept terms


def _known(docs: DataFrame, name: str) -> Column:
    return F.coalesce(docs[name].cast("string"), F.lit("")).alias(name)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences in the group's texts, and how many of them hold the term.

    The matches of TERM are the pieces between those of BETWEEN; splitting there takes a ninth of the time of extracting them.
    """
    folded = F.translate(F.coalesce(docs["text"].cast("string"), F.lit("")), UPPER, LOWER)
    terms = docs.select(_known(docs, "lang"), _known(docs, "source"), F.sort_array(F.split(folded, BETWEEN)).alias("terms"))
    # Equal terms of a text stand together: one that differs from the term before it is the text's first of its kind.
    before = F.concat(F.array(F.lit("")), F.slice("terms", 1, F.greatest(F.size("terms") - 1, F.lit(0))))
    # The outer form, as the other one has a filter on the size added, which would split each text a second time.
    each = terms.select("lang", "source", F.inline_outer(F.arrays_zip(F.col("terms").alias("term"), before.alias("before")))).where("term <> ''")
    new = F.sum((F.col("term") != F.col("before")).cast("long"))
    return each.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), new.alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), in whole numbers of any size."""
    least = (1 << 63) // SCALE - PRIOR - 1
    narrow = f"({n} + {PRIOR}) * {SCALE}L"
    wide = f"cast({n} + {PRIOR} as decimal(20,0)) * cast({SCALE} as decimal(10,0))"
    whole = f"({total} + {PRIOR} * {terms})"
    return F.expr(f"1 + CASE WHEN {n} < {least} THEN ({narrow}) div {whole} ELSE ({wide}) div {whole} END")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, spread: int = SPREAD) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: the summed differences to each other source of the language; part
    `term`: the `top` kept terms of the group that stand furthest above their language's share."""
    counts = materialise(term_counts(docs), "terms")
    enough = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term")
    kept = materialise(counts.select("lang", "source", "term", "n").join(enough, ["lang", "term"]), "kept")
    free(counts)
    words = kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    sizes = words.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = docs.select(_known(docs, "lang"), _known(docs, "source")).distinct()
    groups = found.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = materialise(groups.select("lang", "source", "total", "terms", "lang_total"), "groups")

    # An empty term, which no text has, adds 0 to every pair, so that pairs without kept terms have their row as well.
    listed = words.select("lang", "term").unionByName(groups.select("lang", F.lit("").alias("term")).distinct())
    dealt = listed.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(spread)))
    copies = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    dense = dealt.join(copies, ["lang", "part"]).join(kept, ["lang", "source", "term"], "left").na.fill(0, ["n"])
    dense = dense.select("lang", "term", "source", F.when(F.col("term") == "", F.lit(0).cast("long")).otherwise(share("n", "total", "terms")).alias("p"))
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    met = dense.join(other, ["lang", "term"]).where(F.col("source") < F.col("item"))
    apart = met.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    both = apart.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    of_group = kept.join(groups, ["lang", "source"]).join(words, ["lang", "term"])
    above = share("n", "total", "terms") - share("lang_n", "lang_total", "terms")
    terms = of_group.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}
), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n,
    1 + (CAST({SCALE} AS HUGEINT) * (n + {PRIOR})) // (sum(n) OVER w + {PRIOR} * count(*) OVER w) AS p,
    1 + (CAST({SCALE} AS HUGEINT) * (total + {PRIOR})) // (sum(total) OVER w + {PRIOR} * count(*) OVER w) AS q
  FROM e WINDOW w AS (PARTITION BY lang, source)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), v AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM v) WHERE part = 'pair' OR rank <= {TOP}
"""
