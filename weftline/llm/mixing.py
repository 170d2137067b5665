"""Mixing sources to target weights: equal-token blocks apportioned by the highest quotients of Sainte-Laguë.

1. Sizes are summed by source. Sources by code point (null last) take the weights in turn; each gets its share of all words, at
   most `limit` times its own size; what is over is shared among the others by weight: all end at the least of that limit and
   one common level times the weight.
2. Blocks have one number of words, at most a thousandth of the least target. The seats, as many as blocks fit into all
   targets, go to sources by the highest quotients target / (2 k + 1), and a source's seats to its shards alike by their words.
3. A source's documents are dealt to shards by a seeded hash and laid end to end in a seeded order, and that line is cut into
   blocks. A shard with q seats and n blocks takes every block q div n times, and q mod n blocks once more, evenly spaced from
   a seeded start. How many words of a document the blocks hold is arithmetic on its place: no block is ever made a row.

A source has a shard for `shard_docs` documents, 10,000 at most, so that a hot source spreads over tasks and what is ranked for
one source stays small. A shard takes at most `limit` times its blocks, hence no document more than that.

Edge cases: null texts have size 0 and take nothing; sources without words have target 0; null ids are ids like others;
repeated rows share a place in the order and are alike in all that names them, so that reruns return the same rows; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD_PATTERN, materialise

SPACES = r"[\x20\x09-\x0D]+"
WEIGHTS, LIMIT, SEED = (5, 2, 1), 3, "mix"
MAX_BLOCK, LEAST_BLOCKS, SHARD_DOCS, MAX_SHARDS = 1_024, 1_000, 1_000, 10_000


def _drawn(*parts: Column | str) -> Column:
    """A number below 2 ** 60 that the parts name."""
    named = F.concat_ws(":", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def _div(a: Column, b: Column | str) -> Column:
    return F.call_function("div", a, F.col(b) if isinstance(b, str) else b)


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, name, size, draw: each document's words and its seeded number; name is '=' and the source, '' for null."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    name = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit(""))
    size = F.size(F.array_remove(F.split(text, SPACES), "")).cast("long")  # nine times as fast as counting matches of words
    return docs.select("doc_id", name.alias("name"), size.alias("size"), _drawn(F.lit(seed), docs["doc_id"], F.md5(text)).alias("draw"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """name, source_size, docs, target of (name, source_size, docs). One row a source, ranked as one small table.

    By the ratio of limit to weight, the level that is left once all before are at their limit rises to the common one and
    falls after it.
    """
    last = F.col("name") == ""
    turn = F.row_number().over(Window.orderBy(last, "name"))
    weighed = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (turn - 1) % len(weights)).cast("double")).withColumn("most", F.col("source_size") * limit)
    every = Window.partitionBy()
    so_far = Window.orderBy(F.col("most") / F.col("weight"), last, "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.sum("source_size").over(every) - (F.sum("most").over(so_far) - F.col("most"))
    others = F.sum("weight").over(every) - F.sum("weight").over(so_far) + F.col("weight")
    met = weighed.withColumn("level", left / others).withColumn("level", F.max("level").over(every))
    return met.select("name", "source_size", "docs", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def apportioned(rows: DataFrame, votes: str, seats: str, group: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Adds `quota`: of the group's seats, those of each row by the highest quotients votes / (2 k + 1), ties by `key`.

    With n rows and divisors votes / (seats ± n / 2) rounding gives at most the seats, or at least; so all rows get what the greater
    divisor gives, and of a group only the next quotients, no more than 2 n, are ranked. Rows without votes get none.
    """
    every = Window.partitionBy(*group)
    n, total = F.count(F.when(F.col(votes) > 0, 1)).over(every), F.sum(votes).over(every)
    low, high = F.greatest(F.col(seats) - n / 2, F.lit(0.0)), F.col(seats) + n / 2
    least, most = (F.coalesce(F.floor(F.try_divide(F.col(votes) * x, total) + 0.5), F.lit(0)).cast("long") for x in (low, high))
    base = rows.withColumn("quota_least", least).withColumn("quota_most", F.greatest(most, F.col("quota_least")))
    base = base.withColumn("quota_open", F.col(seats) - F.sum("quota_least").over(every))
    more = F.when((F.col("quota_most") > F.col("quota_least")) & (F.col(votes) > 0), F.sequence(F.col("quota_least") + 1, F.col("quota_most")))
    each = base.withColumn("seat", F.explode_outer(more))
    quotient = F.col(votes) / (2 * F.col("seat") - 1)
    place = F.row_number().over(every.orderBy(quotient.desc_nulls_last(), *(c for k in key for c in (F.col(k).isNull(), F.col(k))), "seat"))
    taken = each.withColumn("won", (place <= F.col("quota_open")) & F.col("seat").isNotNull())
    out = taken.groupBy(*rows.columns).agg((F.first("quota_least") + F.sum(F.col("won").cast("long"))).alias("quota"))
    return out


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT, seed: str = SEED,
    max_block: int = MAX_BLOCK, least_blocks: int = LEAST_BLOCKS, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    rows = materialise(sized(docs, seed), "sized")
    sizes = rows.groupBy("name").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    aims = targets(sizes, weights, limit)
    every = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    aims = aims.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(max_block), F.floor(least / least_blocks))).cast("long"))
    aims = aims.withColumn("seats", F.round(F.sum("source_size").over(every) / F.col("block")).cast("long"))
    shares = apportioned(aims, "target", "seats", (), ("name",)).drop("seats").withColumnRenamed("quota", "seats")
    shares = materialise(shares.withColumn("shards", F.least(F.lit(MAX_SHARDS), F.ceil(F.col("docs") / shard_docs))), "aims")

    dealt = rows.join(shares.select("name", "shards"), "name").select("doc_id", "name", "size", "draw", F.pmod("draw", "shards").alias("shard"))
    shards = dealt.groupBy("name", "shard").agg(F.sum("size").alias("words")).join(shares.drop("docs", "shards"), "name")
    plan = apportioned(shards, "words", "seats", ("name",), ("shard",))
    full = F.ceil(F.col("words") / F.col("block")).cast("long")
    plan = plan.withColumn("blocks", F.greatest(full, F.lit(1))).withColumn("quota", F.least(F.col("quota"), full * limit))
    plan = plan.withColumn("start", F.pmod(_drawn(F.lit(seed), "name", "shard"), F.col("blocks")))
    plan = plan.select("name", "shard", "source_size", "target", "block", "blocks", "quota", "start")

    line = Window.partitionBy("name", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(plan, ["name", "shard"]).withColumn("end", F.sum("size").over(line))
    rest = F.col("quota") % F.col("blocks")

    def chosen(x: Column) -> Column:
        """How many of the x blocks from the seeded start on are taken once more."""
        return _div((F.col("start") + x) * rest, "blocks") - _div(F.col("start") * rest, "blocks")

    def words(x: Column) -> Column:
        """How many of the line's first x words are taken once more."""
        full = _div(x, "block")
        return F.col("block") * chosen(full) + (x - full * F.col("block")) * (chosen(full + 1) - chosen(full))

    once_more = words(F.col("end")) - words(F.col("end") - F.col("size"))
    taken = _div(F.col("quota"), "blocks") * F.col("size") + once_more
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op13_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_BY_WEIGHT = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))


def _drawn_sql(named: str) -> str:
    return f"CAST('0x' || substr(md5({named}), 1, 15) AS BIGINT)"


#: All quotients of all seats are ranked here, where the operator ranks the open ones only.
OP13_SQL = f"""
WITH r AS (
  SELECT doc_id, coalesce('=' || source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}')) AS size,
    {_drawn_sql(f"'{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))")} AS draw FROM documents
), s AS (SELECT name, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM r GROUP BY name),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY name = '', name) - 1) % {len(WEIGHTS)} {_BY_WEIGHT} END AS DOUBLE) AS weight, {LIMIT} * source_size AS most FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - (sum(most) OVER o - most)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, name = '', name ROWS UNBOUNDED PRECEDING)
), t AS (SELECT name, source_size, docs, least(CAST(most AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
b AS (SELECT *, CAST(greatest(1, least({MAX_BLOCK}, floor(coalesce(min(target) FILTER (target > 0) OVER (), 0) / {LEAST_BLOCKS}))) AS BIGINT) AS block FROM t),
a AS (SELECT *, CAST(round(sum(source_size) OVER () / block) AS BIGINT) AS all_seats, least({MAX_SHARDS}, ceil(docs / {SHARD_DOCS})) AS shards FROM b),
q AS (SELECT name, unnest(generate_series(1, CAST(ceil(target / block) AS BIGINT) + 50)) AS m, target, all_seats FROM a WHERE target > 0),
won AS (SELECT name, count(*) AS seats FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * m - 1) DESC, name, m) AS place FROM q) WHERE place <= all_seats GROUP BY name),
d AS (SELECT r.*, draw % CAST(shards AS BIGINT) AS shard FROM r JOIN a USING (name)),
h AS (SELECT name, shard, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY name, shard),
hq AS (SELECT name, shard, words, seats, unnest(generate_series(1, CAST(ceil(words * seats / source_size) AS BIGINT) + 50)) AS m FROM h JOIN a USING (name) JOIN won USING (name) WHERE words > 0),
hw AS (SELECT name, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY words / (2 * m - 1) DESC, shard, m) AS place FROM hq) WHERE place <= seats GROUP BY name, shard),
p AS (
  SELECT name, shard, block, greatest(1, CAST(ceil(words / block) AS BIGINT)) AS blocks, least(coalesce(quota, 0), {LIMIT} * CAST(ceil(words / block) AS BIGINT)) AS quota,
    {_drawn_sql(f"'{SEED}:' || name || ':' || CAST(shard AS VARCHAR)")} % greatest(1, CAST(ceil(words / block) AS BIGINT)) AS start, source_size, target
  FROM h JOIN a USING (name) LEFT JOIN hw USING (name, shard)
), e AS (SELECT d.doc_id, d.size, p.*, CAST(sum(size) OVER (PARTITION BY name, shard ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM d JOIN p USING (name, shard)),
f AS (SELECT *, quota % blocks AS rest, hi // block AS hi_full, (hi - size) // block AS lo_full FROM e),
g AS (
  SELECT *, (start + hi_full) * rest // blocks - start * rest // blocks AS hi_c, (start + hi_full + 1) * rest // blocks - (start + hi_full) * rest // blocks AS hi_d,
    (start + lo_full) * rest // blocks - start * rest // blocks AS lo_c, (start + lo_full + 1) * rest // blocks - (start + lo_full) * rest // blocks AS lo_d FROM f
)
SELECT doc_id, size, source_size, target,
  CAST(quota // blocks * size + block * (hi_c - lo_c) + (hi - hi_full * block) * hi_d - (hi - size - lo_full * block) * lo_d AS BIGINT) AS taken FROM g
"""
