"""Queries of merges, cutoffs, streaks and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import cutoff, identity, merge
from weftline.plans.registry import SQL, query, table


@query("""
WITH firsts AS (SELECT user_id, event_type, min(event_id) AS seq FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2),
tags AS (SELECT user_id, string_agg(event_type, ',' ORDER BY seq) AS tags FROM firsts GROUP BY 1)
SELECT e.user_id, count(*) AS readings, max(value) AS value, arg_min(event_type, event_id) AS first_type,
  arg_max(event_type, event_id) AS last_type, max(tags) AS tags
FROM events e LEFT JOIN tags t ON e.user_id = t.user_id WHERE e.user_id IS NOT NULL GROUP BY 1
""")
def merge_readings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.col("event_type").alias("first_type"), F.col("event_type").alias("last_type"))
    merged = merge.merge_readings(rows, "user_id", "event_id", most=["value"], first=["first_type"], last=["last_type"])
    tags = merge.ordered_union(rows, "user_id", "event_id", "first_type").select("user_id", F.array_join("values", ",").alias("tags"))
    return merged.join(tags, "user_id", "left")


@query("""
SELECT lang, md5(arg_max(text, length(text) * 1000000000 - doc_id)) AS digest, max(length(text)) AS length, count(*) AS readings
FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY 1
""")
def longest_caption(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null")
    merged = merge.merge_readings(rows, "lang", "doc_id", long=["text"])
    return merged.select("lang", F.md5("text").alias("digest"), F.length("text").cast("long").alias("length"), "readings")


@query("""
WITH r AS (SELECT user_id, event_id, value, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS rank FROM events WHERE value IS NOT NULL)
SELECT user_id, arg_min(value, rank * 1000000000000 + event_id) AS value, min(rank) AS rank FROM r WHERE user_id IS NOT NULL GROUP BY 1
""")
def ranked_provenance(spark, sf_dir):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    rows = table(spark, sf_dir, "events").where("user_id is not null and value is not null").withColumn("rank", rank)
    best = rows.groupBy("user_id").agg(merge.best_ranked("value", "rank", "event_id").alias("x"))
    return best.select("user_id", "x.value", "x.rank")


@query("""
SELECT user_id, bool_or(coalesce(event_type = 'error', false)) AS failed, bool_or(coalesce(value > 400, false)) AS large FROM events WHERE user_id IS NOT NULL GROUP BY 1
""")
def reading_flags_or(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"), (F.col("value") > 400).alias("large"))
    return merge.merge_readings(rows, "user_id", "event_id", flags=["failed", "large"]).drop("readings")


@query("""
WITH f AS (SELECT source, lang, min(doc_id) AS seq FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2)
SELECT source, string_agg(lang, ',' ORDER BY seq) AS langs FROM f GROUP BY 1
""")
def tag_union(spark, sf_dir):
    return merge.ordered_union(table(spark, sf_dir, "documents"), "source", "doc_id", "lang").select("source", F.array_join("values", ",").alias("langs"))


@query("SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def cutoff_initial(spark, sf_dir):
    bound = F.lit("2024-01-20 00:00:00").cast("timestamp")
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.where(cutoff.after(F.col("ts"), bound)).select("event_id", "user_id", "ts")


@query("""
WITH seen AS (SELECT user_id, max(ts) AS last_seen FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT e.event_id, e.user_id FROM events e LEFT JOIN seen s ON e.user_id = s.user_id
WHERE e.ts >= coalesce(s.last_seen - INTERVAL 48 HOUR, TIMESTAMP '2024-01-10 00:00:00')
""")
def cutoff_incremental(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    seen = rows.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    bound = cutoff.cutoff_of(F.col("last_seen"), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return rows.join(seen, "user_id", "left").where(cutoff.after(F.col("ts"), bound)).select("event_id", "user_id")


@query("""
WITH m AS (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '1997-08-01' THEN 1 ELSE 0 END AS old,
  sum(CASE WHEN o_orderdate >= TIMESTAMP '1997-08-01' THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS island FROM orders),
s AS (SELECT *, sum(old) OVER (PARTITION BY o_orderpriority, island ORDER BY o_orderkey) AS streak FROM m),
t AS (SELECT *, max(CASE WHEN streak >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS stopped FROM s)
SELECT o_orderpriority, o_orderkey FROM t WHERE stopped = 0 AND old = 0
""")
def cutoff_streak(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return cutoff.until_streak(rows, "o_orderpriority", "o_orderkey", "at", F.lit("1997-08-01").cast("timestamp")).drop("at")


@query(SQL["cutoff_streak"])
def cutoff_streak_in_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    return cutoff.until_streak_in_parts(rows, "o_orderpriority", "o_orderkey", "at", F.lit("1997-08-01").cast("timestamp"), width=1_000).drop("at")


@query("""
WITH t AS (SELECT conv_id, turn, role || turn AS author, text, conv_id % 2 = 0 AS longer FROM conversations),
n AS (SELECT conv_id, count(*) FILTER (longer OR turn % 3 = 0) AS newer, count(*) FILTER (NOT longer OR turn % 3 <> 0) AS older FROM t GROUP BY conv_id),
b AS (SELECT t.*, (longer OR turn % 3 = 0) AS in_newer, (NOT longer OR turn % 3 <> 0) AS in_older, newer >= older AS newer_leads FROM t JOIN n USING (conv_id))
SELECT conv_id, author, text, CASE WHEN in_newer AND in_older AND newer_leads THEN greatest(10, turn) WHEN in_newer AND in_older THEN turn WHEN in_newer THEN 10 ELSE turn END AS likes,
  row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN newer_leads THEN NOT in_newer ELSE NOT in_older END, turn) - 1 AS place,
  CASE WHEN in_older AND (turn % 2 = 0) THEN 'first' WHEN in_newer AND (newer_leads OR NOT in_older) THEN 'second' END AS "at" FROM b
""")
def thread_fold(spark, sf_dir):
    """Two readings of each conversation: of even ones the second is whole and the first has gaps, of odd ones the other way round."""
    rows = table(spark, sf_dir, "conversations").withColumn("longer", F.col("conv_id") % 2 == 0)
    said = (F.concat("role", F.col("turn").cast("string")).alias("author"), "text")
    older = rows.where("not longer or turn % 3 <> 0").select("conv_id", F.lit(1).alias("seq"), "turn", *said, F.col("turn").alias("likes"), F.when(F.col("turn") % 2 == 0, "first").alias("at"))
    newer = rows.where("longer or turn % 3 = 0").select("conv_id", F.lit(2).alias("seq"), "turn", *said, F.lit(10).cast("long").alias("likes"), F.lit("second").alias("at"))
    return merge.folded_threads(older.unionByName(newer), "conv_id", "seq", "turn").select("conv_id", "author", "text", "likes", F.col("place").cast("long").alias("place"), "at")


@query("""
SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY CASE WHEN o_custkey % 3 = 0 THEN o_custkey // 30 ELSE -o_orderkey - 1 END) AS record FROM orders
""")
def record_groups(spark, sf_dir):
    """Orders of ten neighbouring customers are one record, over a chain of keys from each customer to the next; other orders are their own."""
    cust = F.col("o_custkey")
    link = lambda k: F.concat(F.lit("c"), k.cast("string"))
    chain = F.array(link(cust), F.when(cust % 30 != 27, link(cust + 3)), F.lit(""))
    chained = table(spark, sf_dir, "orders").select("o_orderkey", F.when(cust % 3 == 0, chain).otherwise(F.array(F.lit(None).cast("string"))).alias("keys"))
    # Customers without orders would break the chain: each has one entry of its own, above all orders.
    bridges = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") + 10_000_000_000).alias("o_orderkey"), F.array(link(F.col("c_custkey")), F.when(F.col("c_custkey") % 30 != 27, link(F.col("c_custkey") + 3))).alias("keys"))
    return identity.same_record(chained.unionByName(bridges), "o_orderkey", "keys").where("o_orderkey < 10000000000")


@query("""
SELECT o_orderkey, o_orderpriority, array_to_string(list_sort(list_filter(
  [CASE WHEN o_totalprice > 250000 THEN NULL ELSE 'price:missing' END, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'status:unresolved' END, 'order:random'],
  lambda x: x IS NOT NULL)), ',') AS warnings FROM orders
""")
def warnings_prune(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("all", F.array(*map(F.lit, ("price:missing", "status:unresolved", "order:random", "price:missing"))))
    left = merge.pruned_warnings(F.col("all"), {"price": F.col("o_totalprice") > 250_000, "status": F.col("o_orderstatus") == "F"})
    return rows.select("o_orderkey", "o_orderpriority", F.array_join(F.array_sort(left), ",").alias("warnings"))
