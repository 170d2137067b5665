"""Queries of joins, set operations, threads, queues and delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import head_key, skeleton
from weftline.operators.posts import largest_of
from weftline.operators import cutoff, merge, queue, resolve, sink, status, threads
from weftline.plans.registry import query, table
from weftline.sources import json_payload


@query("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 300000)")
def skip_uploaded(spark, sf_dir):
    sent = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return queue.unsent(table(spark, sf_dir, "customer").select("c_custkey"), sent, "c_custkey")


@query("""
WITH k AS (SELECT s_suppkey, 1 AS p, lower(s_name) AS key FROM supplier UNION ALL SELECT s_suppkey, 2, lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey),
o AS (SELECT lower(n_name) AS key, n_nationkey AS value FROM nation UNION ALL SELECT lower(s_name), 1000 + s_suppkey FROM supplier WHERE s_acctbal < 0),
u AS (SELECT key, min(value) AS value FROM o GROUP BY 1)
SELECT s_suppkey, arg_min(value, p) AS value, min(p) AS priority FROM k JOIN u ON k.key = u.key GROUP BY 1
""")
def outlet_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    left = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    named = nation.select(F.lower("n_name").alias("key"), F.col("n_nationkey").cast("long").alias("value"))
    own = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.lower("s_name"), F.col("s_suppkey") + 1_000)
    found = resolve.priority_lookup(left, "s_suppkey", [F.lower("s_name"), F.lower("n_name")], named.union(own), "key", "value")
    return found.select("s_suppkey", "value", (F.col("priority") + 1).alias("priority"))


@query("""
WITH u AS (SELECT o_custkey AS key, min(o_orderkey) AS value FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
k AS (SELECT c_custkey, 0 AS p, c_custkey + 100000 AS key FROM customer UNION ALL SELECT c_custkey, 1, c_custkey FROM customer)
SELECT c_custkey, arg_min(value, p) AS value, min(p) AS priority FROM k JOIN u ON k.key = u.key GROUP BY 1
""")
def priority_key_lookup(spark, sf_dir):
    right = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return resolve.priority_lookup(table(spark, sf_dir, "customer"), "c_custkey", [F.col("c_custkey") + 100_000, F.col("c_custkey")], right, "o_custkey", "o_orderkey")


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS bare FROM documents),
b AS (SELECT item_id, left(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g'), 40) AS head FROM benchmark WHERE length(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) >= 20),
u AS (SELECT head, min(item_id) AS item_id FROM b GROUP BY 1 HAVING count(DISTINCT item_id) = 1)
SELECT doc_id AS unit, min(item_id) AS id FROM d JOIN u ON contains(d.bare, u.head) GROUP BY 1 HAVING count(DISTINCT item_id) = 1
""")
def head_text_join(spark, sf_dir):
    heads = resolve.heads_of(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return resolve.contained_heads(table(spark, sf_dir, "documents"), "doc_id", "text", heads)


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS bare FROM documents)
SELECT left(bare, 40) AS head, min(doc_id) AS doc_id, count(*) AS docs FROM d WHERE length(bare) >= 20 GROUP BY 1 HAVING count(*) > 1
""")
def head_dup_groups(spark, sf_dir):
    heads = table(spark, sf_dir, "documents").select("doc_id", head_key(skeleton(F.col("text"))).alias("head")).where("head is not null")
    return heads.groupBy("head").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("docs")).where("docs > 1")


@query("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS kind FROM customer)
SELECT k AS unit, CAST(k AS VARCHAR) AS id, CASE kind WHEN 1 THEN 'reshare' WHEN 2 THEN 'author' ELSE 'text' END AS source FROM c WHERE kind < 4 AND NOT (k % 15 = 0 AND k + 5 <= (SELECT max(k) FROM c))
""")
def story_match(spark, sf_dir):
    """Customers' payloads against units that show them: own texts, wide letters, tails only, shared texts, authors; texts of two stories and
    authors of many match none."""
    key, name, kind = F.col("c_custkey"), F.col("c_name"), F.col("c_custkey") % 5
    text = lambda k: F.concat(F.lit("Customer no. "), F.lpad(k.cast("string"), 9, "0"), F.lit(" sells what the market asks for, under number "), F.lpad(k.cast("string"), 9, "0"), F.lit("!"))
    quoted = lambda x: F.concat(F.lit('{"message": {"text": "'), x, F.lit('"}}'))
    own = F.concat(F.lit('{"data": [{"post_id": '), key, F.lit(', "message": {"text": "'), text(key), F.lit('"}, "feedback": {"comments": [{"post_id": 7, "message": {"text": "a long answer that is no story of its own"}}]}}]}'))
    shared = F.concat(F.lit('{"node": {"story_fbid": "'), key, F.lit('", "comments": ['), quoted(F.lit("an answer that is not what is shared here")), F.lit('], "attached_story": '), quoted(text(key)), F.lit("}}"))
    silent = F.concat(F.lit('{"post_id": '), key, F.lit(', "message": {"text": "hi"}, "actors": [{"id": "x"}, {"id": '), F.when(kind == 2, key + 9_000_000).otherwise(F.lit(1)), F.lit("}]}"))
    payload = F.when(kind.isin(0, 3), own).when(kind == 1, shared).otherwise(silent)
    wide = F.when(key % 10 == 0, F.replace(F.upper(text(key)), F.lit("C"), F.lit("\uff23"))).otherwise(text(key))
    both = F.when(key % 15 == 0, F.concat(wide, F.lit("\n"), text(key + 5))).otherwise(wide)
    shown = F.when(kind == 3, F.right(text(key), F.lit(55))).when(kind < 2, F.concat(name, F.lit("\n"), both)).otherwise(F.concat(F.lit("seen "), name, F.lit(" say hi")))
    rows = table(spark, sf_dir, "customer").select(key.alias("unit"), payload.alias("payload"), shown.alias("shown"), F.when(kind == 2, key + 9_000_000).otherwise(F.lit(1)).alias("author"))
    return resolve.matched_stories(rows, "unit", "shown", "author", json_payload.story_rows(rows, "payload", "unit"))


@query("SELECT n_chars AS author, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) = 1")
def unique_author_fallback(spark, sf_dir):
    return resolve.unique_by(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("author"), "doc_id"), "author", "doc_id")


@query("SELECT source AS claim, lang, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def id_claim_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.struct("source", "lang").alias("claim"), "doc_id")
    return resolve.claimed_once(rows, "claim", "doc_id").select(F.col("claim.source").alias("claim"), F.col("claim.lang").alias("lang"), "doc_id")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.l_orderkey = a.l_orderkey AND b.s < a.s AND b.e >= a.e)
""")
def containment_antijoin(spark, sf_dir):
    start = F.col("l_linenumber") * 10
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("s"), (start + F.col("l_quantity").cast("int")).alias("e"))
    return resolve.outermost(rows, "l_orderkey", "s", "e").select("l_orderkey", "l_linenumber")


@query("SELECT p_brand, arg_max(p_partkey, CAST(p_size AS BIGINT) * 100000000 - p_partkey) AS p_partkey, max(p_size) AS size FROM part WHERE p_size >= 10 GROUP BY 1")
def largest_media(spark, sf_dir):
    """The largest of each stretch of keys, then of these: no list holds a whole brand."""
    def largest(rows, *by):
        pictures = F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("url"), (F.col("p_size") * 1_000).cast("double").alias("area"))))
        found = rows.groupBy(*by).agg(pictures.alias("pictures")).select(*by, largest_of(F.col("pictures")).alias("x")).where("x is not null")
        return found.select(*by, F.col("x.url").alias("p_partkey"), (F.col("x.area") / 1_000).cast("int").alias("p_size"))

    rows = table(spark, sf_dir, "part").select("p_brand", F.floor(F.col("p_partkey") / 10_000).alias("stretch"), "p_partkey", "p_size")
    return largest(largest(rows, "p_brand", "stretch"), "p_brand").withColumnRenamed("p_size", "size")


@query("""
WITH r AS (SELECT conv_id, role, text, turn, turn % 2 AS seq, length(text) AS likes FROM conversations)
SELECT conv_id, role, text, max(likes) AS likes FROM r GROUP BY 1, 2, 3
""")
def thread_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "text", "turn", (F.col("turn") % 2).alias("seq"), F.length("text").cast("long").alias("likes"), F.lit(None).cast("timestamp").alias("at"))
    return merge.merge_comments(rows, ["conv_id", "role", "text"], "seq", "turn", "likes", "at").select("conv_id", "role", "text", "likes")


@query("SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place <= 3")
def thread_top_n(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (-F.col("turn")).alias("back"))
    return threads.capped(rows, "conv_id", "back", 3).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, max(turn) + 1 AS expected FROM conversations GROUP BY 1)
SELECT conv_id, n, n >= expected AS complete, least(expected, 100) AS target, least(greatest(CAST(ceil(least(expected, 100) / 10.0) AS INTEGER) * 4, 8), 90) AS budget FROM c
""")
def thread_complete(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), (F.max("turn") + 1).alias("expected"))
    goal = threads.target(F.col("expected"), 100)
    done = threads.is_complete(F.col("n"), F.col("expected"), F.lit(False))
    return rows.select("conv_id", "n", done.alias("complete"), goal.alias("target"), threads.budget_seconds(goal).alias("budget"))


@query("""
WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'not_waiting' WHEN r.l_orderkey IS NOT NULL THEN 'result'
  WHEN o_orderkey % 3 <> 0 AND o_orderkey % 90 >= 60 THEN 'comments:worker_lost' WHEN o_orderkey % 3 = 0 AND o_orderkey % 4000 >= 2400 THEN 'comments:worker_timeout' END AS reason
FROM orders LEFT JOIN r ON o_orderkey = r.l_orderkey
""")
def hold_release(spark, sf_dir):
    results = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("there", F.lit(True))
    rows = table(spark, sf_dir, "orders").join(results, "o_orderkey", "left")
    key = F.col("o_orderkey")
    is_owed = key % 3 == 0
    waited = F.when(is_owed, key % 4_000).otherwise(key % 90)
    reason = threads.release_reason(F.col("o_orderstatus") != "F", F.coalesce("there", F.lit(False)), is_owed, F.lit(30), waited)
    return rows.select("o_orderkey", reason.alias("reason"))


@query("""
WITH p AS (SELECT conv_id, min(turn) AS first_turn FROM conversations WHERE role = 'user' AND length(text) > 60 GROUP BY 1)
SELECT c.conv_id, c.turn, p.first_turn, p.conv_id IS NULL AS orphan FROM conversations c LEFT JOIN p ON c.conv_id = p.conv_id WHERE c.role = 'assistant'
""")
def late_parent_attach(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    parents = rows.where("role = 'user' and length(text) > 60").groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    return threads.with_late_parents(rows.where("role = 'assistant'").select("conv_id", "turn"), parents, "conv_id")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END,
  CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE '' END, o_orderkey) AS position FROM orders
""")
def queue_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("lane", F.ascii("o_orderpriority"))
    return queue.queue_position(rows, "o_custkey", F.col("o_orderstatus") == "P", "lane", "o_orderkey").select("o_orderkey", F.col("position").cast("long").alias("position"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def queue_owed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    own = [orders.where("o_orderstatus = 'P'"), orders.where("o_orderpriority = '1-URGENT'"), table(spark, sf_dir, "customer").where("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey")]
    return queue.owed(*(x.select(F.col("o_custkey").alias("id")) for x in own))


@query("""
SELECT n_nationkey AS c, true AS upload, s AS release, s AS clear, s AS stopped FROM (
  SELECT n_nationkey, (n_nationkey % 2 = 0) AND NOT ((n_nationkey % 3 + n_nationkey % 5) > 0 AND n_nationkey % 7 > 0) AS s FROM nation)
""")
def drain_settle(spark, sf_dir):
    n = F.col("n_nationkey")
    out = threads.settled(n % 3, F.lit(0), n % 5, n % 7, n % 2 == 0)
    return table(spark, sf_dir, "nation").select(n.alias("c"), out.alias("x")).select("c", "x.*")


@query("SELECT count(*) AS orders, true AS capped, true AS gapless FROM orders")
def ingest_batches(spark, sf_dir):
    """Batch numbers are free, their rules are not: at most 25 rows, numbered without gaps."""
    dealt = queue.batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    sizes = dealt.groupBy("batch").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("orders"), (F.max("n") <= 25).alias("capped"), (F.max("batch") + 1 == F.count("*")).alias("gapless"))


@query("""
WITH b AS (SELECT o_custkey AS batch, sum(CASE WHEN o_totalprice > 499900 THEN 1 ELSE 0 END) AS rejected FROM orders GROUP BY 1)
SELECT batch, rejected FROM b WHERE batch < coalesce((SELECT min(batch) FROM b WHERE rejected > 0), 9000000000)
""")
def accepted_batches(spark, sf_dir):
    results = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.count_if(F.col("o_totalprice") > 499_900).alias("rejected"))
    return queue.accepted_prefix(results, "batch", "rejected")


@query("""
WITH o AS (SELECT o_custkey AS c_custkey, max(o_orderkey) AS version FROM orders GROUP BY 1)
SELECT c.c_custkey, coalesce(o.version, -1) AS version FROM customer c LEFT JOIN o ON c.c_custkey = o.c_custkey
UNION SELECT c_custkey, version FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def idempotent_upsert(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select("c_custkey", F.lit(-1).cast("long").alias("version"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("version"))
    once = sink.upserted(stored, new, "c_custkey", "version")
    return sink.upserted(once, new, "c_custkey", "version")


@query("""
SELECT user_id, round(CASE WHEN max(ts) >= min(ts) THEN epoch_us(max(ts)) - epoch_us(min(ts)) END / 1e6, 3) AS seconds, count(*) FILTER (WHERE event_type = 'error') AS errors,
  max(CASE WHEN event_type = 'purchase' THEN ts END) IS NOT NULL AS new_clock FROM events GROUP BY 1
""")
def status_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sums = rows.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("end"))
    clock = status.starts_new_clock(F.lit(False), F.col("a"), F.col("end"))
    return sums.select("user_id", F.round(status.phase_seconds(F.col("a"), F.col("b")), 3).alias("seconds"), "errors", clock.alias("new_clock"))


@query("""
WITH e AS (SELECT o_custkey AS record, o_orderkey AS key, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS seen, o_orderstatus = 'P' AS cut, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS hold FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY seen NULLS FIRST, key) AS n FROM e)
SELECT record, max(CASE WHEN n = 1 THEN key END) AS key, min(seen) AS seen, bool_or(cut) AS cut, arg_min(hold, n) FILTER (WHERE hold IS NOT NULL) AS hold, count(*) AS entries FROM r GROUP BY 1
""")
def adopted_entries(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("record"), key.alias("key"), F.when(key % 11 != 0, F.col("o_orderdate")).alias("seen"), (F.col("o_orderstatus") == "P").alias("cut"), F.when(key % 4 == 0, key).alias("hold")
    )
    return merge.adopted(rows, "record", "key", "seen", "cut", "hold")


@query("""
WITH f AS (SELECT user_id, event_type, min(event_id) AS seq FROM events GROUP BY 1, 2)
SELECT user_id, event_type, seq FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) <= 2
""")
def bounded_log(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"))
    return queue.newest(rows, "event_type", "seq", 2, "user_id")


@query("""
WITH n AS (SELECT o_custkey, max(o_orderkey % 3) AS epoch FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT o_orderkey, o.o_custkey, o_orderkey % 3 AS epoch FROM orders o LEFT JOIN n ON o.o_custkey = n.o_custkey WHERE o_orderkey % 3 = coalesce(n.epoch, 0)
""")
def fenced_writes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("epoch"), "o_orderstatus")
    return queue.fenced(rows.drop("o_orderstatus"), rows.where("o_orderstatus = 'P'").select("o_custkey", "epoch"), "o_custkey", "epoch")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN greatest(o_orderdate, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '1997-01-01' ELSE o_orderdate END) END::TIMESTAMP AS since FROM orders
""")
def restarted_clocks(spark, sf_dir):
    since = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate").cast("timestamp"))
    drain = F.when(F.col("o_orderkey") % 2 == 0, F.lit("1997-01-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", queue.restarted(since, drain).alias("since"))


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER w AS n, coalesce(l_quantity <= max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS still FROM t WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
e AS (SELECT a.l_orderkey, min(a.l_linenumber) AS ended FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND b.n = a.n - 1 WHERE a.still AND b.still GROUP BY 1)
SELECT r.l_orderkey, l_linenumber, l_quantity FROM r LEFT JOIN e ON r.l_orderkey = e.l_orderkey WHERE ended IS NULL OR l_linenumber <= ended
""")
def stagnant_rounds(spark, sf_dir):
    rounds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return cutoff.until_stagnant(rounds, "l_orderkey", "l_linenumber", "l_quantity")
