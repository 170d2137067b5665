"""Listings, orders and clocks of runs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import times
from weftline.operators import order, status
from weftline.plans.registry import query, table
from weftline.sources.outlets import listed_outlets


@query("""
WITH c AS (SELECT c_custkey // 100 AS run, c_custkey % 100 // 10 * 10 AS "offset", c_custkey % 10 AS place, c_custkey, c_name, c_nationkey FROM customer),
k AS (SELECT run, "offset" FROM (SELECT DISTINCT run, "offset" FROM c) WHERE NOT (run % 5 = 4 AND "offset" = 30))
SELECT c.run, "offset", place, 'H' || c_custkey AS handle, 'h' || c_custkey || ',' || c_custkey || ',n' || c_nationkey || ',s' || c_custkey AS keys,
  CASE c_custkey % 3 WHEN 0 THEN 'd' || c_custkey WHEN 1 THEN 'e' || c_custkey END AS last_discovered_at
FROM c JOIN k USING (run, "offset")
WHERE "offset" <= 80 AND NOT (run % 5 = 4 AND "offset" > 30) AND NOT (run % 3 = 1 AND "offset" > 50)
""")
def outlet_listing(spark, sf_dir):
    """Customers in answers of ten: some listings end early, lack a page, hold a page twice or name their outlets otherwise."""
    key = F.col("c_custkey")
    text = key.cast("string")
    outlet = F.struct(
        F.concat(F.lit("H"), text, F.lit("//")).alias("handle"), key.alias("externalId"), F.struct(F.struct(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("slug")).alias("group")).alias("metadata"),
        F.concat(F.lit("https://h.example/groups/s"), text, F.lit("/about?x=1")).alias("canonicalUrl"),
        F.when(key % 3 == 0, F.concat(F.lit("d"), text)).when(key % 3 == 2, "").alias("lastDiscoveredAt"), F.when(key % 3 == 1, F.concat(F.lit("e"), text)).alias("last_discovered_at"),
    )
    run, offset = F.floor(key / 100).cast("long"), F.floor(key % 100 / 10).cast("long") * 10
    rows = table(spark, sf_dir, "customer").groupBy(run.alias("run"), offset.alias("offset")).agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), outlet.alias("o")))), lambda x: x["o"]).alias("list"))
    paged = F.struct((~((F.col("run") % 3 == 1) & (F.col("offset") == 50))).alias("hasMore"), F.when(F.col("run") % 2 == 0, F.size("list")).alias("returned"))
    named = F.when(F.col("run") % 2 == 0, F.to_json(F.struct(F.col("list").alias("sources"), paged.alias("pagination")))).otherwise(F.to_json(F.struct(F.col("list").alias("items"), paged.alias("pagination"))))
    landed = rows.where(~((F.col("run") % 5 == 4) & (F.col("offset") == 30))).select("run", "offset", named.alias("body"))
    twice = landed.unionByName(landed.where("run % 2 = 0"))
    found = listed_outlets(twice, "run", "offset", "body", furthest=80)
    return found.select("run", "offset", F.col("place").cast("long").alias("place"), F.rtrim(F.col("outlet.handle"), F.lit("/")).alias("handle"), F.array_join("keys", ",").alias("keys"), "last_discovered_at")


@query("""
WITH o AS (SELECT o_orderkey AS k, epoch_ms(o_orderdate)::DOUBLE AS a FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 5 <> 0 THEN 60000.0 * (k % 9) END AS collect, CASE WHEN k % 5 <> 0 THEN 500.0 END AS drain, CASE WHEN k % 5 <> 0 THEN 250.0 * (k % 4) END AS store,
  CASE WHEN k % 5 <> 0 THEN 60000.0 * (k % 9) + 500 + 250.0 * (k % 4) END AS total FROM o WHERE k % 7 NOT IN (1, 2, 3)
UNION ALL SELECT k, NULL, NULL, NULL, NULL FROM o WHERE k % 7 IN (1, 2, 3)
""")
def run_timing(spark, sf_dir):
    """Clocks saved as JSON: whole ones, and some whose stamp is text, is missing or lies before its phase began."""
    key, start = F.col("o_orderkey"), F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    ends = (start + 60_000 * (key % 9), start + 60_000 * (key % 9) + 500, start + 60_000 * (key % 9) + 500 + 250 * (key % 4))
    end = F.when(key % 7 == 1, F.concat(F.lit('"'), ends[2].cast("string"), F.lit('"'))).when(key % 7 == 2, "null").when(key % 7 == 3, (ends[1] - 1).cast("string")).otherwise(ends[2].cast("string"))
    pairs = zip(status.CLOCK, (start, ends[0], ends[0], ends[1], ends[1], end), strict=True)
    saved = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), v.cast("string")) for n, v in pairs)), F.lit("}"))
    clocks = table(spark, sf_dir, "orders").select("o_orderkey", status.restored_clock(saved).alias("clock"))
    sums = clocks.select("o_orderkey", status.timing_totals(F.col("clock"), key % 5 != 0).alias("t"))
    return sums.select("o_orderkey", "t.collect", "t.drain", "t.store", "t.total")


@query("""
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Newest' WHEN 1 THEN 'Most relevant' WHEN 2 THEN 'All comments' WHEN 3 THEN 'Newest first' END AS shown,
  turn % 5 IN (0, 2, 3) AS verified, CASE turn % 5 WHEN 1 THEN 'not_verified' WHEN 4 THEN 'control_not_found' END AS reason,
  CASE WHEN turn % 5 IN (0, 2, 3) THEN role ELSE role || ',comments:unsorted' END AS warnings, turn % 5 = 1 AS relevant FROM conversations
""")
def shown_orders(spark, sf_dir):
    """Whether threads stand in the order asked for, by the label that their control shows."""
    n = F.col("turn") % 5
    shown = F.when(n == 0, " Newest\n").when(n == 1, "Most  relevant").when(n == 2, "All comments").when(n == 3, "Newest\nfirst")
    state = order.order_state(shown, "newest", order.COMMENT_ORDERS)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", state.alias("s"), F.array("role").alias("w"), order.shows_order(order.order_label(shown), "relevant", order.FEED_ORDERS).alias("relevant"))
    return rows.select("conv_id", "turn", F.col("s.order").alias("shown"), "s.verified", "s.reason", F.array_join(order.marked_unsorted(F.col("w"), F.col("s.verified")), ",").alias("warnings"), "relevant")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS "at" FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY "at" DESC NULLS LAST, o_orderkey) AS place FROM o QUALIFY place <= 5
""")
def newest_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate")).alias("at"))
    return order.newest_first(rows, "o_custkey", "at", "o_orderkey", most=5).select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN strftime(date_trunc(CASE event_id % 4 WHEN 0 THEN 'milliseconds' WHEN 1 THEN 'second' ELSE 'day' END, ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS iso FROM events
""")
def iso_times(spark, sf_dir):
    """Times written in several ways, and texts that are none, as ISO text."""
    n, at = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    zoned = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    text = F.when(n == 0, zoned).when(n == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(n == 2, F.date_format(at, "yyyy-MM-dd")).otherwise(F.concat(F.lit("on "), zoned))
    return table(spark, sf_dir, "events").select("event_id", times.iso_or_null(text).alias("iso"))
