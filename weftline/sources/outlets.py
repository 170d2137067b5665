"""Landed answers of a paginated listing of outlets, put together to one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.comments import outlet_keys

FURTHEST = 2_000  # no page that starts after this offset belongs to a listing
_GROUP = "group: struct<slug: string, externalId: string>"
_OUTLET = (
    "handle: string, externalId: string, mediaOutlet: string, canonicalUrl: string, discoveryUrl: string, "
    f"lastDiscoveredAt: string, last_discovered_at: string, metadata: struct<{_GROUP}>"
)
ANSWER = f"sources array<struct<{_OUTLET}>>, items array<struct<{_OUTLET}>>, pagination struct<hasMore: boolean, returned: bigint>"


def last_discovered(outlet: Column) -> Column:
    """As text, under either spelling of its name; the first that is not null decides, and an empty one counts as none."""
    return F.nullif(F.coalesce(outlet["lastDiscoveredAt"], outlet["last_discovered_at"]), F.lit(""))


def listed_outlets(answers: DataFrame, run_col: str, offset_col: str, body_col: str, furthest: int = FURTHEST) -> DataFrame:
    """run, offset, place, outlet (struct), keys, last_discovered_at: every outlet that a reader of the pages in turn would have seen.

    A page belongs to a listing if the pages from the first on lead to it: each leads to the offset behind what it returned, the last
    one to none; that says that there are no more, or returns none. What a page returned is what it says, else how many outlets it
    holds. Pages that no other leads to do not count. `furthest` bounds the offsets of a run, and so what one row of the walk holds
    (three numbers a page). A page landed twice counts once, by its greatest body; null runs, offsets and bodies that are no JSON have no
    outlets, and end the listing like a missing page.
    """
    landed = answers.select(F.col(run_col).alias("run"), F.col(offset_col).cast("long").alias("offset"), F.col(body_col).cast("string").alias("body"))
    near = landed.where((F.col("offset") >= 0) & (F.col("offset") <= furthest) & F.col("run").isNotNull())
    one = near.groupBy("run", "offset").agg(F.max("body").alias("body"))
    read = one.withColumn("answer", F.from_json("body", ANSWER)).drop("body")
    rows = F.coalesce("answer.sources", "answer.items", F.array())
    pages = read.select("run", "offset", rows.alias("rows"), F.coalesce("answer.pagination.returned", F.size(rows)).cast("long").alias("returned"), F.col("answer.pagination.hasMore").alias("more"))
    last = (~F.coalesce(F.col("more"), F.lit(True))) | (F.col("returned") == 0)
    turns = pages.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("offset", "returned", last.alias("last")))).alias("turns"))

    def follow(so_far: Column, page: Column) -> Column:
        here = page["offset"] == so_far["due"]
        due = F.when(here, F.when(page["last"], F.lit(-1)).otherwise(so_far["due"] + page["returned"])).otherwise(so_far["due"])
        seen = F.when(here, F.array_append(so_far["seen"], page["offset"])).otherwise(so_far["seen"])
        return F.struct(due.cast("long").alias("due"), seen.alias("seen"))

    start = F.struct(F.lit(0).cast("long").alias("due"), F.array().cast("array<bigint>").alias("seen"))
    kept = turns.select("run", F.explode(F.aggregate("turns", start, follow, lambda x: x["seen"])).alias("offset"))
    each = pages.join(kept, ["run", "offset"]).select("run", "offset", F.posexplode("rows").alias("place", "outlet"))
    x = F.col("outlet")
    names = F.array(x["handle"], x["externalId"], x["mediaOutlet"], x["metadata"]["group"]["slug"], x["metadata"]["group"]["externalId"])
    links = F.filter(F.array(x["canonicalUrl"], x["discoveryUrl"]), lambda u: u.isNotNull())
    return each.select("run", "offset", "place", "outlet", outlet_keys(names, links).alias("keys"), last_discovered(x).alias("last_discovered_at"))
