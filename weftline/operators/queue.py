"""Job queues and delivery as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def queue_position(jobs: DataFrame, group: str, parked: Column, lane: str, seq: str) -> DataFrame:
    """Parked jobs first, by lane, then by arrival; retries carry a later seq. Positions count within a group."""
    order = Window.partitionBy(group).orderBy(F.when(parked, 0).otherwise(1), F.when(parked, F.col(lane)).otherwise(0), seq)
    return jobs.withColumn("position", F.row_number().over(order))


def owed(*parts: DataFrame) -> DataFrame:
    """Ids that any of the parts has, once each."""
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def should_retry(error: Column, comments: Column, attempts: Column, most: int = 2) -> Column:
    return error.isNotNull() & (F.coalesce(comments, F.lit(0)) == 0) & (attempts < most)


def unsent(rows: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    return rows.join(sent.select(key).distinct(), key, "left_anti")


def batches(rows: DataFrame, key: str, size: int = 25, blocks: int = 64) -> DataFrame:
    """batch: about `size` rows each, never more, numbered across all rows without one task seeing them all.

    Rows are numbered inside hash blocks; blocks' batch counts, one row a block, are summed before.
    """
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    marked = rows.withColumn("block", block)
    counts = marked.groupBy("block").agg(F.ceil(F.count("*") / size).alias("needed"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("needed").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("block").orderBy(key)) - 1
    return (
        marked.withColumn("number", number).join(F.broadcast(offsets.select("block", "offset")), "block")
        .withColumn("batch", (F.col("offset") + F.floor(F.col("number") / size)).cast("long")).drop("block", "number", "offset")
    )


def accepted_prefix(results: DataFrame, batch: str, rejected: str) -> DataFrame:
    """Batches before the first one with rejects. The first is one number."""
    first = results.where(F.col(rejected) > 0).agg(F.min(batch).alias("stop"))
    return results.crossJoin(F.broadcast(first)).where(F.col("stop").isNull() | (F.col(batch) < F.col("stop"))).drop("stop")


def newest(rows: DataFrame, key: str, seq: str, most: int, group: str | None = None) -> DataFrame:
    """A bounded map or log: each key as it came first, and of these the `most` that came last (of each group, if there are some).

    Without groups Spark takes the bound from sorted parts, not from one sort of all rows.
    """
    keys = [group, key] if group else [key]
    once = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), seq).alias("row")).select("row.*")
    if group is None:
        return once.orderBy(F.desc(seq), key).limit(most)
    order = Window.partitionBy(group).orderBy(F.desc(seq), key)
    return once.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).drop("turn")


def fenced(writes: DataFrame, epochs: DataFrame, key: str, epoch: str) -> DataFrame:
    """Writes begun in the epoch that still holds; a Clear raises a key's epoch. Keys that were never cleared are in epoch 0."""
    now = epochs.groupBy(key).agg(F.max(epoch).alias("holds"))
    return writes.join(now, key, "left").where(F.col(epoch) == F.coalesce("holds", F.lit(0))).drop("holds")


def restarted(since: Column, *restarts: Column) -> Column:
    """When a hold's clock began: at its start or the latest restart (a drain, a reload) after it. Null: nothing is held."""
    return F.when(since.isNotNull(), F.greatest(since, *restarts)) if restarts else since
