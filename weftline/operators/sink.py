"""Idempotent delivery: records replace those of the same key. Where they are kept is `store`'s matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key: that of the greatest version; of equals the new one. Delivering twice changes nothing."""
    both = stored.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "is_new"]
    content = F.xxhash64(*columns)  # of rows of one key and version the same one each time
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, "is_new", content)).alias("row")).select("row.*")


def held_back(undelivered: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("post_id", "group_key")) -> DataFrame:
    """What waits for delivery: the new rows, and those that waited before but for the same keys (null keys are alike)."""
    one = new.select(*(F.col(k).alias(f"new_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys]
    return undelivered.join(one, same, "left_anti").unionByName(new, allowMissingColumns=True)


def parked(saved: DataFrame, waiting: DataFrame, groups: DataFrame, group: str = "group_key") -> DataFrame:
    """The saved outbox after the groups named (a column `group`) were saved anew: their rows are those that wait, maybe none.

    Rows of other groups stay as they are; null and empty groups are never saved.
    """
    named = groups.where(F.col(group).cast("string") != "").select(group).distinct()
    return saved.join(named, group, "left_anti").unionByName(waiting.join(named, group, "left_semi"), allowMissingColumns=True)


def resumed(waiting: DataFrame, saved: DataFrame, turn: str, post: str = "post_id", group: str = "group_key") -> DataFrame:
    """What waits after the saved outbox was read: all that waited, and of each saved post that did not wait in its group the first row.

    `turn` orders saved rows, ties go by content. Saved rows without a post or group are left out; waiting rows stay, whatever they hold.
    """
    there = saved.where((F.col(post).cast("string") != "") & (F.col(group).cast("string") != ""))
    fresh = there.join(waiting.select(post, group).distinct(), [post, group], "left_anti")
    first = fresh.groupBy(F.col(group).alias("in_group"), F.col(post).alias("of_post")).agg(F.min_by(F.struct(*saved.columns), F.struct(turn, F.xxhash64(*saved.columns))).alias("row"))
    return waiting.unionByName(first.select("row.*"), allowMissingColumns=True)


def envelope(records: DataFrame) -> DataFrame:
    """Records as JSON lines."""
    return records.select(F.to_json(F.struct("*")).alias("value"))
