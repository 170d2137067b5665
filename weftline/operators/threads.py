"""Comment threads: caps, completeness, and posts that wait for their thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped(rows: DataFrame, thread: str, position: str, cap: int) -> DataFrame:
    """The first `cap` rows of each thread; Spark drops the rest before the shuffle."""
    order = Window.partitionBy(thread).orderBy(position)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def target(expected: Column, cap: int) -> Column:
    return F.least(F.coalesce(expected, F.lit(cap)), F.lit(cap))


def budget_seconds(goal: Column, page: int = 10, each: int = 4, least: int = 8, most: int = 90) -> Column:
    pages = F.ceil(F.when(goal > 0, goal).otherwise(100) / page)
    return F.least(F.greatest(pages * each, F.lit(least)), F.lit(most)).cast("int")


def is_complete(read: Column, expected: Column, exhausted: Column) -> Column:
    return F.coalesce(exhausted, F.lit(False)) | F.coalesce((expected > 0) & (read >= expected), F.lit(False))


def release_reason(waiting: Column, has_result: Column, owed: Column, queue_age: Column, waited: Column, grace: int = 60, limit: int = 2_400) -> Column:
    """Why a held post may go: its result is there, its job is lost, or it waited too long; null: it stays.

    queue_age: seconds since the queue was read, null if it is unknown, which is not the same as empty.
    """
    lost = ~owed & (queue_age <= grace) & (waited >= grace)
    return (
        F.when(~waiting, "not_waiting").when(has_result, "result").when(F.coalesce(lost, F.lit(False)), "comments:worker_lost")
        .when(owed & (waited >= limit), "comments:worker_timeout")
    )


def settled(pending: Column, in_flight: Column, on_disk: Column, held: Column, known: Column) -> Column:
    """What a drained queue allows: upload always; release, clear and stop unless jobs are left and posts are held."""
    left = (pending + in_flight + on_disk) > 0
    done = known & ~(left & (held > 0))
    return F.struct(F.lit(True).alias("upload"), done.alias("release"), done.alias("clear"), done.alias("stopped"))


def with_late_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with their parent's columns, whichever came first; `orphan` where no parent is there yet."""
    marked = parents.withColumn("parent_there", F.lit(True))
    joined = children.join(marked, key, "left")
    return joined.withColumn("orphan", F.col("parent_there").isNull()).drop("parent_there")
