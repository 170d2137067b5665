"""Event-time bounds of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cutoff_of(last_seen: Column, initial: Column, overlap_hours: int = 48) -> Column:
    """Where the last visit is known, some hours before it; else the bound of a first sweep."""
    return F.coalesce(F.timestamp_micros(F.unix_micros(last_seen) - overlap_hours * 3_600_000_000), initial)


def before(at: Column, cutoff: Column, approximate: Column | None = None) -> Column:
    """Null or approximate times are on neither side."""
    stated = at if approximate is None else F.when(~approximate, at)
    return F.coalesce(stated < cutoff, F.lit(False))


def after(at: Column, cutoff: Column, approximate: Column | None = None) -> Column:
    stated = at if approximate is None else F.when(~approximate, at)
    return F.coalesce(stated >= cutoff, F.lit(False))


def until_streak(rows: DataFrame, run: str, position: str, at: str, cutoff: Column, streak: int = 8) -> DataFrame:
    """Rows of each run before its `streak`-th old row in a row, without old ones. Undated rows don't break a streak.

    Two windows over one partitioning: a run is one feed walk, and its rows travel once.
    """
    order = Window.partitionBy(run).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = Window.partitionBy(run, "island").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("old", before(F.col(at), cutoff)).withColumn("island", F.sum(after(F.col(at), cutoff).cast("int")).over(order))
    counted = marked.withColumn("streak", F.sum(F.col("old").cast("int")).over(island))
    stopped = counted.withColumn("stopped", F.max((F.col("streak") >= streak).cast("int")).over(order))
    return stopped.where("stopped = 0 and not old").drop("old", "island", "streak", "stopped")


def until_streak_in_parts(rows: DataFrame, run: str, position: str, at: str, cutoff: Column, streak: int = 8, width: int = 1_000_000) -> DataFrame:
    """`until_streak` for runs of any length: a run is cut into stretches of `width` positions (whole numbers), which are read apart.

    Of a stretch one row is kept: how many old rows stand before its first row that breaks a streak, and behind its last. What a
    stretch inherits is summed over these few rows, and only then each row's streak is known. The earliest row that completes one
    ends the run.
    """
    part = F.floor(F.col(position) / width).cast("long")
    old, breaks = before(F.col(at), cutoff), after(F.col(at), cutoff)
    marked = rows.withColumn("streak_part", part).withColumn("streak_old", old).withColumn("streak_breaks", breaks)
    keys = [run, "streak_part"]
    order = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = Window.partitionBy(*keys, "streak_island").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = marked.withColumn("streak_island", F.sum(F.col("streak_breaks").cast("int")).over(order)).withColumn("streak_here", F.sum(F.col("streak_old").cast("int")).over(island))
    # Of a whole stretch: the old rows behind its last break, which are all if it has none.
    last = F.max_by("streak_here", position)
    whole = within.groupBy(*keys).agg(last.alias("behind"), (F.max("streak_island") > 0).alias("broken"))
    along = Window.partitionBy(run).orderBy("streak_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = whole.withColumn("since", F.sum(F.col("broken").cast("int")).over(along))
    so_far = F.sum("behind").over(Window.partitionBy(run, "since").orderBy("streak_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    handed = grouped.withColumn("so_far", so_far).withColumn("inherited", F.coalesce(F.lag("so_far").over(Window.partitionBy(run).orderBy("streak_part")), F.lit(0)))
    known = within.join(handed.select(F.col(run).alias("streak_run"), F.col("streak_part").alias("streak_of"), "inherited"), F.col(run).eqNullSafe(F.col("streak_run")) & (F.col("streak_part") == F.col("streak_of")))
    count = F.col("streak_here") + F.when(F.col("streak_island") == 0, F.col("inherited")).otherwise(0)
    ends = known.where(F.col("streak_old") & (count >= streak)).groupBy(F.col(run).alias("ended_run")).agg(F.min(position).alias("ended_at"))
    left = marked.where(~F.col("streak_old")).join(ends, F.col(run).eqNullSafe(F.col("ended_run")), "left")
    return left.where(F.col("ended_at").isNull() | (F.col(position) < F.col("ended_at"))).select(*rows.columns)


def until_stagnant(rounds: DataFrame, run: str, turn: str, size: str, most: int = 2) -> DataFrame:
    """Of each run the rounds up to the one that ends it: the last of `most` rounds in a row that brought nothing new.

    A run is a thread's walk: its rounds are few. Null sizes bring nothing new. Turns are unique in a run.
    """
    order = Window.partitionBy(run).orderBy(turn)
    top = F.coalesce(F.max(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    still = rounds.withColumn("still", (F.coalesce(F.col(size), F.lit(-1)) <= top) & (F.row_number().over(order) > 1))
    ended = F.min(F.when(F.col("quiet") >= most, F.col(turn))).over(Window.partitionBy(run))
    quiet = still.withColumn("quiet", F.when(F.count("*").over(order.rowsBetween(1 - most, 0)) == most, F.sum(F.col("still").cast("int")).over(order.rowsBetween(1 - most, 0))))
    return quiet.withColumn("ended", ended).where(F.col("ended").isNull() | (F.col(turn) <= F.col("ended"))).drop("still", "quiet", "ended")
