"""Merging readings of one record: order-free aggregates over a sequence column.

Every rule equals the fold over readings in order of the sequence: the winner of (rank, sequence) is the same
however partial results are combined, so that Spark aggregates map-side.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greatest_count(name: str) -> Column:
    return F.max(name)


def first_known(name: str, seq: str) -> Column:
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.col(seq)))


def last_value(name: str, seq: str) -> Column:
    return F.max_by(name, seq)


def last_known(name: str, seq: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(seq)))


def longest(name: str, seq: str) -> Column:
    """The longest text; of equally long ones the earliest."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(F.length(name), -F.col(seq))))


def best_ranked(name: str, rank: str, seq: str) -> Column:
    """The known value of the least rank, the earliest of these; with its rank."""
    known = F.when(F.col(name).isNotNull(), F.struct(rank, seq))
    return F.min_by(F.struct(F.col(name).alias("value"), F.col(rank).alias("rank")), known)


def any_true(name: str) -> Column:
    return F.bool_or(F.coalesce(F.col(name), F.lit(False)))


def merge_readings(
    readings: DataFrame, key: str, seq: str, *, most: Sequence[str] = (), first: Sequence[str] = (), last: Sequence[str] = (),
    long: Sequence[str] = (), flags: Sequence[str] = (), ranked: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row a key. ranked: value column -> rank column. Null keys are no record and are left out."""
    out = [greatest_count(c).alias(c) for c in most]
    out += [first_known(c, seq).alias(c) for c in first] + [last_value(c, seq).alias(c) for c in last]
    out += [longest(c, seq).alias(c) for c in long] + [any_true(c).alias(c) for c in flags]
    out += [best_ranked(v, r, seq)["value"].alias(v) for v, r in (ranked or {}).items()]
    return readings.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("readings"), *out)


def ordered_union(readings: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """key, values: each once, in order of first appearance. Values are made distinct before a key's are collected."""
    once = readings.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(seq).alias("seq"))
    pairs = F.array_sort(F.collect_list(F.struct("seq", F.col(value).alias("value"))))
    return once.groupBy(key).agg(F.transform(pairs, lambda x: x["value"]).alias("values"))


def pruned_warnings(warnings: Column, present: Mapping[str, Column]) -> Column:
    """Without `field:missing` and `field:unresolved` of fields that are known by now; each code once."""
    gone = [F.when(known, F.array(F.lit(f"{f}:missing"), F.lit(f"{f}:unresolved"))).otherwise(F.array().cast("array<string>")) for f, known in present.items()]
    return F.array_distinct(F.array_except(warnings, F.flatten(F.array(*gone)))) if gone else F.array_distinct(warnings)


def merge_comments(rows: DataFrame, keys: Sequence[str], seq: str, position: str, likes: str, date: str) -> DataFrame:
    """Threads read several times: a comment (`keys`) once, most likes, first known date, place of the longest reading.

    The order is that of the reading with most comments (the latest of equals); others follow behind.
    """
    group = list(keys[:-2])
    sizes = rows.groupBy(*group, seq).agg(F.count("*").alias("n"))
    lead = sizes.groupBy(*group).agg(F.max_by(seq, F.struct("n", seq)).alias("lead"))
    known = rows.join(lead, group)
    place = F.min(F.struct((F.col(seq) != F.col("lead")).cast("int").alias("behind"), F.col(seq), F.col(position)))
    merged = known.groupBy(*keys).agg(F.max(likes).alias(likes), first_known(date, seq).alias(date), place.alias("place"))
    return merged


def folded_threads(rows: DataFrame, group: str, seq: str, position: str, author: str = "author", text: str = "text", likes: str = "likes", at: str = "at") -> DataFrame:
    """group, place, author, text, likes, at: a thread's readings merged one after the other, in order of `seq`.

    Of two lists of comments the longer leads, of equally long ones the newer; what only the other has follows. A comment of the newer
    list takes the larger count of likes and the earlier reading's time; one of the older list stays as it is, so that likes that only a
    shorter reading has are lost. The order of readings matters, which is why no aggregate does this: threads are dealt to tasks,
    sorted, and folded as they come in; a task holds one thread and one reading of it. Null groups are no threads.
    """
    names = (group, seq, position, author, text, likes, at)
    kept = rows.where(F.col(group).isNotNull()).select(*names).repartition(group).sortWithinPartitions(group, seq, position)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        thread: list[tuple] = []
        reading: list[tuple] = []
        now: tuple | None = None  # group and reading

        def done() -> pa.RecordBatch:
            columns = [[now[0]] * len(thread), range(len(thread)), *zip(*thread, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            if schema is None:
                types = [batch.schema.field(n).type for n in (author, text, likes, at)]
                schema = pa.schema([(group, batch.schema.field(group).type), ("place", pa.int32()), *zip((author, text, likes, at), types, strict=True)])
            for one, turn, _, *comment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (one, turn):
                    if now:
                        thread, reading = merged_comments(thread, reading) if thread else reading, []
                        if now[0] != one and thread:
                            yield done()
                        thread = thread if now[0] == one else []
                    now = (one, turn)
                reading.append(tuple(comment))
        if now:
            thread = merged_comments(thread, reading) if thread else reading
            yield done()

    return kept.mapInArrow(run, ", ".join([f"`{group}` {kinds[group]}", "place int", *(f"`{n}` {kinds[n]}" for n in (author, text, likes, at))]))


def merged_comments(older: list[tuple], newer: list[tuple]) -> list[tuple]:
    """Two lists of (author, text, likes, at) as one; see `folded_threads`."""
    name = lambda c: (c[0] or "", c[1] or "")
    saved = {name(c): c for c in older}
    out: dict[tuple, tuple] = {}
    for comment in [*newer, *older] if len(newer) >= len(older) else [*older, *newer]:
        prior = saved.get(name(comment))
        if name(comment) not in out:
            if prior is None or prior is comment:
                out[name(comment)] = comment
            else:
                most = comment[2] if prior[2] is None else max(comment[2] or 0, prior[2])
                out[name(comment)] = (*comment[:2], most, comment[3] if prior[3] is None else prior[3])
    return list(out.values())


def adopted(entries: DataFrame, record: str, key: str, first_seen: str, truncated: str, hold: str) -> DataFrame:
    """Entries found to be one record become one: the oldest key, the earliest time, truncated if any is, and the oldest hold.

    Entries without a time count as the oldest; of equally old ones the smallest key. A hold is never lost.
    """
    age = F.struct(F.col(first_seen).isNotNull(), first_seen, key)
    held = F.min_by(hold, F.when(F.col(hold).isNotNull(), age))
    return entries.groupBy(record).agg(F.min_by(key, age).alias(key), F.min(first_seen).alias(first_seen), any_true(truncated).alias(truncated), held.alias(hold), F.count("*").alias("entries"))
