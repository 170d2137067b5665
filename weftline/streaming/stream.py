"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.merge import merge_readings
from weftline.operators.store import KeyedStore


def merged_stream(readings: DataFrame, key: str, seq: str, **rules) -> DataFrame:
    """The merge of all readings so far, as a streaming aggregate in update or complete mode."""
    return merge_readings(readings, key, seq, **rules)


def once_per_key(rows: DataFrame, keys: list[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """Repeats of a key within the delay are dropped; state is bounded by the watermark."""
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


class _Unseen(StatefulProcessor):
    """Lets the first row of each key through; the key is remembered for as long as nothing renews it."""

    def __init__(self, remember_ms: int) -> None:
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.remember_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        self.seen.update((True,))  # each sight renews the time
        for part in rows:
            if not known and len(part):
                known = True
                yield part.iloc[:1]

    def close(self) -> None:
        pass


def read_once(rows: DataFrame, content: str, remember_ms: int = 86_400_000) -> DataFrame:
    """Rows whose content has not come before, by its digest; a digest is forgotten when its content has not been seen for so long.

    State is one flag a digest, whatever the content's size. Needs the RocksDB state store.
    """
    digest = rows.withColumn("content_digest", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    kept = digest.groupBy("content_digest").transformWithStateInPandas(_Unseen(remember_ms), digest.schema, "Append", "ProcessingTime")
    return kept.drop("content_digest")


def hold_until_result(rows: DataFrame, key: str, limit_ms: int = 2_400_000) -> DataFrame:
    """key, result, reason: posts (kind 'post') wait for their thread (kind 'result'); late ones go without.

    rows: key, kind, payload, in processing time. State is one row a waiting key, with a timer.
    """

    def step(names: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [names[0]], "result": [None], "reason": ["comments:worker_timeout"]})
            return
        post, result = state.get if state.exists else (False, None)
        for part in parts:
            post = post or bool((part["kind"] == "post").any())
            found = part.loc[part["kind"] == "result", "payload"]
            result = found.iloc[-1] if len(found) else result
        if post and result is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [names[0]], "result": [result], "reason": ["result"]})
        else:
            state.update((post, result))
            if post:
                state.setTimeoutDuration(limit_ms)

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, result string, reason string", "post boolean, result string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def attached_late(comments: DataFrame, posts: DataFrame, post_id: str, comment_at: str, post_at: str, wait: str = "1 hour") -> DataFrame:
    """Comments with the row of their post, which may come up to `wait` before or after them; those whose post has not come by then, with nulls.

    A stream joined with a stream: state holds what both watermarks still allow, and an orphan comes out once none can follow. The id
    has one name on both sides; null ids are orphans at once the watermark passes.
    """
    early = comments.withWatermark(comment_at, wait)
    late = posts.withWatermark(post_at, wait).withColumnRenamed(post_id, "post_key")
    near = F.expr(f"`{post_at}` BETWEEN `{comment_at}` - INTERVAL {wait} AND `{comment_at}` + INTERVAL {wait}")
    return early.join(late, (F.col(post_id) == F.col("post_key")) & near, "left_outer").drop("post_key")


def upsert_sink(path: str, key: str, version: str, parts: int = 64):
    """For foreachBatch: at-least-once delivery into a keyed store, made idempotent by key and version."""

    def deliver(batch: DataFrame, number: int) -> None:
        KeyedStore(batch.sparkSession, path, key, version, parts).upsert(batch)

    return deliver


def recent(rows: DataFrame, time_col: str, cutoff: str) -> DataFrame:
    return rows.where(F.col(time_col) >= F.lit(cutoff).cast("timestamp"))
