"""Connected components by alternating large-star and small-star steps, on tables, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import free, materialise


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: links every larger neighbour of u to u's least; small star: every smaller neighbour and u."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = F.least("a", F.min("b").over(Window.partitionBy("a")))
    known = both.select("a", "b", least.alias("m"))
    moved = known.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b" if large else "a != b")
    if not large:
        moved = moved.unionByName(known.select("a", F.col("m").alias("b")).where("a != b"))
    return moved.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the least node each node with an edge reaches. Null ends and loops don't count."""
    now = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "edges")
    digest = None
    while True:
        before, now = now, materialise(_step(_step(now, True), False), "edges")
        free(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == digest:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        digest = seen
