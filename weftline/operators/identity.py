"""Entries that are one record because they share an id, a link or another key, over chains of keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's folder; where none is set, in a temporary one of a single process."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()


def same_record(entries: DataFrame, entry: str, keys: str) -> DataFrame:
    """entry, record: the least entry that each entry reaches over shared keys; `keys` is an array column, nulls and '' name nothing.

    Labels sink along the edges between entries and keys, and each label then takes the label of the entry it names, so that chains
    shorten by more than half a round. A key that many entries share is one aggregate with a combine on the map side, and no pairs
    of entries are made. Lineage is cut by checkpoints; the folder is the session's.
    """
    named = entries.select(F.col(entry).alias("entry"), F.explode_outer(keys).alias("key")).where("entry is not null")
    edges = _cut(named.where("key <> ''").distinct())
    labels = _cut(named.select("entry").distinct().withColumn("label", F.col("entry")))
    while True:
        of_key = edges.join(labels, "entry").groupBy("key").agg(F.min("label").alias("least"))
        of_entry = edges.join(of_key, "key").groupBy("entry").agg(F.min("least").alias("least"))
        sunk = _cut(labels.join(of_entry, "entry", "left").select("entry", "label", F.least("label", F.coalesce("least", "label")).alias("now")))
        ahead = sunk.select(F.col("entry").alias("now"), F.col("now").alias("next"))
        after = _cut(sunk.join(ahead, "now").select("entry", "label", F.col("next").alias("now")))
        if after.where("label <> now").isEmpty():
            return labels.select(F.col("entry").alias(entry), F.col("label").alias("record"))
        labels = after.select("entry", F.col("now").alias("label"))
