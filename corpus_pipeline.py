"""The corpus pipeline: language ID, near-duplicate removal, substring dedup, packing.

Each stage works on all that its predecessor kept; its result is written as Parquet in the shared folder and
read back before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import free, settled
from weftline.llm.jaccard_join import jaccard_groups
from weftline.llm.language_id import UNDETERMINED, identify, trained
from weftline.llm.packing import packed_documents
from weftline.llm.substring_dedup import remove_repeats

SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those in no known language; mixtures of known ones stay.

    The model learns from the labelled rows of `docs`; without any, no document can be judged and all with a
    letter stay. Equal rows are judged alike; a null id is no reason to reject.
    """
    model = trained(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    marked = docs.withColumn("pipeline_row", F.struct(*docs.columns))
    said = identify(marked, model, "pipeline_row", "text", known=True)
    return said.where((F.col("lang_pred") != UNDETERMINED) & F.col("known")).select("doc_id.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one row stays: that of the smallest id, then of the smallest row key.

    Ids decide nothing else: they may be null (then they count as largest) or repeated. Rows without words are no copies.
    """
    rows = docs.withColumn("pipeline_key", F.xxhash64(*docs.columns)).withColumn("pipeline_id", F.col("doc_id").cast("long"))
    groups = jaccard_groups(rows, "pipeline_key", shingle=SHINGLE, percent=PERCENT, carry="pipeline_id")
    least = F.min(F.struct(F.col("pipeline_id").isNull(), "pipeline_id", "doc_id", "n_shingles"))
    stay = groups.groupBy("component_id").agg(least.alias("x")).select(F.col("x.doc_id").alias("pipeline_key"), "x.n_shingles")
    # Rows that are alike in all columns have one key, and one twin, another hash; rows of one key that differ all stay.
    twin = F.xxhash64(F.lit("twin"), *docs.columns)
    turn = F.row_number().over(Window.partitionBy("pipeline_key", "pipeline_twin").orderBy("pipeline_key"))
    left = rows.join(stay, "pipeline_key").withColumn("pipeline_twin", twin).withColumn("pipeline_turn", turn)
    return left.where("pipeline_turn = 1 or n_shingles = 0").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that an earlier document has; documents with nothing left go.

    Texts that lose nothing stay as they are; n_chars follows the text.
    """
    out = remove_repeats(docs.withColumn("pipeline_row", F.struct(*docs.columns)), carry="pipeline_row")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("pipeline_row.text"))
    left = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("pipeline_row.n_chars").cast("long"))
    new = {"text": text.alias("text"), "n_chars": chars.cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return left.select(*(new.get(c, F.col(f"pipeline_row.{c}").alias(c)) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the pieces of all documents that are left into sequences; null texts count as empty, no document goes."""
    return packed_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023
        if k:
            free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
