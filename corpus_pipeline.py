"""The corpus pipeline: stages over all documents that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with all their columns; the last one returns a
row for each document of the token file. Columns other than doc_id, text, lang and source pass unseen, whatever their names.
Rows with a null doc_id are judged by their own text, and are never dropped as copies of other documents; rows that repeat a doc_id
are judged each by its own text too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, mixing, near, quality, tokens
from corvane.llm.common import read, set_aside, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the limits of their language."""
    rows, back = set_aside(docs, "doc_id", "lang", "text")
    return quality.kept_documents(rows, read(spark, sf_dir, "labels")).select(*back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8."""
    dropped = near.keyed_near_duplicates(docs, shingle=5).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("d_"), "text_key").distinct()
    rows, back = set_aside(docs, "doc_id", "text")
    rows = rows.withColumn("row_key_", F.xxhash64("text"))
    return rows.join(dropped.hint("shuffle_hash"), (F.col("doc_id") == F.col("d_")) & (F.col("row_key_") == F.col("text_key")), "left_anti").select(*back)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks for."""
    rows, back = set_aside(docs, "doc_id", "source", "text")
    mixed = mixing.mix_sources(mixing.with_size(rows)).where("copies > 0")
    return mixed.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*back)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file and returns its documents: doc_id, start, n_tokens, ids_crc32."""
    return tokens.read_token_file(tokens.token_file(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token file", token_stage),
]

#: The classifier and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
