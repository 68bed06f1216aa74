"""Documents through quality rules, toxicity, near-duplicate removal and packing, each stage over all that the one before kept.

Null texts count as empty and so fail the quality rules; null sources are a host of their own; repeated rows are copies, of which one
stays; null ids are scored, compared and packed like others. Empty tables give empty results. Columns that documents doesn't
have are not read and not returned.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import near_dup, packing, quality, toxicity
from strideframe.llm.common import free_shuffles, release, shared_dir, tracked
from strideframe.llm.queries import TOKENIZER, _digests

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor stand on a rejected host."""
    return quality.kept_documents(docs.select(COLUMNS)).select(COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs.select(COLUMNS), model).where("__sf_score < 0.7").select(COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the least id, of each class of near duplicates."""
    return near_dup.one_of_each(docs.select(COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return _digests(packing.pack_documents(docs, tokenizer=TOKENIZER))


STAGES = [("quality rules", quality_stage), ("toxicity", toxicity_stage), ("near duplicates", near_dup_stage), ("packing", packing_stage)]

#: Scores of fitted models and MinHash candidates have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' last result; each earlier one is written to the shared folder and read by the next. What a stage made on the way goes once it is written; what is left at the end is what the result reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{os.urandom(8).hex()}"
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with tracked() as made:
            docs = stage(spark, docs, sf_dir)
            docs.write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        release(*made, *([f"{base}/{i - 1}"] if i else []))
        free_shuffles(spark)
