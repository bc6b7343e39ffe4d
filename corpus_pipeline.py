"""A training-data pipeline: each stage reads what its predecessor kept and calls one operator.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. How nulls, empty and long texts, repeated rows, reused ids and ties are handled
is stated with the operator that a stage calls; extra columns stay, and an empty table passes through
all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirelake.llm.byte_bpe import bpe_digests
from wirelake.llm.exact_dedup import drop_copies
from wirelake.llm.mixing import mixed_documents
from wirelake.llm.ngram_join import drop_near_copies
from wirelake.llm.quality import keep_good
from wirelake.llm.queries import tokenizer
from wirelake.session import materialise, prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    prepare(spark)
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    prepare(spark)
    return bpe_digests(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: SQL can't express a trained classifier, MinHash or BPE; tests hold each stage to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
