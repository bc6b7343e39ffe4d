"""What the two classifiers share: folds and the bounded sample of labelled rows they learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``most`` labelled documents outside the held-out fold.

    The sample is the ``most`` labelled ids with the smallest hash, so it depends on nothing but
    the labels; only it is broadcast. A document labelled twice counts as 1 if either says so.
    Null labels and ids are no labels.
    """
    chosen = (
        labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label"))
        .filter(F.col("__label").isNotNull() & F.col("__id").isNotNull() & (fold(F.col("__id"), folds) != held_out))
        .groupBy("__id")
        .agg(F.max("__label").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most)
    )
    rows = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("__id", "__text", "__label")
