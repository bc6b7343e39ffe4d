"""Exact deduplication: a 128-bit content hash groups rows, bytes decide inside a group.

Plan: one pass aggregates ``(hash, text)``. The aggregate compares whole texts, so two texts with
one hash stay apart, and its map-side half folds a hot group of copies before anything is
shuffled. The groups, without texts, are written; a second pass carries only ``(id, hash, sha256)``
to them, an equi-join of two tables whose large keys AQE splits. No group is ever gathered into
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .frames import first_rows, unused

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(text: Column) -> Column:
    """128 bits of content."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher=content_hash, digest=None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    * Null and empty texts form one group. Empty tables give an empty result.
    * The smallest id of a group stays. Rows repeated with that id are all marked ``kept``: they
      are one document. A null id stays only if its whole group has null ids.
    * Other input columns are ignored, so clashing names do no harm.
    * ``hasher`` may collide: grouping compares bytes. Should two texts share both hash and
      SHA-256, the job fails rather than merge them.
    """
    digest = digest or (lambda t: F.sha2(t.cast("binary"), 256))
    rows = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__text"))
    rows = rows.select("__id", "__text", hasher(F.col("__text")).alias("__hash"))
    same_bytes = rows.groupBy("__hash", "__text").agg(F.min("__id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = (
        same_bytes.select("__hash", digest(F.col("__text")).alias("__sha"), "keep_id", "group_size")
        .groupBy("__hash", "__sha")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("__texts"))
        .select(
            "__hash",
            "__sha",
            "keep_id",
            F.when(F.col("__texts") > 1, F.raise_error(F.lit("two texts share hash and SHA-256")).cast("bigint")).otherwise(F.col("group_size")).alias("group_size"),
        )
    )
    groups = materialise(groups, "copies")  # a join of two tables, not of an aggregate: AQE can split a hot group
    keyed = rows.select("__id", "__hash", digest(F.col("__text")).alias("__sha"))
    return keyed.join(groups, ["__hash", "__sha"]).select(
        F.col("__id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is the first of its kind, once each.

    First is the smallest id; a null id comes first only where all ids of a text are null. Different
    texts that share an id, null or not, all stay. Of rows that repeat id and text, the one that
    sorts first by its columns stays.
    """
    name, sha = (unused(docs, n) for n in ("__keep", "__sha"))
    keep = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(name), F.col("text_sha256").alias(f"{sha}2")).distinct()
    rows = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    rows = rows.join(keep, F.col(id_col).eqNullSafe(F.col(name)) & (F.col(sha) == F.col(f"{sha}2")), "left_semi")
    return first_rows(rows, [id_col, sha], docs.columns)
