"""Names that a frame with unknown extra columns doesn't have, and keys for rows without good ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_rows(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of the row that sorts first by them among those that agree on ``keys``."""
    first, chosen = unused(rows, "__first"), rows.select(*columns).schema
    whole = F.struct(*columns)
    sortable = [f.name for f in chosen if "map<" not in f.dataType.simpleString()]
    pick = F.min(whole) if len(sortable) == len(columns) else F.min_by(whole, F.struct(*sortable))
    return rows.groupBy(*keys).agg(pick.alias(first)).select(*(F.col(f"{first}.{c}").alias(c) for c in columns))


def keyed(docs: DataFrame, key: str, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with a bigint column ``key`` that tells its documents, distinct (id, text), apart and
    orders them by id, null ids last, then by SHA-256; and whether it is just the id, as it is where
    ids are whole numbers, unique and never null."""
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
        return docs.withColumn(key, F.col(id_col).cast("bigint")), True
    sha, id_, sha_ = (unused(docs, f"{key}_{n}") for n in ("sha", "id", "of"))
    rows = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    keys = rows.select(F.col(id_col).alias(id_), F.col(sha).alias(sha_)).distinct().orderBy(F.col(id_).asc_nulls_last(), sha_)
    keys = materialise(keys.withColumn(key, F.monotonically_increasing_id()), "document-keys")
    return rows.join(keys, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(sha) == F.col(sha_))).drop(sha, id_, sha_), False
