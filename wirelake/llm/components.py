"""Connected components of an edge table, without gathering edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, release

SALTS = 16


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _with_lowest(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """``pairs`` with m of their u, where the pairs of a hub are dealt to ``SALTS`` pieces."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    return pairs.withColumn("salt", salt).join(low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "salt"]).drop("salt")


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``edges``: columns a, b (ids). Returns (id, component), the component's smallest id, for
    every id on an edge between two different ids.

    Alternates two star steps, which hang each node's larger and then its smaller neighbours on
    the smallest one near it, until nothing moves; the number of rounds grows with the logarithm
    of the longest path. Minima are aggregated before they are shuffled, each round is written to
    the shared folder, and the pairs of a hub are salted.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, mark = materialise(now, "edges"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).select("u", F.least("u", "m").alias("m"))
        large = _with_lowest(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = _lowest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v")
        new = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        release(spark, now)
        now = new
        if seen == mark or not seen[0]:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
