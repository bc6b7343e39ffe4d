"""Mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents by a seeded hash and serves them in that order, again from
the start once through, at a rate in proportion to its target. A document's virtual finish time is
the tokens its source has served by its end over the source's target; the mix is the global order
of finish times, cut where the total budget is spent.

Running sums never meet in one task: each source's shuffled order is cut in about sqrt(n) hash
ranges, whose totals give every range its offset; the global order is cut in ``SLICES`` ranges of
finish time, of which only the one that crosses the budget is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .frames import keyed, unused

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 1 << 16


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """``sizes``: source, source_size. Adds weight and target.

    Targets are ``min(max_repeat * size, level * weight)`` with the one level that spends the
    budget, which is where resharing the excess of capped sources ends. One row per source, so the
    windows without a partition see as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(pick, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("budget", F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("cap").over(everything)))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("level", F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", "weight", "budget", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_repeat: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words), copies.

    * size: runs of characters that aren't ASCII white space; null texts have 0.
    * Null sources form a source of their own, last in order. Empty documents cost nothing and
      are taken where their place in the order is. An empty table gives an empty result.
    * The order depends on ids, sizes and ``seed`` alone, so reruns agree; rows that repeat an id
      tie and are told apart by size.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    base = materialise(base, "mix-sizes")  # texts are read once; three uses follow
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")), 11) / F.lit(float(1 << 53))
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = source_targets(per_source.drop("n"), weights, share, max_repeat)
    goals = goals.join(per_source.select(F.col("source").alias("s_"), "n"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    rows = (
        base.withColumn("at", spread)
        .join(goals.withColumnRenamed("source", "g_"), F.col("source").eqNullSafe(F.col("g_")))
        .withColumn("range", F.floor(F.col("at") * F.ceil(F.sqrt("n"))))
        .drop("g_", "n", "weight")
    )
    offsets = rows.groupBy("source", "range").agg(F.sum("size").alias("sum_"))
    offsets = offsets.select(
        F.col("source").alias("o_"),
        F.col("range").alias("r_"),
        (F.sum("sum_").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum_")).alias("offset"),
    )
    within = Window.partitionBy("source", "range").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        rows.join(offsets, F.col("source").eqNullSafe(F.col("o_")) & (F.col("range") == F.col("r_")))
        .withColumn("served", F.col("offset") + F.sum("size").over(within))
        .select("doc_id", "size", "source_size", "target", "budget", "served")
    )
    rows = materialise(rows, "mix-served")

    def finish(epoch: int):
        return F.when(F.col("target") > 0, (F.col("served") + F.lit(epoch) * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))

    def cut(f):
        return F.least(F.floor(f * F.lit(SLICES // 2)), F.lit(SLICES)).cast("int")

    turns = rows.select("doc_id", "size", "budget", F.posexplode(F.array(*[finish(e) for e in range(max_repeat)])).alias("epoch", "finish")).withColumn("slice", cut(F.col("finish")))
    # at most SLICES + 1 rows
    slices = turns.groupBy("slice").agg(F.sum("size").alias("sum_"), F.first("budget").alias("budget"))
    slices = slices.withColumn("upto", F.sum("sum_").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    crossing = slices.filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("sum_") <= F.col("budget"))).select(F.col("slice").alias("x_"), (F.col("upto") - F.col("sum_")).alias("ahead"))
    place = F.struct("finish", "doc_id", "size", "epoch")
    order = Window.partitionBy("slice").orderBy("finish", "doc_id", "size", "epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        turns.join(F.broadcast(crossing), F.col("slice") == F.col("x_"))
        .withColumn("upto", F.col("ahead") + F.sum("size").over(order))
        .filter(F.col("upto") <= F.col("budget"))
        .agg(F.max(place).alias("last"))
    )
    whole = crossing.agg(F.min("x_").alias("x_"))
    edge, x = last.scalar(), whole.scalar()
    copies = F.lit(0)
    for e in range(max_repeat):
        f = finish(e)
        mine = F.struct(f.alias("finish"), F.col("doc_id"), F.col("size"), F.lit(e).alias("epoch"))
        taken = x.isNull() | (cut(f) < x) | ((cut(f) == x) & F.coalesce(mine <= edge, F.lit(False)))
        copies = copies + F.when(taken, 1).otherwise(0)
    return rows.select(
        F.col("doc_id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * copies).cast("bigint").alias("taken"),
        copies.cast("int").alias("copies"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents of the mix, each as often as it is taken; documents that share an id, null or
    not, are told apart by their texts. Rows that repeat both are taken alike, as often as the one
    that is taken most. An empty table gives an empty result; extra columns are kept."""
    mine, key, times, turn = (unused(docs, n) for n in ("__key", "__mixed", "__times", "__turn"))
    rows, _ = keyed(docs, mine, id_col, text_col)
    plan = mix_sources(rows, id_col=mine, text_col=text_col, **params).groupBy(F.col(mine).alias(key)).agg(F.max("copies").alias(times)).filter(F.col(times) > 0)
    out = rows.join(plan, F.col(mine).eqNullSafe(F.col(key)))
    return out.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
