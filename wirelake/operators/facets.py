"""Values of fields by frequency: exact from entries, or from sketches that parts of them left behind."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fields import OPERATORS, STATIC, catalogue


def _counts(entries: DataFrame, names: list[str]) -> DataFrame:
    """(field, value, count) of several fields in one pass and one partial aggregate."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), catalogue()[n].text().alias("value")) for n in names])
    return entries.select(F.explode(pairs).alias("p")).filter("p.value <> ''").groupBy("p.field", "p.value").agg(F.count("*").alias("count"))


def field_values(entries: DataFrame, name: str, prefix: str = "", limit: int = 50) -> DataFrame:
    """Values of a tracked field with counts, those of its fixed domain at least with 0, that
    start with ``prefix`` in any case; by count descending, then value."""
    field = catalogue().get(name)
    if field is None or not (field.tracked or name in STATIC):
        raise ValueError(f"{name!r} has no counted values")
    spark = entries.sparkSession
    found = _counts(entries, [name]).select("value", "count")
    if name in STATIC:
        fixed = spark.createDataFrame([(v, 0) for v in STATIC[name].split()], "value string, count bigint")
        found = found.unionByName(fixed).groupBy("value").agg(F.max("count").alias("count"))
    return found.filter(F.startswith(F.lower("value"), F.lit(prefix.lower()))).orderBy(F.desc("count"), "value").limit(limit)


def facet_snapshot(entries: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` values of every tracked field."""
    names = [f.name for f in catalogue().values() if f.tracked]
    order = Window.partitionBy("field").orderBy(F.desc("count"), "value")
    return _counts(entries, names).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


#: Counters of a sketch. While a field has no more different values, its counts are exact.
COUNTERS = 4096


def facet_sketches(entries: DataFrame, by: tuple[str, ...] = (), counters: int = COUNTERS) -> DataFrame:
    """(by…, field, sketch): a sketch of the frequent values of every tracked field, of all entries or of
    those of each day, file or micro-batch. Sketches are of bounded size and can be kept and merged."""
    names = [f.name for f in catalogue().values() if f.tracked]
    blank = lambda n: F.nullif(catalogue()[n].text(), F.lit(""))
    rows = entries.select(*by, *[blank(n).alias(f"value{i}") for i, n in enumerate(names)])
    wide = rows.groupBy(*by).agg(*[F.expr(f"approx_top_k_accumulate(value{i}, {counters}) FILTER (WHERE value{i} IS NOT NULL)").alias(f"sketch{i}") for i in range(len(names))])
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"sketch{i}").alias("sketch")) for i, n in enumerate(names)])
    return wide.select(*by, F.inline(pairs))


def merged_sketches(sketches: DataFrame, by: tuple[str, ...] = (), counters: int = COUNTERS) -> DataFrame:
    """The sketches of each field (and ``by``) as one."""
    return sketches.groupBy(*by, "field").agg(F.expr(f"approx_top_k_combine(sketch, {counters})").alias("sketch"))


def sketched_snapshot(sketches: DataFrame, top: int = 50, counters: int = COUNTERS) -> DataFrame:
    """(field, value, count, rank) as ``facet_snapshot`` gives, from sketches of parts of the entries.

    A field with more different values than counters has counts that are off by ``most_error`` at most.
    """
    merged = merged_sketches(sketches, counters=counters)
    found = merged.select("field", F.explode(F.expr(f"approx_top_k_estimate(sketch, {counters})")).alias("e")).select("field", F.col("e.item").alias("value"), F.col("e.count").alias("count"))
    order = Window.partitionBy("field").orderBy(F.desc("count"), "value")  # at most ``counters`` rows
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def most_error(entries: int, counters: int = COUNTERS) -> float:
    """How far a sketched count of so many entries may be off: 3.5 parts in the sketch's table, which has
    a power of two of places, three quarters of them for counters."""
    return 3.5 / (1 << max(3, math.ceil(math.log2(counters / 0.75)))) * entries


def header_facets(entries: DataFrame) -> DataFrame:
    """Header names by side and frequency."""
    sides = [entries.select(F.lit(s).alias("side"), F.explode(F.map_keys(f"{s}.headers")).alias("name")) for s in ("request", "response")]
    return sides[0].unionByName(sides[1]).groupBy("side", "name").agg(F.count("*").alias("count")).orderBy("side", F.desc("count"), "name")


def list_fields(spark) -> DataFrame:
    """The catalogue: name, type, whether values are counted, and operators."""
    rows = [(f.name, f.kind, f.tracked, OPERATORS[f.kind]) for f in catalogue().values()]
    return spark.createDataFrame(rows, "name string, type string, tracked boolean, operators array<string>")
