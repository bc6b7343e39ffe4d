"""Comparing two windows, and clustering errors by what they say."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import text
from .history import matching
from .summary import group_keys


def digits_folded(s: Column) -> Column:
    """Every run of digits as one '#'."""
    return F.regexp_replace(s, "[0-9]+", "#")


def rate(errors: Column, count: Column) -> Column:
    return F.when(count > 0, errors / count).otherwise(F.lit(0.0))


def diff(entries: DataFrame, before, after, by: str = "workload", filter: str = "", limit: int | None = 20) -> DataFrame:
    """Keys of two windows, each (since, until), side by side with their changes.

    Both windows are aggregated in one pass, whole keys, so a key of a long tail can't look new
    only for having been cut off. Worst first: by the change of the error rate, of p95, of the
    count, all descending, then key.
    """
    inside = lambda w: F.col("timestamp").between(F.lit(w[0]), F.lit(w[1]))
    rows = matching(entries, filter).filter(inside(before) | inside(after))
    rows = rows.select(F.explode(group_keys(by)).alias("key"), "status", F.coalesce("elapsedMs", F.lit(0)).alias("ms"), inside(before).alias("b"), inside(after).alias("a"))
    measures = []
    for side, name in (("b", "before"), ("a", "after")):
        p95 = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY ms) FILTER (WHERE {side})")
        measures += [F.count_if(side).alias(f"{name}_count"), F.count_if(F.col(side) & (F.col("status") == "error")).alias(f"{name}_errors"), F.coalesce(p95.cast("bigint"), F.lit(0).cast("bigint")).alias(f"{name}_p95")]
    c = F.col
    out = rows.groupBy("key").agg(*measures).select(
        "*",
        rate(c("before_errors"), c("before_count")).alias("before_rate"),
        rate(c("after_errors"), c("after_count")).alias("after_rate"),
        F.when(c("before_count") == 0, "appeared").when(c("after_count") == 0, "disappeared").otherwise("changed").alias("status"),
    )
    out = out.select("*", *[(c(f"after_{m}") - c(f"before_{m}")).alias(f"{m}_delta") for m in ("count", "errors", "rate", "p95")])
    out = out.orderBy(F.desc("rate_delta"), F.desc("p95_delta"), F.desc("count_delta"), "key")
    return out if limit is None else out.limit(limit)


def error_clusters(entries: DataFrame, filter: str = "", since=None, until=None, newest: int = 2000, limit: int | None = 20, samples: int = 3) -> DataFrame:
    """Failed and doubtful entries, the newest ones, grouped by protocol, target workload, status,
    code and response text with digits folded; with the newest ``samples`` ids of each."""
    rows = matching(entries, filter, since, until).filter(F.col("status").isin("error", "warning")).orderBy(F.desc("seq")).limit(newest)
    rows = rows.select("protocol", text("dst.workload").alias("workload"), "status", F.coalesce("statusCode", F.lit(0)).alias("statusCode"), digits_folded(text("response.summary")).alias("summary"), "timestamp", "seq", "id")
    out = rows.groupBy("protocol", "workload", "status", "statusCode", "summary").agg(
        F.count("*").alias("count"),
        F.min("timestamp").alias("firstSeen"),
        F.max("timestamp").alias("lastSeen"),
        # at most `newest` rows reach this aggregate
        F.transform(F.slice(F.sort_array(F.collect_list(F.struct("seq", "id")), asc=False), 1, samples), lambda x: x["id"]).alias("ids"),
    )
    out = out.orderBy(F.desc("count"), "summary")
    return out if limit is None else out.limit(limit)


#: Lines of a text up to which two are compared.
MOST_LINES = 400


def line_diff(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """``pairs`` with ``changes``: the lines of two texts as an array of (op, line), op being same, del
    or add, with as many lines alike as possible. Null for texts of over MOST_LINES lines, which are
    shown side by side; null texts count as empty. Of equally good ways a line goes before one comes."""

    def changes(old: list[str], new: list[str]):
        if max(len(old), len(new)) > MOST_LINES:
            return None
        y = np.array(new, dtype=object)
        common = np.zeros((len(old) + 1, len(new) + 1), np.int32)  # lines alike from here on
        for i in range(len(old) - 1, -1, -1):
            best = np.maximum(common[i + 1, :-1], common[i + 1, 1:] + (y == old[i]))
            common[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
        out, j = [], 0
        for i, line in enumerate(old):
            while j < len(new) and new[j] != line and common[i, j + 1] > common[i + 1, j]:
                out.append({"op": "add", "line": new[j]})
                j += 1
            same = j < len(new) and new[j] == line
            out.append({"op": "same" if same else "del", "line": line})
            j += same
        return out + [{"op": "add", "line": line} for line in new[j:]]

    @F.pandas_udf("array<struct<op: string, line: string>>")
    def compared(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([changes(a.split("\n"), b.split("\n")) for a, b in zip(old, new, strict=True)], dtype=object)

    return pairs.withColumn("changes", compared(F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))))
