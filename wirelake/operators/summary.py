"""Grouped summaries, timelines and the call graph: one partial-aggregated shuffle each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import fields
from ..schema import text
from .history import matching

MOST_BUCKETS = 1000
#: Seconds from the first day of year 1, on which buckets are aligned, to 1970.
YEAR_ONE = 62_135_596_800


def label(side: str) -> Column:
    """How an endpoint is called: workload, else name, with its namespace; else its address."""
    name = F.coalesce(F.nullif(text(f"{side}.workload"), F.lit("")), F.nullif(text(f"{side}.name"), F.lit("")))
    space = text(f"{side}.namespace")
    return F.when(name.isNull(), text(f"{side}.ip")).when(space != "", F.concat(space, F.lit("/"), name)).otherwise(name)


def dotted_label(side: str) -> Column:
    """The other spelling, of maps and exports: name.namespace, else name, else address."""
    name, space = text(f"{side}.name"), text(f"{side}.namespace")
    return F.when(name == "", text(f"{side}.ip")).when(space != "", F.concat(name, F.lit("."), space)).otherwise(name)


def group_keys(by: str) -> Column:
    """The keys that an entry counts for, as an array without blanks and repeats: both ends for
    ``workload`` and ``namespace`` (so spelled), else the one value of a filter field."""
    if by == "workload":
        both = [label("src"), label("dst")]
    elif by == "namespace":
        both = [text("src.namespace"), text("dst.namespace")]
    else:
        field = fields.find(by)
        if field is None:
            raise ValueError(f"can't group by {by!r}")
        both = [field.text()]
    return F.array_distinct(F.filter(F.array(*both), lambda k: k != ""))


def _measures(*, seen: bool = True, protocols: bool = True) -> list[Column]:
    elapsed = F.coalesce("elapsedMs", F.lit(0))
    nearest = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY coalesce(elapsedMs, 0))").cast("bigint")
    out = [F.count("*").alias("count"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "warning").alias("warnings")]
    if protocols:
        out.append(F.sort_array(F.collect_set(text("protocol"))).alias("protocols"))
    out += [nearest(0.5).alias("p50"), nearest(0.95).alias("p95"), F.max(elapsed).alias("max")]
    if seen:
        out += [F.min("timestamp").alias("firstSeen"), F.max("timestamp").alias("lastSeen")]
    return out


def summarise(entries: DataFrame, by: str = "workload") -> DataFrame:
    """Measures per key, unordered and whole; percentiles are nearest-rank."""
    return entries.withColumn("key", F.explode(group_keys(by))).groupBy("key").agg(*_measures())


def summary(entries: DataFrame, by: str = "workload", limit: int | None = 50, filter: str = "", since=None, until=None) -> DataFrame:
    """The busiest keys: by count, then errors, both descending, then key."""
    out = summarise(matching(entries, filter, since, until), by).orderBy(F.desc("count"), F.desc("errors"), "key")
    return out if limit is None else out.limit(limit)


def top_view(entries: DataFrame, by: str = "workload", sort: str = "calls", order: str = "desc", limit: int | None = 50, filter: str = "", since=None, until=None) -> DataFrame:
    """Keys in order of their calls, share of errors (errRate), p50 or p95; ties by key. All keys are
    sorted, not only the busiest."""
    values = {"calls": F.col("count"), "errRate": F.col("errors") / F.col("count"), "p50": F.col("p50"), "p95": F.col("p95")}
    if sort not in values:
        raise ValueError(f"can't sort by {sort!r}")
    out = summarise(matching(entries, filter, since, until), by).orderBy(values[sort].asc() if order == "asc" else values[sort].desc(), "key")
    return out if limit is None else out.limit(limit)


def list_namespaces(entries: DataFrame) -> DataFrame:
    return summary(entries, "namespace", 200)


def list_workloads(entries: DataFrame) -> DataFrame:
    return summary(entries, "workload", 200)


def graph(entries: DataFrame, filter: str = "", since=None, until=None, focus: str = "") -> DataFrame:
    """Directed call edges with measures; a blank end drops the entry, a call to oneself stays.
    ``focus`` keeps entries one end of which has that workload, name or label."""
    rows = matching(entries, filter, since, until)
    if focus:
        near = lambda s: (text(f"{s}.workload") == focus) | (text(f"{s}.name") == focus) | (label(s) == focus)
        rows = rows.filter(near("src") | near("dst"))
    rows = rows.select(label("src").alias("src"), label("dst").alias("dst"), "status", "elapsedMs")
    rows = rows.filter((F.col("src") != "") & (F.col("dst") != ""))
    return rows.groupBy("src", "dst").agg(*_measures(seen=False, protocols=False)).orderBy(F.desc("count"), F.desc("errors"), "src", "dst")


def map_nodes(entries: DataFrame, window: int = 800) -> DataFrame:
    """Calls in, calls out and failed calls in of each node over the newest entries."""
    rows = entries.orderBy(F.desc("seq")).limit(window).select(dotted_label("src").alias("src"), dotted_label("dst").alias("dst"), (F.col("status") == "error").alias("bad"))
    ends = rows.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("in"), F.lit(1).alias("out"), F.lit(0).alias("bad")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("in"), F.lit(0).alias("out"), F.col("bad").cast("int").alias("bad")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.in").alias("calls_in"), F.sum("e.out").alias("calls_out"), F.sum("e.bad").alias("errors_in"))


def map_edges(entries: DataFrame, window: int = 800) -> DataFrame:
    """Calls, failures and total latency of each edge over the newest entries."""
    rows = entries.orderBy(F.desc("seq")).limit(window)
    return rows.groupBy(dotted_label("src").alias("src"), dotted_label("dst").alias("dst")).agg(F.count("*").alias("count"), F.count_if(F.col("status") == "error").alias("errors"), F.sum(F.coalesce("elapsedMs", F.lit(0))).alias("latency"))


def bucket_start(seconds: Column, bucket: int) -> Column:
    """A time in seconds cut to a multiple of the bucket since year 1."""
    return F.floor((seconds + YEAR_ONE) / F.lit(bucket)) * bucket - YEAR_ONE


def timeline(entries: DataFrame, since: datetime, until: datetime, bucket: int = 60, filter: str = "", clip: bool = False) -> DataFrame:
    """Entries, errors and warnings per bucket of so many seconds, empty buckets included.

    Buckets start at ``since`` cut to the bucket grid; of more than 1000 the newest stay. Entries
    from the first bucket's start to ``until`` inclusive count; with ``clip`` (an explicit
    ``since``) only those from ``since`` on.
    """
    first = int((since.timestamp() + YEAR_ONE) // bucket * bucket - YEAR_ONE)
    count = max(int((until.timestamp() - first) // bucket) + 1, 1)
    if count > MOST_BUCKETS:
        first, count = first + (count - MOST_BUCKETS) * bucket, MOST_BUCKETS
    seconds = F.unix_micros("timestamp") / F.lit(1e6)
    rows = matching(entries, filter, since if clip else None, until).filter(F.col("timestamp") >= F.timestamp_seconds(F.lit(first)))
    n = F.floor((seconds - first) / bucket).cast("bigint")
    counted = rows.groupBy(n.alias("n")).agg(F.count("*").alias("entries"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "warning").alias("warnings"))
    spine = entries.sparkSession.range(count).withColumnRenamed("id", "n")
    zero = F.lit(0).cast("bigint")
    return spine.join(counted, "n", "left").select(F.timestamp_seconds(F.col("n") * bucket + first).alias("start"), *[F.coalesce(c, zero).alias(c) for c in ("entries", "errors", "warnings")]).orderBy("start")
