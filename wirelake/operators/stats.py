"""Running totals, trailing windows, worker registry and their text exposition.

Nothing reads the clock: every operator takes ``now``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOWS = (5, 60, 300)


def totals(entries: DataFrame) -> DataFrame:
    """(kind, name, count): all entries, per protocol, and per status other than a blank one."""
    parts = F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")), *[F.struct(F.lit(c).alias("kind"), F.coalesce(c, F.lit("")).alias("name")) for c in ("protocol", "status")])
    named = entries.select(F.explode(parts).alias("p")).filter("not (p.kind = 'status' and p.name = '')")
    return named.groupBy("p.kind", "p.name").agg(F.count("*").alias("count"))


def since_clear(now_totals: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Totals less those of an earlier snapshot; protocols at or below zero go, the rest is
    floored at zero."""
    left = now_totals.join(snapshot.select("kind", "name", F.col("count").alias("was")), ["kind", "name"], "left")
    left = left.withColumn("count", F.col("count") - F.coalesce("was", F.lit(0))).drop("was")
    return left.filter((F.col("kind") != "protocol") | (F.col("count") > 0)).withColumn("count", F.greatest("count", F.lit(0).cast("bigint")))


def second_of(timestamp: Column, now: datetime) -> Column:
    """The second an entry is counted in: its own, but never one after ``now``."""
    return F.least(F.unix_seconds(timestamp), F.lit(int(now.timestamp())))


def trailing_windows(entries: DataFrame, now: datetime) -> DataFrame:
    """(seconds, entries, errors, per_second) of each trailing window, from one-second buckets
    less than so many seconds old; late arrivals count for the second they belong to."""
    age = F.lit(int(now.timestamp())) - second_of(F.col("timestamp"), now)
    recent = entries.select(age.alias("age"), (F.col("status") == "error").alias("bad")).filter(F.col("age") < max(WINDOWS))
    sums = recent.agg(*[x for w in WINDOWS for x in (F.count_if(F.col("age") < w).alias(f"n{w}"), F.count_if((F.col("age") < w) & F.col("bad")).alias(f"e{w}"))])
    rows = F.array(*[F.struct(F.lit(w).alias("seconds"), F.col(f"n{w}").alias("entries"), F.col(f"e{w}").alias("errors"), (F.col(f"n{w}") / w).alias("per_second")) for w in WINDOWS])
    return sums.select(F.inline(rows))


def stats_history(points: DataFrame, keep: int = 300) -> DataFrame:
    """The newest samples of a (timestamp, …) series, oldest first."""
    return points.orderBy(F.desc("timestamp")).limit(keep).orderBy("timestamp")


def workers(reports: DataFrame, now: datetime, forget: int = 3600) -> DataFrame:
    """The latest report of each node (node, at, connected, entries, …) with its entries summed
    over reports; nodes gone for longer than ``forget`` seconds are dropped."""
    rest = [c for c in reports.columns if c not in ("node", "at", "entries")]
    out = reports.groupBy("node").agg(F.max("at").alias("at"), F.sum("entries").alias("entries"), F.max_by(F.struct(*rest), "at").alias("last"))
    out = out.select("node", "at", "entries", "last.*")
    return out.filter(F.col("connected") | (F.unix_seconds("at") >= int(now.timestamp()) - forget))


def registry(frames: DataFrame, now: datetime, forget: int = 3600) -> DataFrame:
    """The workers that some frames (``adapters.worker_frames``) tell of: node, connected, version,
    connectedAt, lastSeen, entries, and their latest report. Nodes that are not connected and were last
    seen more than ``forget`` seconds ago are dropped."""
    when = F.struct("at", "place")
    latest = lambda c, on: F.max_by(F.when(on, c), F.when(on, when))
    hello, ends, report = (F.col("kind") == k for k in ("hello", "end", "report"))
    out = frames.groupBy("node").agg(
        latest(hello, hello | ends).alias("connected"),
        latest(F.col("version"), hello).alias("version"),
        F.max(F.when(hello, F.col("at"))).alias("connectedAt"),
        F.max(F.when(~ends, F.col("at"))).alias("lastSeen"),
        F.sum("entries").alias("entries"),
        latest(F.col("report"), report).alias("report"),
    )
    out = out.filter(F.col("connected") | (F.unix_seconds("lastSeen") >= int(now.timestamp()) - forget))
    return out.select("node", "connected", "version", "connectedAt", "lastSeen", "entries", "report.*")


def exposition(totals: DataFrame, prefix: str = "wirelake") -> DataFrame:
    """Text lines of counters by protocol and status, in the exposition format of metrics."""
    name = F.when(F.col("kind") == "total", f"{prefix}_entries_total").otherwise(F.concat(F.lit(f"{prefix}_entries_by_"), F.col("kind"), F.lit("_total")))
    labels = F.when(F.col("kind") == "total", "").otherwise(F.concat(F.lit("{"), F.col("kind"), F.lit('="'), F.regexp_replace("name", r'(["\\])', r"\\$1"), F.lit('"}')))
    return totals.select(F.concat(name, labels, F.lit(" "), F.col("count").cast("string")).alias("line")).orderBy("line")


def worker_exposition(workers: DataFrame, prefix: str = "wirelake") -> DataFrame:
    """Text lines of each worker: entries received and whether it is connected, and every other whole
    number that it reports, as a counter of its name."""
    node = F.concat(F.lit('{node="'), F.regexp_replace("node", r'(["\\])', r"\\$1"), F.lit('"} '))
    numbers = [f.name for f in workers.schema.fields if f.dataType.simpleString() in ("bigint", "int") and f.name != "entries"]
    names = {"entries": "entries_total", "connected": "connected"}
    for n in numbers:
        names[n] = f"{''.join('_' + c.lower() if c.isupper() else c for c in n)}_total"
    lines = [F.concat(F.lit(f"{prefix}_worker_{shown}"), node, F.coalesce(F.col(n).cast("bigint"), F.lit(0)).cast("string")) for n, shown in names.items()]
    return workers.select(F.explode(F.array(*lines)).alias("line")).orderBy("line")
