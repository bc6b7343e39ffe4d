"""Reading history: newest first pages, cursors, top-k, lookups, time ranges, retention.

Newest means the largest ``seq``, the arrival number. Every limit is an ``orderBy().limit()``,
which Spark runs as one bounded heap per task.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import fields, ifl


def matching(entries: DataFrame, filter: str = "", since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Entries within [since, until] that a filter accepts; bounds are inclusive."""
    if since is not None:
        entries = entries.filter(F.col("timestamp") >= F.lit(since))
    if until is not None:
        entries = entries.filter(F.col("timestamp") <= F.lit(until))
    condition = ifl.where(filter)
    return entries if condition is None else entries.filter(condition)


def latest(entries: DataFrame, limit: int = 200, filter: str = "", since=None, until=None) -> DataFrame:
    """The newest matching entries, newest first."""
    return matching(entries, filter, since, until).orderBy(F.desc("seq")).limit(limit)


def before_seq(entries: DataFrame, seq: int, limit: int = 200, filter: str = "", since=None, until=None) -> DataFrame:
    """As ``latest``, strictly older than a sequence number; 1 and below match nothing."""
    return latest(entries.filter(F.col("seq") < seq), limit, filter, since, until)


def before_id(entries: DataFrame, id: str, limit: int = 200, filter: str = "", since=None, until=None) -> DataFrame:
    """As ``latest``, strictly older than the newest entry with that id; none if there is none."""
    anchor = entries.filter(F.col("id") == id).agg(F.max("seq").alias("seq")).scalar()
    return latest(entries.filter(F.col("seq") < anchor), limit, filter, since, until)


def by_id(entries: DataFrame, id: str) -> DataFrame:
    """The newest entry with an id."""
    return entries.filter(F.col("id") == id).orderBy(F.desc("seq")).limit(1)


def sort_value(name: str) -> Column:
    """The value that a top-k orders by, null where it has none; only canonical number fields."""
    field = fields.catalogue().get(name)
    if field is None or field.kind != "number":
        raise ValueError(f"{name!r} is no number field to sort by")
    if field.path == "response.mysql.errorCode":
        return F.when(F.col(field.path) != 0, F.col(field.path))
    if not field.guards:
        return F.coalesce(F.col(field.path), F.lit(0))
    return F.when(F.col(field.guards[-1]).isNotNull(), F.coalesce(F.col(field.path), F.lit(0)))


def top_k(entries: DataFrame, sort: str, order: str = "desc", limit: int = 200, filter: str = "", since=None, until=None) -> DataFrame:
    """The matching entries with the largest (or smallest) value of a number field; entries
    without a value take no part, and ties go to the newer entry."""
    value = sort_value(sort)
    rows = matching(entries, filter, since, until).filter(value.isNotNull())
    return rows.orderBy(value.asc() if order == "asc" else value.desc(), F.desc("seq")).limit(limit)


#: Columns that a table of entries is sorted by.
TABLE_COLUMNS = {"proto": "protocol", "status": "status", "latency": "elapsedMs", "time": "timestamp", "node": "node", "bytes": "request.bytes", "packets": "request.packets"}


def sorted_table(entries: DataFrame, column: str, order: str = "asc", limit: int = 200, filter: str = "", since=None, until=None) -> DataFrame:
    """The first matching entries in order of a column of the table; absent texts count as empty and
    absent numbers as zero, and ties go to the newer entry."""
    if column not in TABLE_COLUMNS:
        raise ValueError(f"{column!r} is no column to sort by")
    value = F.col(TABLE_COLUMNS[column])
    if column != "time":
        value = F.coalesce(value, F.lit("" if column in ("proto", "status", "node") else 0))
    return matching(entries, filter, since, until).orderBy(value.desc() if order == "desc" else value.asc(), F.desc("seq")).limit(limit)


def next_cursor(page: DataFrame, limit: int) -> int | None:
    """The ``before_seq`` of the page after a newest-first one; None where this one isn't full, so
    nothing older is left."""
    seen = page.agg(F.count("*").alias("n"), F.min("seq").alias("seq")).first()
    return seen.seq if seen.n and seen.n >= limit else None


def replay(entries: DataFrame, filter: str = "", limit: int = 500) -> DataFrame:
    """What a new subscriber is sent first: the newest matching entries, oldest first."""
    return latest(entries, limit, filter).orderBy("seq")


def retained(entries: DataFrame, capacity: int = 10_000, budget: int = 64 << 20, size: Column | None = None) -> DataFrame:
    """What a store bounded by entries and by bytes still holds.

    Rows larger than the whole budget were never stored; of the others the newest stay, as many
    as fit both bounds. Running totals are taken over the newest ``capacity`` rows alone, so the
    one ordered window sees a bounded number of rows.
    """
    size = F.length(F.to_json(F.struct("*"))) if size is None else size
    newest = entries.withColumn("__size", size.cast("bigint")).filter(F.col("__size") <= budget).orderBy(F.desc("seq")).limit(capacity)
    running = F.sum("__size").over(Window.orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return newest.withColumn("__sum", running).filter(F.col("__sum") <= budget).drop("__size", "__sum")


def parse_time(value: str, now: datetime) -> datetime:
    """RFC 3339, else unix seconds, else a positive duration ('15m', '1h30m') before ``now``."""
    if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", value):
        return datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", value))
    if re.fullmatch(r"[+-]?\d+", value):
        return datetime.fromtimestamp(int(value), UTC)
    units = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
    if re.fullmatch(r"\+?((\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h))+", value):
        seconds = sum(float(n) * units[u] for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", value))
        if seconds > 0:
            return now - timedelta(seconds=seconds)
    raise ValueError(f"no time: {value!r}")


def clamp(value: str | int | None, default: int, most: int, least: int = 1) -> int:
    """A bounded whole number; what isn't one, or lies below ``least``, gives the default."""
    try:
        number = int(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return default if number < least else min(number, most)


def compact(entries: DataFrame) -> DataFrame:
    """The short record that listings show."""
    from .summary import label

    return entries.select("id", "seq", "protocol", "timestamp", label("src").alias("src"), label("dst").alias("dst"), F.coalesce("request.summary", F.lit("")).alias("summary"), "status", "statusCode", "elapsedMs", F.col("response.summary").alias("response"))
