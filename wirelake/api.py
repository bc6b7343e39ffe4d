"""The entry points of the traffic engine over one table of entries.

Parameters are taken as a request would bring them, as text, and bounded the same way. Everything
but ``export_pcap`` and ``capped`` returns a DataFrame; nothing reads the clock unless ``now`` is
left out.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import compare, facets, history, stats
from .operators import summary as sums

CAPACITY = 10_000
MOST_TEXT = 100_000


class Traffic:
    """Queries over ``entries``; ``reports`` (worker reports) and ``points`` (samples) are optional."""

    def __init__(self, entries: DataFrame, reports: DataFrame | None = None, points: DataFrame | None = None, now: datetime | None = None):
        self._entries, self._reports, self._points, self._now = entries, reports, points, now

    @property
    def now(self) -> datetime:
        return self._now or datetime.now(UTC)

    def _range(self, since: str, until: str):
        return tuple(history.parse_time(v, self.now) if v else None for v in (since, until))

    def entries(self, filter="", since="", until="", limit=None, sort="", order="desc", before_seq=None, before=None) -> DataFrame:
        """A page of entries. ``sort`` ignores cursors; ``before_seq`` wins over ``before``; a
        cursor of 0 or empty text is one that nothing precedes, None is none at all."""
        n, (a, b) = history.clamp(limit, 200, CAPACITY), self._range(since, until)
        if sort:
            return history.top_k(self._entries, sort, order, n, filter, a, b)
        if before_seq is not None:
            return history.before_seq(self._entries, int(before_seq), n, filter, a, b)
        if before is not None:
            return history.before_id(self._entries, before, n, filter, a, b)
        return history.latest(self._entries, n, filter, a, b)

    def entry(self, id: str) -> DataFrame:
        return history.by_id(self._entries, id)

    def entry_text(self, id: str) -> DataFrame:
        """The entry as indented JSON, members it lacks left out; no row if there is none of that id."""
        return self.entry(id).select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("text"))

    def entries_table(self, column="time", order="desc", filter="", since="", until="", limit=None) -> DataFrame:
        return history.sorted_table(self._entries, column, order, history.clamp(limit, 200, CAPACITY), filter, *self._range(since, until))

    def next_cursor(self, page: DataFrame, limit=None) -> int | None:
        """What to pass as ``before_seq`` for the page after ``page``, None at the end."""
        return history.next_cursor(page, history.clamp(limit, 200, CAPACITY))

    def stats(self) -> DataFrame:
        """Totals and trailing windows as (kind, name, count)."""
        windows = stats.trailing_windows(self._entries, self.now).select(F.lit("window").alias("kind"), F.col("seconds").cast("string").alias("name"), F.col("entries").alias("count"))
        return stats.totals(self._entries).unionByName(windows)

    def stats_history(self) -> DataFrame:
        return stats.stats_history(self._points)

    def summary(self, group_by="workload", filter="", since="", until="", limit=None) -> DataFrame:
        return sums.summary(self._entries, group_by, history.clamp(limit, 50, 1000), filter, *self._range(since, until))

    def top(self, group_by="workload", sort="calls", order="desc", filter="", since="", until="", limit=None) -> DataFrame:
        return sums.top_view(self._entries, group_by, sort, order, history.clamp(limit, 50, 1000), filter, *self._range(since, until))

    def timeline(self, bucket=None, filter="", since="", until="") -> DataFrame:
        a, b = self._range(since, until)
        b = b or self.now
        return sums.timeline(self._entries, a or b - timedelta(minutes=15), b, history.clamp(bucket, 60, 3600), filter, clip=a is not None)

    def graph(self, filter="", since="", until="", focus="") -> DataFrame:
        return sums.graph(self._entries, filter, *self._range(since, until), focus)

    def diff(self, before: tuple[str, str], after: tuple[str, str], group_by="workload", filter="", limit=20) -> DataFrame:
        return compare.diff(self._entries, self._range(*before), self._range(*after), group_by, filter, limit)

    def error_clusters(self, filter="", since="", until="", limit=20) -> DataFrame:
        return compare.error_clusters(self._entries, filter, *self._range(since, until), limit=limit)

    def fields(self) -> DataFrame:
        return facets.list_fields(self._entries.sparkSession)

    def field_values(self, name: str, prefix="", limit=None) -> DataFrame:
        return facets.field_values(self._entries, name, prefix, history.clamp(limit, 50, 200))

    def list_namespaces(self) -> DataFrame:
        return sums.list_namespaces(self._entries)

    def list_workloads(self) -> DataFrame:
        return sums.list_workloads(self._entries)

    def workers(self) -> DataFrame:
        return stats.workers(self._reports, self.now)

    def metrics(self) -> DataFrame:
        """Lines of the totals and, where there are reports, of each worker."""
        lines = stats.exposition(stats.totals(self._entries))
        return lines if self._reports is None else lines.unionByName(stats.worker_exposition(self.workers()))

    def export_pcap(self, path: str, filter="", since="", until="", limit=None) -> int:
        from .wire import pcap

        return pcap.export(history.matching(self._entries, filter, *self._range(since, until)), path, history.clamp(limit, 1000, CAPACITY))


def capped(text: str, most: int = MOST_TEXT) -> str:
    """At most so many bytes of UTF-8, cut between characters, with a notice where cut."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    return raw[:most].decode("utf-8", "ignore") + f"\n… cut at {most} of {len(raw)} bytes"
