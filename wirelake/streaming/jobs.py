"""Streaming: ingest, live filters, rates with late data, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.facets import facet_sketches
from ..operators.history import matching
from ..sources.adapters import from_json_lines
from ..sources.rotating import RotatingLines


def ingest(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Entries from JSON lines that appear under a folder."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return from_json_lines(lines)


def live(entries: DataFrame, filter: str) -> DataFrame:
    """The entries of a stream that a filter accepts."""
    return matching(entries, filter)


def _clamped(entries: DataFrame, late_seconds: int, now: datetime | Column | None) -> DataFrame:
    at = F.col("timestamp").cast("timestamp")
    if now is not None:
        at = F.least(at, F.lit(now).cast("timestamp"))
    return entries.withColumn("timestamp", at).withWatermark("timestamp", f"{late_seconds} seconds")


def rates(entries: DataFrame, late_seconds: int = 300, now: datetime | Column | None = None) -> DataFrame:
    """Entries and errors of each second by protocol, for append mode: a second is given out once, when
    the watermark has passed it. What comes later than that isn't counted here (``too_late`` does),
    though it stays in history. Times after ``now`` count as now, so that no clock that is ahead
    moves the watermark."""
    counted = _clamped(entries, late_seconds, now).groupBy(F.window("timestamp", "1 second"), "protocol").agg(F.count("*").alias("entries"), F.count_if(F.col("status") == "error").alias("errors"))
    return counted.select(F.col("window.start").alias("second"), "protocol", "entries", "errors")


def too_late(entries: DataFrame, late_seconds: int = 300, now: datetime | Column | None = None, parts: int = 64) -> DataFrame:
    """(protocol, late) for append mode: with each micro-batch, how many of its entries ``rates`` doesn't
    count. A protocol's entries are counted in ``parts`` parts, whose sum is its count."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        late = sum(int((f["until"] <= passed).sum()) for f in frames)
        yield pd.DataFrame([(key[0], late)] if late else [], columns=["protocol", "late"])

    until = (F.unix_seconds("timestamp") + 1) * 1000
    rows = _clamped(entries, late_seconds, now).select("protocol", "timestamp", until.alias("until"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    return rows.groupBy("protocol", "part").applyInPandasWithState(step, "protocol string, late long", "n long", "append", GroupStateTimeout.NoTimeout)


def to_facet_sketches(entries: DataFrame, path: str, checkpoint: str):
    """A running query that leaves the sketches of each micro-batch under ``path``, once each; a snapshot
    then merges sketches and reads no entries."""

    def keep(df: DataFrame, batch: int) -> None:
        facet_sketches(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return entries.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def to_json_files(entries: DataFrame, path: str, checkpoint: str, per_file: int = 100_000):
    """A running query that appends entries as JSON lines, exactly once."""
    return entries.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", per_file).outputMode("append")


def to_rotating_files(entries: DataFrame, path: str, checkpoint: str, most_bytes: int = 100 << 20, keep: int = 5, seconds: float = 2):
    """A running query that flushes entries every few seconds as JSON lines, to files of so many bytes of
    which the newest stay: see ``sources.rotating``."""
    entries.sparkSession.dataSource.register(RotatingLines)
    lines = entries.select(F.to_json(F.struct("*")).alias("value"))
    options = {"path": path, "checkpointLocation": checkpoint, "mostBytes": most_bytes, "keep": keep}
    return lines.writeStream.format(RotatingLines.name()).options(**options).outputMode("append").trigger(processingTime=f"{seconds} seconds")


def to_webhook(entries: DataFrame, post: Callable[[list[str]], None], checkpoint: str, batch: int = 500):
    """A running query whose executors hand JSON documents to ``post``, ``batch`` at most at once.
    ``post`` opens its own connection; what it raises fails the batch, which is tried again."""

    def send(rows: Iterator) -> None:
        held: list[str] = []
        for row in rows:
            held.append(row.value)
            if len(held) == batch:
                post(held)
                held = []
        if held:
            post(held)

    def each(df: DataFrame, _: int) -> None:
        df.select(F.to_json(F.struct("*")).alias("value")).foreachPartition(send)

    return entries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
