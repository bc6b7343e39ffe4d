"""Pairing requests with responses, as scans and window functions over each connection.

``messages``: conn, ts, seq (order of arrival within a connection), is_request, and whatever else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def connection(ip_a: Column, port_a: Column, ip_b: Column, port_b: Column) -> Column:
    """One key for both directions: the two 'ip:port' texts in order."""
    a, b = F.concat_ws(":", ip_a, port_a), F.concat_ws(":", ip_b, port_b)
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


#: Bounds that bind nothing, for rows that leave a queue's head where it is.
_LOW, _HIGH = -(1 << 62), 1 << 62
#: Rows of a slice of a connection, in which each request counts twice: a slice takes whole buckets of time
#: until it has them. Buckets within the time that a request waits.
SLICE_ROWS, BUCKETS = 1 << 18, 128


def _running_bounds(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """``rows`` with ``from_`` and ``to_``: what the bounds ``lo`` and ``hi`` of the rows before it in
    its group come to. Bounds applied one after the other are one pair of bounds, so a group's rows
    may be cut anywhere and put together again. Rows go through tasks in order; two numbers are kept."""
    import pyarrow as pa

    rows = rows.repartition(*group).sortWithinPartitions(*group, *order)
    n = len(group)

    def run(batches):
        key, low, high = None, _LOW, _HIGH
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*group, "lo", "hi")]
            lows, highs = [], []
            for row in zip(*columns, strict=True):
                if row[:n] != key:
                    key, low, high = row[:n], _LOW, _HIGH
                lows.append(low)
                highs.append(high)
                lo, hi = row[n:]
                low, high = min(max(low, lo), hi), min(max(high, lo), hi)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=[*batch.schema.names, "from_", "to_"])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add("from_", "long").add("to_", "long"))


def fifo_pairs(messages: DataFrame, expire_seconds: int | None = 30, backlog: int | None = 1024, epoch: str | None = None) -> DataFrame:
    """(conn, request_seq, response_seq, elapsed_ms, depth): each response with the oldest request
    that still waits on its connection, ``depth`` of which waited before it.

    A request is forgotten once it has waited for more than ``expire_seconds``, and when more than
    ``backlog`` wait, the oldest is; a response that finds none is dropped. ``epoch``: a column that
    changes at a loss, across which nothing pairs. None: no bound of that kind.

    With requests numbered per connection, a queue is the number of its first one. A response at a
    time when ``T`` requests have come and those before ``L`` are forgotten moves it from ``h`` to
    ``min(max(h, L) + 1, T + 1)``: apart from the count of responses, a pair of bounds. So connections
    are cut into slices of time, of about ``SLICE_ROWS`` rows however many come at once; each slice gives one pair
    of bounds, and a second scan, of one row per slice, gives the state that every slice begins with.
    """
    keys = ["conn"] + ([epoch] if epoch else [])
    width = (expire_seconds or 3600) * 1_000_000
    rows = messages.withColumn("us", F.unix_micros("ts")).select(*keys, "us", "seq", "is_request", F.lit(False).alias("gone"))
    if expire_seconds is not None:  # a request comes again when it is forgotten
        rows = rows.unionByName(rows.filter("is_request").withColumn("us", F.col("us") + width + 1).withColumn("gone", F.lit(True)))
    rows = rows.withColumn("bucket", F.floor(F.col("us") / (width // BUCKETS)))
    counts = {"requests": F.col("is_request") & ~F.col("gone"), "responses": ~F.col("is_request"), "forgotten": F.col("gone")}
    buckets = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("all"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    buckets = buckets.select(*keys, "bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("all", *counts)))
    buckets = buckets.withColumn("slice", F.floor(F.col("all_before") / SLICE_ROWS))
    group = [*keys, "slice"]
    starts = [F.min(f"{c}_before").over(Window.partitionBy(*group)).alias(f"{c}_before") for c in counts]
    rows = rows.join(buckets.select(*group, "bucket", *starts), [*keys, "bucket"])
    order = Window.partitionBy(*group).orderBy("us", F.col("gone").desc(), "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = lambda n: F.col(f"{n}_before") + F.sum(F.when(counts[n], 1).otherwise(0)).over(order)
    rows = rows.select(
        *group,
        "us",
        "seq",
        "is_request",
        "gone",
        so_far("requests").alias("t"),
        so_far("responses").alias("k"),
        (so_far("forgotten") + 1).cast("bigint").alias("fresh"),
    ).filter("not gone")
    overflow = F.lit(1) if backlog is None else F.col("t") - backlog + 1
    rows = rows.withColumn("least", F.greatest("fresh", overflow))
    bound = lambda c, none: F.when(F.col("is_request"), F.lit(none)).otherwise(c).cast("bigint")
    rows = rows.withColumn("lo", bound(F.col("least") + 1 - F.col("k"), _LOW)).withColumn("hi", bound(F.col("t") + 1 - F.col("k"), _HIGH))
    rows = _running_bounds(rows, group, ["us", "seq"])

    within = lambda c: F.least(F.greatest(c, F.col("lo")), F.col("hi"))
    last = rows.groupBy(*group).agg(F.max_by(F.struct(within(F.col("from_")).alias("lo"), within(F.col("to_")).alias("hi")), F.struct("us", "seq")).alias("b"))
    begins = _running_bounds(last.select(*group, "b.lo", "b.hi"), keys, ["slice"])
    begins = begins.select(*group, F.least(F.greatest(F.lit(1), F.col("from_")), F.col("to_")).alias("begin"))

    rows = rows.join(begins, group)
    head = F.least(F.greatest(F.col("begin"), F.col("from_")), F.col("to_")) + F.col("k") - F.when(F.col("is_request"), 0).otherwise(1)
    rows = rows.withColumn("head", head)
    spill = F.lit(1) if backlog is None else F.col("t") - backlog
    requests = rows.filter("is_request").select(*keys, F.col("t").alias("number"), F.col("seq").alias("request_seq"), F.col("us").alias("at"), (F.col("t") - F.greatest("head", "fresh", spill)).alias("depth"))
    responses = rows.filter(~F.col("is_request")).withColumn("number", F.greatest("head", "least")).filter(F.col("number") <= F.col("t"))
    pairs = requests.join(responses.select(*keys, "number", F.col("seq").alias("response_seq"), "us"), [*keys, "number"])
    return pairs.select(*keys, "request_seq", "response_seq", F.floor((F.col("us") - F.col("at")) / 1000).alias("elapsed_ms"), "depth")


def keyed_pairs(messages: DataFrame, keys: list[str], expire_seconds: int = 30) -> DataFrame:
    """(keys…, request_seq, response_seq, elapsed_ms) of protocols whose messages carry a number:
    the first response after a key's latest request, within the time. A newer request with the
    same key replaces the older one."""
    order = Window.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = messages.withColumn("__turn", F.sum(F.when(F.col("is_request"), 1).otherwise(0)).over(order)).filter("__turn > 0")
    request = F.max(F.when(F.col("is_request"), F.struct("ts", "seq")))
    response = F.min(F.when(~F.col("is_request"), F.struct("ts", "seq")))
    pairs = rows.groupBy(*keys, "__turn").agg(request.alias("q"), response.alias("r")).filter("r is not null")
    pairs = pairs.withColumn("elapsed_ms", F.floor((F.unix_micros("r.ts") - F.unix_micros("q.ts")) / 1000)).filter(F.col("elapsed_ms") <= expire_seconds * 1000)
    return pairs.select(*keys, F.col("q.seq").alias("request_seq"), F.col("r.seq").alias("response_seq"), "elapsed_ms")


def attach_latest(rows: DataFrame, snapshots: DataFrame, key: str = "conn", at: str = "ts", value: str = "state") -> DataFrame:
    """As-of join: the newest snapshot at or before each row, by one union and one window."""
    both = rows.select(key, at, F.struct(*rows.columns).alias("__row"), F.lit(None).cast(snapshots.schema[value].dataType).alias(value)).unionByName(
        snapshots.select(key, at, F.lit(None).cast(rows.schema.simpleString()).alias("__row"), value)
    )
    order = Window.partitionBy(key).orderBy(F.col(at), F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(order)).filter("__row is not null").select("__row.*", value)


