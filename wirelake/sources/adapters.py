"""Entries from other tables, and from their JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ENTRY, conform


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as traffic; blanks on both ends are deliberate."""
    return entries_of_events(read_table(spark, sf_dir, "events"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of the table's files."""
    schema = read_table(spark, sf_dir, "events").schema
    return entries_of_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque*"))


def entries_of_events(e: DataFrame, *also: str) -> DataFrame:
    """Rows of ``events``, batch or streaming, as entries, with some of their columns besides."""
    user, kind = F.col("user_id"), F.col("event_type")
    space = F.element_at(F.array(*map(F.lit, ("shop", "platform", "kube-system", ""))), (user % 4 + 1).cast("int"))
    of_kind = lambda default, **m: F.expr("CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + f" ELSE '{default}' END")
    status = of_kind("success", error="error", signup="warning")
    return conform(
        e.select(
            F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("id"),
            of_kind("tcp", view="http", click="redis", purchase="postgres", signup="dns").alias("protocol"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.floor("value").cast("bigint").alias("elapsedMs"),
            F.struct(F.concat(F.lit("10.0.1."), (user % 250).cast("string")).alias("ip"), F.lit("").alias("name"), space.alias("namespace"), F.when(user % 7 == 0, "").otherwise(F.concat(F.lit("wl-"), (user % 16).cast("string"))).alias("workload")).alias("src"),
            F.struct(F.lit("10.0.2.9").alias("ip"), (F.lit(8000) + user % 3).cast("int").alias("port"), F.lit("").alias("name"), of_kind("", view="shop", click="platform").alias("namespace"), F.when(kind == "error", "").otherwise(kind).alias("workload")).alias("dst"),
            F.struct(F.concat(F.lit("/"), kind, F.lit("/"), user.cast("string")).alias("path"), F.when(kind == "view", "GET").when(kind == "purchase", "POST").alias("method"), F.col("props").alias("summary"), F.create_map(F.lit("user-agent"), F.concat(F.lit("agent/"), (user % 5).cast("string"))).alias("headers")).alias("request"),
            F.struct(F.concat(F.lit("user "), user.cast("string"), F.lit(" "), status).alias("summary"), F.create_map(F.when(kind == "view", "content-type").otherwise("x-served-by"), F.lit("a")).alias("headers")).alias("response"),
            status.alias("status"),
            F.expr("CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 200 END").alias("statusCode"),
            (F.col("event_id") + 1).alias("seq"),
            *also,
        ),
        *also,
    )


def sales_as_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as calls from the customer's nation to the supplier's."""
    t = lambda n: read_table(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", "n_name")
    src, dst = (nation.select(F.col("n_nationkey").alias(f"{s}_key"), F.col("n_name").alias(f"{s}_name")) for s in ("src", "dst"))
    rows = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(src, F.col("c_nationkey") == F.col("src_key"))
        .join(dst, F.col("s_nationkey") == F.col("dst_key"))
    )
    return conform(
        rows.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
            F.lit("tcp").alias("protocol"),
            F.col("l_shipdate").cast("timestamp").alias("timestamp"),
            F.floor("l_quantity").cast("bigint").alias("elapsedMs"),
            F.struct(F.col("src_name").alias("workload")).alias("src"),
            F.struct(F.col("dst_name").alias("workload")).alias("dst"),
            F.expr("CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'success' END").alias("status"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        )
    )


def from_json_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries from JSON text, one per row or framed: ``{"type": "entry", "entry": …}`` or
    ``{"type": "entryBatch", "entries": […]}``. Frames of other types, broken text and missing
    entries give nothing. Works on batch and streaming frames alike."""
    one = ENTRY.simpleString()
    frame = F.from_json(F.col(column), f"struct<type: string, entry: {one}, entries: array<{one}>>")
    bare = F.from_json(F.col(column), one)
    some = F.when(frame["type"] == "entry", F.array(frame["entry"])).when(frame["type"] == "entryBatch", frame["entries"]).when(frame["type"].isNull() & bare["id"].isNotNull(), F.array(bare))
    rows = lines.select(F.explode(some).alias("e")).filter("e is not null")
    return conform(rows.select("e.*"))


#: What a worker says of itself in a ``workerStats`` frame.
REPORT = "dropped bigint, captureLive boolean, captureTls boolean, capturePaused boolean, ringPackets bigint, ringDrops bigint, flowsEvicted bigint, tlsLagDrops bigint, tlsBudgetDrops bigint, tcpLossEvents bigint"


def worker_frames(frames: DataFrame, column: str = "value") -> DataFrame:
    """(node, at, place, kind, entries, version, report) of the frames that workers send over connections.

    ``frames``: conn, at, place (order within a connection), and the JSON of a frame; null is the end of
    the connection. A connection belongs to the node of its latest ``hello``; what comes before one, broken
    text and frames of other types give nothing. ``entries``: how many entries a frame holds.
    """
    report = "struct<" + REPORT.replace(" ", ": ").replace(",:", ",") + ">"
    some = "struct<id: string>"  # that an entry is there is all that is counted
    frame = F.from_json(F.col(column), f"struct<type: string, hello: struct<node: string, version: string>, entry: {some}, entries: array<{some}>, workerStats: {report}>")
    rows = frames.select("conn", "at", "place", F.col(column).isNull().alias("ends"), frame.alias("f"))
    kind = F.when(F.col("ends"), "end").when((F.col("f.type") == "hello") & F.col("f.hello").isNotNull(), "hello").when(F.col("f.type").isin("entry", "entryBatch"), "entries").when((F.col("f.type") == "workerStats") & F.col("f.workerStats").isNotNull(), "report")
    held = F.when(F.col("f.type") == "entry", F.col("f.entry").isNotNull().cast("bigint")).when(F.col("f.type") == "entryBatch", F.size(F.filter(F.coalesce("f.entries", F.array().cast("array<struct<id: string>>")), lambda e: e.isNotNull())).cast("bigint"))
    # only what is short goes into the window over a connection
    rows = rows.select("conn", "at", "place", kind.alias("kind"), F.coalesce(held, F.lit(0)).alias("entries"), "f.hello", F.col("f.workerStats").alias("report")).filter("kind IS NOT NULL")
    so_far = Window.partitionBy("conn").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("node", F.last(F.when(F.col("kind") == "hello", F.coalesce("hello.node", F.lit(""))), ignorenulls=True).over(so_far)).filter("node IS NOT NULL")
    return rows.select("node", "at", "place", "kind", "entries", F.when(F.col("kind") == "hello", F.coalesce("hello.version", F.lit(""))).alias("version"), F.when(F.col("kind") == "report", F.col("report")).alias("report"))
