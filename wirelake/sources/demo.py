"""Synthetic traffic: any number of entries from a seed, made where they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import conform

# The mix of protocols, each with its port and what is asked of it.
_MIX = [("http", 8080, "GET /api/items"), ("http", 8080, "POST /api/orders"), ("redis", 6379, "GET session"), ("postgres", 5432, "SELECT * FROM orders"), ("dns", 53, "payment.shop.svc"), ("kafka", 9092, "PRODUCE topic=orders (v7)"),
        ("mysql", 3306, "SELECT 1"), ("mongodb", 27017, "find users"), ("amqp", 5672, "Basic.Publish"), ("tcp", 443, "tls"), ("udp", 123, "ntp"), ("icmp", 0, "echo request")]


def demo_entries(spark: SparkSession, rows: int = 0, per_second: int = 25, seed: int = 1, start: int = 1_704_067_200, numbers: DataFrame | None = None) -> DataFrame:
    """``rows`` entries, or one for each of the ``numbers`` (a column n), ``per_second`` of them a second from
    ``start``; equal seeds, equal rows."""
    dice = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("n")), F.lit(n))
    mix = F.array(*[F.struct(F.lit(p).alias("protocol"), F.lit(q).alias("port"), F.lit(s).alias("said")) for p, q, s in _MIX])
    names = F.array(*map(F.lit, ("frontend", "cart", "payment", "catalog", "search", "billing")))
    spaces = F.array(*map(F.lit, ("shop", "platform", "kube-system")))
    pick = lambda a, k, n: F.element_at(a, (dice(k, n) + 1).cast("int"))
    df = (spark.range(rows).withColumnRenamed("id", "n") if numbers is None else numbers.select("n")).withColumn("m", F.element_at(mix, (dice(0, len(_MIX)) + 1).cast("int")))
    code = F.when(dice(1, 100) < 3, 500).when(dice(1, 100) < 9, 404).otherwise(200)
    end = lambda k: F.struct(F.concat(F.lit("10.0."), dice(k, 4).cast("string"), F.lit("."), dice(k + 1, 250).cast("string")).alias("ip"), pick(names, k + 2, 6).alias("workload"), pick(spaces, k + 3, 3).alias("namespace"))
    return conform(
        df.select(
            F.concat(F.lit("demo-"), F.col("n").cast("string")).alias("id"),
            F.col("m.protocol").alias("protocol"),
            F.timestamp_micros(F.lit(start * 1_000_000) + F.col("n") * (1_000_000 // per_second)).alias("timestamp"),
            dice(2, 400).alias("elapsedMs"),
            F.concat(F.lit("node-"), dice(3, 5).cast("string")).alias("node"),
            end(10).alias("src"),
            end(20).withField("port", F.col("m.port")).alias("dst"),
            F.struct(F.col("m.said").alias("summary")).alias("request"),
            F.struct(code.cast("string").alias("summary")).alias("response"),
            code.alias("statusCode"),
            F.when(code >= 500, "error").when(code >= 400, "warning").otherwise("success").alias("status"),
            (F.col("n") + 1).alias("seq"),
        )
    )
