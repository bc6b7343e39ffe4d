"""Rows as they leave: JSON documents, the CSV of the traffic table, filters on packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import text
from .summary import dotted_label

# TCP ports that are followed unless others are named, and the UDP port.
TCP_PORTS = (6379, 5432, 5672, 53, 3306, 27017, 9092, 80, 8080)
UDP_PORTS = (53,)


def documents(entries: DataFrame) -> DataFrame:
    """One JSON document per entry, absent members left out."""
    return entries.select(F.to_json(F.struct("*")).alias("value"))


def csv_rows(entries: DataFrame) -> DataFrame:
    """The fourteen columns of the export; write with ``.write.csv(path, header=True)``."""
    return entries.select(
        "id", "timestamp", "protocol", "status", F.coalesce("statusCode", F.lit(0)).alias("statusCode"), F.coalesce("elapsedMs", F.lit(0)).alias("elapsedMs"),
        dotted_label("src").alias("source"), F.col("src.port").alias("sourcePort"), dotted_label("dst").alias("destination"), F.col("dst.port").alias("destinationPort"),
        text("request.method").alias("method"), text("request.path").alias("path"), text("request.summary").alias("request"), text("response.summary").alias("response"),
    )


def followed_packets(packets: DataFrame, tcp=TCP_PORTS, udp=UDP_PORTS, more=()) -> DataFrame:
    """Packets to or from followed ports, and all ICMP, as a kernel filter would pass them."""
    near = lambda ports: F.col("sport").isin(*ports) | F.col("dport").isin(*ports)
    return packets.filter(((F.col("proto") == "tcp") & near({*tcp, *more})) | ((F.col("proto") == "udp") & near({*udp, *more})) | (F.col("proto") == "icmp"))
