"""Connections as sessions of packets.

``packets``: conn, ts, src, sport, dst, dport, length (payload bytes), flags (TCP bits, null for
others), seq, mss, window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Figures of the layers below that packets may have.
LINK = ("ttl", "ip_version", "ip_flags", "src_mac", "dst_mac")
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32


def flag_names(bits: Column) -> Column:
    """TCP flags by name, in fixed order."""
    names = (("SYN", SYN), ("ACK", ACK), ("FIN", FIN), ("RST", RST), ("PSH", PSH), ("URG", URG))
    return F.concat_ws(",", *[F.when(bits.bitwiseAND(b) != 0, n) for n, b in names])


def from_client(sport: Column, dport: Column) -> Column:
    """The end with the higher port is the client; equal ports leave the sender so."""
    return sport >= dport


def without_repeats(packets: DataFrame, milliseconds: int = 5) -> DataFrame:
    """Drops a packet with data that repeats direction, number and length of the one before it in
    its direction within a few milliseconds, as captures on several interfaces do."""
    order = Window.partitionBy("conn", "src", "sport").orderBy("ts", "seq")
    same = (F.lag("seq").over(order) == F.col("seq")) & (F.lag("length").over(order) == F.col("length"))
    near = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) <= milliseconds * 1000
    return packets.withColumn("__twice", F.coalesce(same & near & (F.col("length") > 0), F.lit(False))).filter("not __twice").drop("__twice")


def sessions(packets: DataFrame, idle_seconds: int = 20) -> DataFrame:
    """(conn, started, ended, packets, bytes, by direction, flags, MSS, window, RTT, numbers that both sides
    started from, and of ``LINK`` what packets have, as the first one has it): a session ends after more than ``idle_seconds`` without a packet, or at the first FIN or RST; what follows that
    is not counted, until a SYN opens the next session. RTT is from the first SYN to the first SYN+ACK."""
    order = Window.partitionBy("conn").orderBy("ts", "seq")
    run, earlier = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    bits = F.coalesce("flags", F.lit(0))
    closing = (bits.bitwiseAND(FIN | RST) != 0).cast("int")
    gap = F.coalesce(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) > idle_seconds * 1_000_000, F.lit(False))
    rows = packets.withColumn("__gap", gap).withColumn("__syn", bits.bitwiseAND(SYN | ACK) == SYN)
    rows = rows.withColumn("__ends", F.coalesce(F.sum(closing).over(earlier), F.lit(0)))
    known = F.coalesce(F.max(F.when(F.col("__gap") | F.col("__syn"), F.col("__ends"))).over(earlier), F.lit(0))  # ends before the last opening
    rows = rows.withColumn("__known", known).withColumn("__new", (F.col("__gap") | (F.col("__syn") & (F.col("__ends") > F.col("__known")))).cast("int"))
    rows = rows.withColumn("session", F.sum("__new").over(run))
    before = Window.partitionBy("conn", "session").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__closed", F.coalesce(F.max(closing).over(before), F.lit(0))).filter("__closed = 0")
    client = from_client(F.col("sport"), F.col("dport"))
    us = F.unix_micros("ts")
    at = F.struct("ts", "seq")
    first = lambda want: F.min(F.when(bits.bitwiseAND(SYN | ACK) == want, us))
    return rows.groupBy("conn", "session").agg(
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        F.count("*").alias("packets"),
        F.sum("length").alias("bytes"),
        F.sum(F.when(client, F.col("length")).otherwise(0)).alias("client_bytes"),
        F.sum(F.when(~client, F.col("length")).otherwise(0)).alias("server_bytes"),
        F.count_if(client).alias("client_packets"),
        F.count_if(~client).alias("server_packets"),
        flag_names(F.coalesce(F.bit_or(F.when(client, bits)), F.lit(0))).alias("client_flags"),
        flag_names(F.coalesce(F.bit_or(F.when(~client, bits)), F.lit(0))).alias("server_flags"),
        F.max("mss").alias("mss"),
        F.max_by("window", F.struct("ts", "seq")).alias("window"),
        ((first(SYN | ACK) - first(SYN)) / 1000.0).alias("rtt_ms"),
        F.max_by("seq", F.when(client & (bits.bitwiseAND(SYN | ACK) == SYN), at)).alias("seq_start"),
        F.max_by("seq", F.when(~client & (bits.bitwiseAND(SYN | ACK) == SYN | ACK), at)).alias("ack_start"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in LINK if c in packets.columns],
    )


def retransmits(packets: DataFrame) -> DataFrame:
    """(conn, src, sport, retransmits): segments with data that start before what is expected next. Those
    that start there or later, as after a loss, move the expectation to their end. That depends on each
    segment in turn, in order of ts, seq and length, so a direction of a connection is walked by one
    task, batch by batch; two numbers are kept."""
    import pandas as pd

    keys = ["conn", "src", "sport"]

    def run(frames):
        key, want, count = None, None, 0
        for frame in frames:
            done = []
            for k, part in frame.groupby(keys, sort=False, dropna=False):
                if k != key:
                    if key is not None:
                        done.append((*key, count))
                    key, want, count = k, None, 0
                for seq, size in zip(part["seq"].tolist(), part["length"].tolist(), strict=True):
                    if not size:
                        continue
                    if want is None or seq >= want:
                        want = seq + size
                    else:
                        count += 1
            yield pd.DataFrame(done, columns=[*keys, "retransmits"])
        if key is not None:
            yield pd.DataFrame([(*key, count)], columns=[*keys, "retransmits"])

    rows = packets.select(*keys, "ts", "seq", "length").repartition(*keys).sortWithinPartitions(*keys, "ts", "seq", "length")
    kinds = {f.name: f.dataType.simpleString() for f in packets.schema.fields}
    return rows.mapInPandas(run, f"conn {kinds['conn']}, src {kinds['src']}, sport {kinds['sport']}, retransmits bigint")
