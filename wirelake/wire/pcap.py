"""Classic capture files: packets as rows, and entries as synthetic frames."""

from __future__ import annotations

import ipaddress
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import conform

PACKET = "file string, number bigint, ts_us bigint, proto string, src string, dst string, sport int, dport int, ttl int, ip_version int, ip_flags string, src_mac string, dst_mac string, flags int, seq bigint, ack bigint, window int, mss int, icmp_type int, icmp_code int, payload binary, length int"
_NAMES = [c.split()[0] for c in PACKET.split(", ")]
_KINDS = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in PACKET.split(", ")]


HEADER, RECORD = 24, 16


def header(data: bytes) -> tuple[str, int, int, int]:
    """(byte order, parts of a second to a microsecond, longest record, link type) of a file."""
    order = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}.get(data[:4])
    if order is None or len(data) < HEADER:
        raise ValueError("no classic capture file")
    longest, link = struct.unpack(order[0] + "II", data[16:24])
    return *order, longest, link & 0xFFFF


def decode(link: int, frame: bytes) -> dict | None:
    """Network and transport fields of a frame; None if it holds no TCP, UDP or ICMP."""
    try:
        if link == 1:
            kind, at = int.from_bytes(frame[12:14], "big"), 14
            while kind in (0x8100, 0x88A8):
                kind, at = int.from_bytes(frame[at + 2 : at + 4], "big"), at + 4
        elif link == 113:
            kind, at = int.from_bytes(frame[14:16], "big"), 16
        elif link in (12, 101, 228, 229):
            kind, at = (0x0800 if frame[0] >> 4 == 4 else 0x86DD), 0
        else:
            return None
        if kind == 0x0800:
            head, total = (frame[at] & 15) * 4, int.from_bytes(frame[at + 2 : at + 4], "big")
            if int.from_bytes(frame[at + 6 : at + 8], "big") & 0x1FFF:
                return None  # a later fragment
            proto, ttl, version = frame[at + 9], frame[at + 8], 4
            src, dst = (str(ipaddress.IPv4Address(frame[at + k : at + k + 4])) for k in (12, 16))
            body = frame[at + head : at + (total or len(frame))]
        elif kind == 0x86DD:
            proto, ttl, version = frame[at + 6], frame[at + 7], 6
            src, dst = (str(ipaddress.IPv6Address(frame[at + k : at + k + 16])) for k in (8, 24))
            body = frame[at + 40 : at + 40 + int.from_bytes(frame[at + 4 : at + 6], "big")]
        else:
            return None
        word = lambda k: int.from_bytes(body[k : k + 2], "big")
        marks = "|".join(n for n, bit in (("DF", 0x40), ("MF", 0x20)) if version == 4 and frame[at + 6] & bit)
        macs = (frame[k : k + 6].hex(":") if link == 1 else "" for k in (6, 0))
        out = dict(zip(("src", "dst", "ttl", "ip_version", "ip_flags", "src_mac", "dst_mac"), (src, dst, ttl, version, marks, *macs), strict=True))
        if proto == 6:
            offset, mss, k = (body[12] >> 4) * 4, None, 20
            while k < offset and body[k]:
                if body[k] == 1:
                    k += 1
                    continue
                if body[k] == 2:
                    mss = word(k + 2)
                k += max(body[k + 1], 2)
            return out | {"proto": "tcp", "sport": word(0), "dport": word(2), "seq": int.from_bytes(body[4:8], "big"), "ack": int.from_bytes(body[8:12], "big"), "flags": body[13], "window": word(14), "mss": mss, "payload": body[offset:]}
        if proto == 17:
            return out | {"proto": "udp", "sport": word(0), "dport": word(2), "payload": body[8 : max(word(4), 8)]}
        if proto in (1, 58):
            return out | {"proto": "icmp", "icmp_type": body[0], "icmp_code": body[1], "payload": body[8:]}
        return None
    except IndexError:
        return None


def read_packets(spark: SparkSession, path: str, split_bytes: int = 64 << 20, ports: tuple[int, ...] = ()) -> DataFrame:
    """Packets of the capture files at a path, of a folder or a pattern, a task per ``split_bytes``; of ``ports``
    and ICMP alone if some are given. ``number`` is a record's place in its file, in bytes. The session
    is let push filters to Python sources."""
    from ..sources.captures import CaptureFiles

    spark.dataSource.register(CaptureFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": path, "splitBytes": split_bytes, "ports": ",".join(map(str, ports))}
    return spark.read.format(CaptureFiles.name()).options(**options).load().withColumn("ts", F.timestamp_micros("ts_us"))


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def severity(icmp_type, version):
    """Status of an ICMP message: unreachable and time exceeded are errors, quench, redirect and too
    big are warnings."""
    bad = ((version == 4) & icmp_type.isin(3, 11)) | ((version == 6) & icmp_type.isin(1, 3))
    odd = ((version == 4) & icmp_type.isin(4, 5)) | ((version == 6) & icmp_type.isin(2, 137))
    return F.when(bad, "error").when(odd, "warning").otherwise("success")


def icmp_entries(packets: DataFrame) -> DataFrame:
    """An entry per ICMP packet."""
    said = F.format_string("type %d code %d", "icmp_type", "icmp_code")
    rows = packets.filter("proto = 'icmp'")
    made = rows.select(F.concat_ws("-", F.lit("icmp"), F.element_at(F.split("file", "/"), -1), "number").alias("id"), F.lit("icmp").alias("protocol"), F.col("ts").alias("timestamp"), F.lit(0).alias("elapsedMs"), F.struct(F.col("src").alias("ip")).alias("src"), F.struct(F.col("dst").alias("ip")).alias("dst"),
                       F.struct(said.alias("summary"), F.col("length").cast("bigint").alias("bytes")).alias("request"), F.struct(said.alias("summary")).alias("response"), severity(F.col("icmp_type"), F.col("ip_version")).alias("status"))
    return conform(made)


# --- writing -----------------------------------------------------------------------------------


def _sum(data: bytes) -> int:
    total = sum(struct.unpack(f">{len(data) // 2}H", data[: len(data) // 2 * 2])) + (data[-1] << 8 if len(data) % 2 else 0)
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def frame(protocol: str, src: str, dst: str, sport: int, dport: int, payload: bytes) -> bytes | None:
    """An Ethernet frame with an IPv4 packet; None for addresses that aren't IPv4."""
    try:
        a, b = ipaddress.IPv4Address(src).packed, ipaddress.IPv4Address(dst).packed
    except ValueError:
        return None
    payload = payload[: 65535 - 60]
    if protocol == "icmp":
        number, body = 1, struct.pack(">BBHHH", 8, 0, 0, 1, 1) + payload
        body = body[:2] + struct.pack(">H", _sum(body)) + body[4:]
    else:
        number = 17 if protocol in ("udp", "dns") else 6
        body = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) if number == 17 else struct.pack(">HHIIBBHHH", sport, dport, 1, 1, 80, 24, 65535, 0, 0)
        body += payload
        check = _sum(a + b + struct.pack(">BBH", 0, number, len(body)) + body)
        where = 6 if number == 17 else 16
        body = body[:where] + struct.pack(">H", check) + body[where + 2 :]
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, number, 0) + a + b
    head = head[:10] + struct.pack(">H", _sum(head)) + head[12:]
    return b"\x02\0\0\0\0\x02\x02\0\0\0\0\x01\x08\x00" + head + body


def export(entries: DataFrame, path: str, limit: int = 1000) -> int:
    """Writes the newest ``limit`` entries as a capture file at a local path, oldest first: a
    frame for the request and one, ``elapsedMs`` later, for the response. The content is the raw
    data, else the body, else the summary. Returns the number of frames."""
    content = lambda s: F.coalesce(F.col(f"{s}.raw.data"), F.nullif(F.col(f"{s}.body"), F.lit("")).cast("binary"), F.col(f"{s}.summary").cast("binary"))
    rows = entries.orderBy(F.desc("seq")).limit(min(limit, 10_000))
    rows = rows.select("seq", "protocol", F.unix_micros("timestamp").alias("at"), F.coalesce("elapsedMs", F.lit(0)).alias("ms"), "src.ip", F.coalesce("src.port", F.lit(0)).alias("sport"), F.col("dst.ip").alias("dip"), F.coalesce("dst.port", F.lit(0)).alias("dport"), content("request").alias("q"), content("response").alias("r"))
    written = 0
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        frames = []
        for e in rows.orderBy("seq").toLocalIterator():
            for at, src, dst, sport, dport, data in ((e.at, e.ip, e.dip, e.sport, e.dport, e.q), (e.at + e.ms * 1000, e.dip, e.ip, e.dport, e.sport, e.r)):
                if data:
                    made = frame(e.protocol or "tcp", src or "", dst or "", sport, dport, bytes(data))
                    if made:
                        frames.append((at, made))
        for at, made in frames:
            f.write(struct.pack("<IIII", at // 1_000_000, at % 1_000_000, len(made), len(made)) + made)
            written += 1
    return written

