"""Parsers on bytes, capture files there and back, dissection, demo traffic and streaming."""

import gzip
import json
import os
import random
import struct
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wirelake.operators.pairing import keyed_pairs
from wirelake.schema import conform
from wirelake.sources import captures
from wirelake.sources.demo import demo_entries
from wirelake.streaming import jobs, ordered
from wirelake.wire import amqp, dissect, dns, http, kafka, mongo, mysql, pcap, postgres, resp, sniff


def test_http():
    body = gzip.compress(b"hello" * 2000)
    data = b"GET /a?x=1 HTTP/1.1\r\nHost: h\r\n\r\nPOST /b HTTP/1.1\r\nContent-Length: 3\r\n\r\nabcHEAD /c HTTP/1.1\r\n\r\n"
    asked = http.messages(data)
    assert [m.first[1:3] for m in asked] == [("GET", "/a?x=1"), ("POST", "/b"), ("HEAD", "/c")] and asked[1].body == b"abc"
    answers = b"HTTP/1.1 100 Continue\r\n\r\nHTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Length: %d\r\n\r\n%b" % (len(body), body)
    answers += b"HTTP/1.1 500 No\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x\r\nde\r\n0\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\n"
    got = http.messages(answers, [False, False, True])
    assert [m.first[1] for m in got] == [200, 500, 200] and got[0].body == (b"hello" * 2000)[:4096] and got[1].body == b"abcde" and got[2].body == b""


def test_websocket():
    masked = bytes([0x81, 0x83, 1, 2, 3, 4]) + bytes(b ^ k for b, k in zip(b"hey", (1, 2, 3), strict=True))
    close = bytes([0x88, 5, 3, 232]) + b"bye"
    got = http.frames(masked + close)
    assert [(f["opcode"], f["preview"]) for f in got] == [("text", b"hey"), ("close", b"\x03\xe8bye")] and (got[1]["code"], got[1]["reason"]) == (1000, "bye")


def dns_bytes(number, answer=None, code=0):
    name = b"\x03www\x07example\x03com\x00"
    flags = 0x8180 | code if answer is not None else 0x0100
    out = struct.pack(">HHHHHH", number, flags, 1, int(bool(answer)), 0, 0) + name + b"\0\1\0\1"
    return out + (b"\xc0\x0c\0\1\0\1" + struct.pack(">IH", 60, 4) + answer if answer else b"")


def test_dns():
    m = dns.parse(dns_bytes(7, bytes([1, 2, 3, 4])))
    assert (m["id"], m["question"], m["answer"], m["rcode"], m["status"]) == (7, "www.example.com", "1.2.3.4", "NOERROR", "success")
    assert dns.parse(dns_bytes(7, b"", 3))["status"] == "error" and dns.parse(b"short") is None and dns.parse(b"\0" * 12 + b"\xc0") is not None
    assert dns.parse(struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c\0\1\0\1") is None


def test_resp():
    """Arrays, inline commands and every kind of reply, cut ones included."""
    bulk = lambda *parts: b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%b\r\n" % (len(x), x) for x in parts)
    sent = b"echo  tide\r\n" + bulk(b"zadd", b"heights", b"4.5", b"dover") + bulk(b"TTL", "mär".encode())
    assert [resp.command(v) for v in resp.values(sent)] == [("ECHO", ["tide"]), ("ZADD", ["heights", "4.5", "dover"]), ("TTL", ["mär"])]
    told = {b"$0\r\n\r\n": ("", "success"), b"_\r\n": ("(nil)", "success"), b":-7\r\n": ("(integer) -7", "success"), b"-WRONGTYPE no list\r\n": ("WRONGTYPE no list", "error"), b"%2\r\n+low\r\n:1\r\n+high\r\n:9\r\n": ("(map) 2 items", "success"), b"+QUEUED\r\n": ("QUEUED", "success")}
    got = [resp.reply(v) for v in resp.values(b"".join(told))]
    assert [(g[0], g[2]) for g in got] == list(told.values())
    assert resp.values(b"*1\r\n" * 99) == [] and resp.values(bulk(b"tide")[:-3]) == []


def pg(kind, content):
    return kind.encode() + struct.pack(">I", len(content) + 4) + content


def test_postgres():
    start = struct.pack(">II", 8, 196608)
    asked = postgres.requests(start + pg("Q", b"SELECT 1\0") + pg("P", b"s1\0UPDATE t SET a=$1\0\0\0") + pg("B", b"\0s1\0\0\0\0\2" + struct.pack(">I", 2) + b"42" + struct.pack(">I", 3) + b"bob\0\0") + pg("E", b"\0\0\0\0\0"))
    assert [(q["query"], q["statementName"], q["params"]) for q in asked] == [("SELECT 1", "", []), ("UPDATE t SET a=$1", "s1", ["42", "bob"])]
    column = b"id\0" + struct.pack(">IHIHIH", 0, 0, 23, 4, 0, 0)
    got = postgres.responses(pg("T", struct.pack(">H", 1) + column) + pg("D", b"\0\0") * 2 + pg("C", b"SELECT 2\0") + pg("E", b"SERROR\0C42P01\0Mno table\0\0") + pg("Z", b"E"))
    assert (got[0]["summary"], got[0]["rowCount"], got[0]["columns"][0]["type"]) == ("SELECT 2 (2 rows)", 2, "int4") and got[1]["status"] == "error" and got[1]["error"]["code"] == "42P01" and got[1]["txStatus"] == "E"


def kafka_frame(raw):
    return struct.pack(">I", len(raw)) + raw


def test_kafka():
    raw = struct.pack(">hhih", 0, 7, 42, 3) + b"cli" + struct.pack(">hhiih", -1, 1, 1000, 1, 6) + b"gauges"
    q = kafka.requests(kafka_frame(raw))[0]
    assert (q["summary"], q["correlationId"], q["clientId"]) == ("PRODUCE topic=gauges (v7)", 42, "cli")
    answer = struct.pack(">iih", 42, 1, 6) + b"gauges" + struct.pack(">iih", 1, 0, 3)
    a = kafka.responses(kafka_frame(answer), {42: ("Produce", 7)})[0]
    assert (a["errorCode"], a["status"]) == (3, "error")


def my(number, raw):
    return len(raw).to_bytes(3, "little") + bytes([number]) + raw


def test_mysql():
    asked = mysql.requests(my(0, b"\x03SELECT 1") + my(0, b"\x0e") + my(0, b"\x03bad") + my(0, b"\x01"))
    assert [(q["command"], q["query"]) for q in asked] == [("QUERY", "SELECT 1"), ("PING", ""), ("QUERY", "bad"), ("QUIT", "")]
    result = my(1, b"\x01") + my(2, b"\x03def") + my(3, b"\xfe\0\0\2\0") + my(4, b"\x011") + my(5, b"\x012") + my(6, b"\xfe\0\0\2\0")
    got = mysql.responses(my(0, b"\x0a8.0") + result + my(1, b"\0\0\0") + my(1, b"\xff\x28\x04#42000syntax"), ["QUERY", "PING", "QUERY"])
    assert [(r["rowCount"], r["errorCode"], r["status"]) for r in got] == [(2, 0, "success"), (0, 0, "success"), (0, 1064, "error")] and got[2]["errorMessage"] == "syntax"


def bson(**members):
    out = b""
    for k, v in members.items():
        if isinstance(v, str):
            out += b"\x02" + k.encode() + b"\0" + struct.pack("<i", len(v) + 1) + v.encode() + b"\0"
        else:
            out += b"\x01" + k.encode() + b"\0" + struct.pack("<d", v)
    return struct.pack("<i", len(out) + 5) + out + b"\0"


def test_mongo():
    def message(number, answers, **members):
        raw = struct.pack("<i", 0) + b"\0" + bson(**members)
        return struct.pack("<iiii", 16 + len(raw), number, answers, 2013) + raw

    pairs = dissect.exchanges("mongodb", message(5, 0, find="users", **{"$db": "app"}), message(9, 5, ok=0.0, errmsg="no"))
    (q, a), = pairs
    assert q["mongo"] == {"command": "find", "collection": "users", "database": "app"} and a["status"] == "error" and a["mongo"]["errmsg"] == "no"


def test_amqp():
    def frame(kind, raw):
        return struct.pack(">BHI", kind, 1, len(raw)) + raw + b"\xce"

    short = lambda s: bytes([len(s)]) + s
    data = b"AMQP\0\0\x09\x01" + frame(1, struct.pack(">HHH", 60, 40, 0) + short(b"gauges") + short(b"set") + b"\0")
    data += frame(2, struct.pack(">HHQH", 60, 0, 5, 0x8400) + short(b"text/plain") + short(b"c-1")) + frame(3, b"hel") + frame(3, b"lo") + frame(1, struct.pack(">HHQB", 60, 120, 7, 0))
    a, b = amqp.methods(data)
    assert (a["class"], a["method"], a["exchange"], a["routingKey"], a["body"], a["contentType"], a["correlationId"], a["size"]) == ("Basic", "Publish", "gauges", "set", b"hello", "text/plain", "c-1", 5)
    assert (b["method"], b["deliveryTag"], b["status"]) == ("Nack", 7, "warning")


def test_no_parser_crashes():
    import random

    rng = random.Random(1)
    seeds = [b"GET / HTTP/1.1\r\n\r\n", b"*2\r\n$3\r\nGET\r\n", pg("Q", b"x\0"), dns_bytes(1, b"\1\2\3\4"), kafka_frame(b"\0" * 20), my(0, b"\x03SELECT"), bson(find="x"), struct.pack(">BHI", 1, 1, 4) + b"\0\x3c\0\x28\xce"]
    for _ in range(1500):
        data = bytearray(rng.choice(seeds) * 2)
        for _ in range(rng.randint(0, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        data = bytes(data[: rng.randint(0, len(data))])
        for parse in (http.messages, http.frames, resp.values, postgres.requests, postgres.responses, dns.parse, kafka.requests, mysql.requests, mongo.messages, mongo.fields, amqp.methods, lambda d: mysql.responses(d, ["QUERY"] * 3), lambda d: kafka.responses(d, {})):
            parse(data)
    assert sniff.by_content(b"AMQP\0\0\x09\1") == "amqp" and sniff.by_content(b"*1\r\n") == "redis" and sniff.by_content(struct.pack(">II", 8, 196608)) == "postgres" and sniff.by_content(b"GET /") == "http"


def segment(src, dst, sport, dport, seq, flags, payload, us):
    a, b = (bytes(map(int, x.split("."))) for x in (src, dst))
    tcp = struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 80, flags, 65535, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0) + a + b
    made = b"\0" * 12 + b"\x08\x00" + ip + tcp
    return struct.pack("<IIII", us // 10**6, us % 10**6, len(made), len(made)) + made


def test_dissection(spark, tmp_path):
    c, s, head = "10.0.0.1", "10.0.0.2", struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    t = 1_704_067_200_000_000
    ask = b"GET /a HTTP/1.1\r\nHost: h\r\n\r\n"
    data = head + segment(c, s, 5000, 8080, 1, 2, b"", t) + segment(c, s, 5000, 8080, 12, 24, ask[10:], t + 20) + segment(c, s, 5000, 8080, 2, 24, ask[:10], t + 10) + segment(c, s, 5000, 8080, 2, 24, ask[:10], t + 30)
    data += segment(s, c, 8080, 5000, 1, 24, b"HTTP/1.1 503 Busy\r\nContent-Length: 0\r\n\r\n", t + 42_000) + segment(c, s, 50010, 6379, 1, 24, b"*2\r\n$3\r\nGET\r\n$1\r\nk\r\n", t) + segment(s, c, 6379, 50010, 1, 24, b"$1\r\nv\r\n", t + 3000)
    udp = pcap.frame("dns", c, s, 5353, 53, dns_bytes(9))
    back = pcap.frame("dns", s, c, 53, 5353, dns_bytes(9, b"\1\2\3\4"))
    data += b"".join(struct.pack("<IIII", t // 10**6, k * 1000, len(f), len(f)) + f for k, f in enumerate((udp, back))) + b"cut off"
    (tmp_path / "x.pcap").write_bytes(data)
    packets = pcap.read_packets(spark, str(tmp_path / "x.pcap"))
    assert packets.count() == 9
    got = {r.protocol: r for r in dissect.dissect_streams(packets).collect()}
    assert (got["http"].statusCode, got["http"].status, got["http"].request.path, got["http"].src.port, got["http"].elapsedMs) == (503, "error", "/a", 5000, 41)
    assert (got["redis"].request.command, got["redis"].response.summary) == ("GET", "v")
    messages = dissect.dns_messages(packets)
    pair = keyed_pairs(messages, ["client", "port", "id"]).collect()
    assert [(p.client, p.port, p.id, p.elapsed_ms) for p in pair] == [(c, 5353, 9, 1)]
    assert json.loads(messages.filter("not is_request").first().message)["answer"] == "1.2.3.4"
    (named,) = dissect.dns_entries(packets).collect()
    assert (named.protocol, named.status, named.elapsedMs, named.src.ip, named.src.port, named.dst.ip, named.seq) == ("dns", "success", 1, c, 5353, s, 1)
    assert (named.request.summary, named.response.answer, named.response.dns.rcode, named.response.dns.answers[0].ttl) == ("A www.example.com", "1.2.3.4", "NOERROR", 60)


def test_capture_entries(spark, tmp_path):
    """Exchanges carry the figures of their connection; what holds none is a flow; the command line writes them."""
    from wirelake.__main__ import main

    c, s, head = "10.7.0.1", "10.7.0.2", struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    t = 1_704_067_200_000_000
    data = head + segment(c, s, 5000, 8080, 1, 2, b"", t) + segment(s, c, 8080, 5000, 1, 18, b"", t + 4000) + segment(c, s, 5000, 8080, 2, 24, b"GET /rain HTTP/1.1\r\n\r\n", t + 6000) + segment(s, c, 8080, 5000, 2, 24, b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\n\r\n", t + 9000)
    data += segment(c, s, 5001, 443, 1, 2, b"", t) + segment(s, c, 443, 5001, 1, 4, b"", t + 8000)
    other = [pcap.frame("udp", c, s, 40000, 123, b"time"), pcap.frame("icmp", c, s, 0, 0, b"x" * 8), pcap.frame("dns", c, s, 5353, 53, dns_bytes(9)), pcap.frame("dns", s, c, 53, 5353, dns_bytes(9, b"\1\2\3\4"))]
    data += b"".join(struct.pack("<IIII", t // 10**6, 10_000 + k * 1000, len(f), len(f)) + f for k, f in enumerate(other))
    (tmp_path / "w.pcap").write_bytes(data)
    entries = dissect.capture_entries(pcap.read_packets(spark, str(tmp_path / "w.pcap"))).cache()
    got = {r.protocol: r for r in entries.collect()}
    assert sorted(got) == ["dns", "http", "icmp", "tcp", "udp"] and entries.count() == 5
    web, flow = got["http"], got["tcp"]
    assert (web.l4.rttMs, web.l4.clientPackets, web.l4.serverPackets, web.l4.clientTcpFlags, web.elapsedMs) == (4.0, 2, 2, "SYN,ACK,PSH", 3)
    assert (web.l4.ttl, web.l4.ipVersion, web.l4.srcMac is not None) == (64, 4, True)
    assert (flow.request.summary, flow.status, flow.elapsedMs, flow.request.packets, flow.src.port, flow.dst.port, flow.response.summary) == ("tcp https", "error", 8, 2, 5001, 443, "closed · 108 B · 2 pkts")
    assert (got["udp"].request.summary, got["udp"].response.summary[:4], got["icmp"].status, got["icmp"].request.summary) == ("udp/123", "idle", "success", "type 8 code 0")
    main(["--pcap-file", str(tmp_path / "w.pcap"), "--filter", "protocol == http or status == error", "--out", str(tmp_path / "lines")])
    assert {json.loads(r.value)["protocol"] for r in spark.read.text(str(tmp_path / "lines")).collect()} == {"http", "tcp"}
    main(["--demo", "30", "--out", str(tmp_path / "demo")])
    assert spark.read.text(str(tmp_path / "demo")).count() == 30


def test_dissection_hides_secrets_and_tells_connections_apart(spark, tmp_path):
    """Credentials never leave; a reused port and numbers that wrap lose no byte."""
    c, s, head = "10.9.0.1", "10.9.0.2", struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    t, top = 1_704_067_200_000_000, (1 << 32) - 10
    ask = b"GET /gauge?id=4&Token=hush HTTP/1.1\r\nHost: h\r\nAuthorization: Basic hush\r\nX-Request-Id: r7\r\n\r\n"
    answer = b"HTTP/1.1 200 OK\r\nContent-Length: 0\r\nSet-Cookie: k=hush\r\n\r\n"
    data = head + segment(c, s, 6001, 8080, top - 1, 2, b"", t) + segment(c, s, 6001, 8080, top, 24, ask[:20], t + 10) + segment(c, s, 6001, 8080, 10, 24, ask[20:], t + 20) + segment(s, c, 8080, 6001, 5, 24, answer, t + 30)
    data += segment(c, s, 6001, 8080, 900, 2, b"", t + 4_000_000) + segment(c, s, 6001, 8080, 901, 24, ask.replace(b"gauge", b"radar"), t + 4_000_010) + segment(s, c, 8080, 6001, 77, 24, answer, t + 4_000_020)
    word = lambda *w: b"*%d\r\n" % len(w) + b"".join(b"$%d\r\n%s\r\n" % (len(x), x) for x in w)
    data += segment(c, s, 50020, 6379, 1, 24, word(b"AUTH", b"bob", b"hush") + word(b"CONFIG", b"SET", b"requirepass", b"hush"), t + 50) + segment(s, c, 6379, 50020, 1, 24, b"+OK\r\n+OK\r\n", t + 60)
    (tmp_path / "y.pcap").write_bytes(data)
    packets = pcap.read_packets(spark, str(tmp_path / "y.pcap"))
    rows = dissect.dissect_streams(packets).orderBy("seq").collect()
    assert not any("hush" in str(r) for r in rows) and len(rows) == 4
    assert [r.request.path for r in rows if r.protocol == "http"] == ["/gauge?Token=%5BREDACTED%5D&id=4", "/radar?Token=%5BREDACTED%5D&id=4"]
    web = rows[0]
    assert (web.traceId, web.request.http.query, web.request.headers["authorization"]) == ("r7", {"id": "4", "Token": "[REDACTED]"}, "[REDACTED]")
    assert len({r.seq for r in rows}) == 4 and [r.timestamp for r in rows] == sorted(r.timestamp for r in rows)
    assert {r.request.summary for r in rows if r.protocol == "redis"} == {"AUTH [REDACTED] [REDACTED]", "CONFIG SET requirepass [REDACTED]"}
    assert "hush" in str(dissect.dissect_streams(packets, redact=False).collect())


def test_dissection_times_messages_by_their_bytes(spark, tmp_path):
    """Two messages in a packet and one over three keep the times of their first bytes."""
    c, s, head = "10.8.0.1", "10.8.0.2", struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    t = 1_704_067_200_000_000
    word = lambda *w: b"*%d\r\n" % len(w) + b"".join(b"$%d\r\n%s\r\n" % (len(x), x) for x in w)
    both, long = word(b"SELECT", b"3") + word(b"GET", b"rain"), word(b"SET", b"wind", b"n" * 40)
    answers = [b"+OK\r\n$4\r\n\x00\xff\x01\x02\r\n", b"+OK\r\n"]
    data = head + segment(c, s, 50030, 6379, 1, 24, both, t)
    at = 1 + len(both)
    for k in range(3):
        part = long[k * 20 : k * 20 + 20 if k < 2 else None]
        data += segment(c, s, 50030, 6379, at, 24, part, t + 100_000 + k * 10_000)
        at += len(part)
    data += segment(s, c, 6379, 50030, 1, 24, answers[0], t + 5_000) + segment(s, c, 6379, 50030, 1 + len(answers[0]), 24, answers[1], t + 170_000)
    (tmp_path / "z.pcap").write_bytes(data)
    rows = dissect.dissect_streams(pcap.read_packets(spark, str(tmp_path / "z.pcap"))).orderBy("seq").collect()
    assert [(r.request.command, r.elapsedMs, r.request.redis.dbIndex) for r in rows] == [("SELECT", 5, 0), ("GET", 5, 3), ("SET", 70, 3)]
    assert rows[2].timestamp - rows[1].timestamp == timedelta(milliseconds=100) and rows[1].response.summary == "\\x00ff0102"


def test_previews_and_frames_of_both_sides():
    from wirelake.wire.preview import shown

    assert shown("é\n".encode()) == "é\n" and shown(b"\x00" * 40) == "\\x" + "00" * 32 + "… (40 bytes)" and shown(b"\xff") == "\\xff"
    assert shown("aé".encode()[:2], 9) == "a" and shown("aé".encode()[:2]) == "\\x61c3"
    frame = lambda text: bytes([0x81, len(text)]) + text
    up = b"GET /live HTTP/1.1\r\nUpgrade: websocket\r\n\r\n"
    pairs = dissect.exchanges("http", up + frame(b"hail"), b"HTTP/1.1 101 Switching\r\n\r\n" + frame(b"snow") + frame(b"\x00\x01"))
    assert [(q.get("from"), q["body"]) for q, _ in pairs[1:]] == [(0, "hail"), (1, "snow"), (1, "\\x0001")] and pairs[1][0]["at"] == len(up)


def test_export_reads_back(spark, tmp_path):
    side = "struct<ip: string, port: int>"
    rows = [("a", "http", ("10.0.0.1", 5000), ("10.0.0.2", 80), ("GET /",), ("200 OK",), datetime(2024, 1, 1, tzinfo=UTC), 12, 1), ("b", "dns", ("10.0.0.3", 5353), ("10.0.0.4", 53), ("q",), ("r",), datetime(2024, 1, 1, 0, 0, 1, tzinfo=UTC), 5, 2), ("c", "http", ("2001:db8::1", 1), ("2001:db8::2", 2), ("x",), ("y",), datetime(2024, 1, 1, tzinfo=UTC), 1, 3)]
    df = conform(spark.createDataFrame(rows, f"id string, protocol string, src {side}, dst {side}, request struct<summary: string>, response struct<summary: string>, timestamp timestamp, elapsedMs bigint, seq bigint"))
    path = str(tmp_path / "out.pcap")
    assert pcap.export(df, path) == 4
    got = pcap.read_packets(spark, path).orderBy("number").collect()
    assert [(r.proto, r.src, r.sport, bytes(r.payload)) for r in got] == [("tcp", "10.0.0.1", 5000, b"GET /"), ("tcp", "10.0.0.2", 80, b"200 OK"), ("udp", "10.0.0.3", 5353, b"q"), ("udp", "10.0.0.4", 53, b"r")]
    assert got[1].ts_us - got[0].ts_us == 12_000


def test_demo(spark):
    a, b = (demo_entries(spark, 500, seed=3) for _ in range(2))
    shown = [F.to_json(F.struct("*")).alias("v")]
    assert a.select(shown).exceptAll(b.select(shown)).count() == 0 and a.select("protocol").distinct().count() == 11


def test_streams(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    entries = demo_entries(spark, 300, per_second=50)
    entries.select(F.to_json(F.struct("*")).alias("value")).coalesce(3).write.mode("overwrite").text(str(tmp_path / "in"))
    stream = jobs.live(jobs.ingest(spark, str(tmp_path / "in")), 'protocol == "http"')
    assert jobs.to_json_files(stream, str(tmp_path / "out"), str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
    want = entries.filter("protocol = 'http'").count()
    assert spark.read.json(str(tmp_path / "out")).count() == want
    counted = jobs.rates(jobs.ingest(spark, str(tmp_path / "in")))
    assert counted.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.sql("select sum(entries) as n from rates").first().n == 300


def test_stateful_pairs(spark, tmp_path):
    base = datetime(2024, 1, 1, tzinfo=UTC)
    t = lambda s: base + timedelta(seconds=s)
    rows = [("c", t(0), 0, True), ("c", t(1), 1, True), ("c", t(2), 2, False), ("c", t(40), 3, False), ("d", t(0), 4, False), ("d", t(1), 5, True), ("d", t(3), 6, False)]
    spark.createDataFrame(rows, "conn string, ts timestamp, seq bigint, is_request boolean").coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("conn string, ts timestamp, seq bigint, is_request boolean").parquet(str(tmp_path / "m"))
    ordered.with_timers(spark)
    assert ordered.pair_in_order(stream, late="0 seconds").writeStream.format("memory").queryName("pairs").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.conn, r.request_seq, r.response_seq, r.elapsed_ms) for r in spark.sql("select * from pairs").collect()}
    assert got == {("c", 0, 2, 2000), ("d", 5, 6, 2000)}


def whole_file(path):
    """(place, microseconds, frame) of a capture file, walked from its start."""
    data, at = open(path, "rb").read(), 24
    while at + 16 <= len(data):
        seconds, micros, size, _ = struct.unpack("<IIII", data[at : at + 16])
        if at + 16 + size > len(data):
            return
        yield at, seconds * 10**6 + micros, data[at + 16 : at + 16 + size]
        at += 16 + size


def nested_capture(path, n, seed):
    """A capture whose payloads hold records of captures themselves, some up to the end of their packet."""
    rng, t = random.Random(seed), 1_704_067_200
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 2000, 1))
        for i in range(n):
            inner = b"".join(struct.pack("<IIII", t + k, 5, 20, 20) + bytes(20) for k in range(rng.randint(0, 30)))
            payload = rng.choice([inner, inner + b"x" * rng.randint(1, 9), rng.randbytes(rng.randint(0, 200)), bytes(rng.randint(0, 300))])
            frame = pcap.frame(rng.choice(["tcp", "udp", "icmp"]), "10.0.0.1", "10.0.0.2", rng.choice([80, 443, 5000]), 7000 + i % 3, payload)
            f.write(struct.pack("<IIII", t + i, i, len(frame), len(frame)) + frame)
        f.write(struct.pack("<IIII", t, 0, 90, 90) + b"cut")


@pytest.mark.parametrize("split", [64, 999, 40_000, 1 << 20])
def test_ranges_of_a_capture_file(tmp_path, split):
    """Ranges however cut give every record once, whatever packets hold."""
    path = str(tmp_path / "a.pcap")
    nested_capture(path, 120, split)
    want, got = list(whole_file(path)), []
    reader = captures.CaptureReader(path, split, frozenset())
    parts = reader.partitions()
    assert len(parts) == -(-(os.path.getsize(path) - 24) // split)
    files, name = captures.file_system(path)
    for p in parts:
        with files.open_input_file(name) as f:
            got += captures.records(f, p.start, p.end, "<", 1, 2000)
    assert got == want and len(want) == 120


def test_capture_files_in_many_tasks(spark, tmp_path):
    for k in range(3):
        nested_capture(f"{tmp_path}/f{k}.pcap", 400, k)
    packets = pcap.read_packets(spark, f"{tmp_path}/f*.pcap", 20_000)
    assert packets.rdd.getNumPartitions() > 20
    whole = pcap.read_packets(spark, str(tmp_path))
    assert packets.count() == whole.count() == 1200 and packets.exceptAll(whole).count() == 0
    icmp = pcap.icmp_entries(packets)
    assert icmp.count() == icmp.select("id").distinct().count() > 100
    some = pcap.read_packets(spark, str(tmp_path), 20_000).filter("sport in (80, 443) and proto = 'tcp'")
    assert some.count() == sum(r.sport in (80, 443) and r.proto == "tcp" for r in whole.collect()) > 0
    near = "proto = 'icmp' or sport in (80) or dport in (80)"
    assert pcap.read_packets(spark, str(tmp_path), ports=(80,)).count() == whole.filter(near).count()
