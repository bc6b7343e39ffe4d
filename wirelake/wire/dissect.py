"""From packets of TCP connections and DNS datagrams to entries.

``packets`` as ``pcap.read_packets`` gives them. Connections are grouped by key and opening; each
group is reassembled, parsed by protocol and paired in order. What leaves a task is the JSON form of
entries, so there is one reader of nested rows for every source. Credentials are blotted out in the
parsed members before anyone sees the entries.
"""

from __future__ import annotations

import json
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import flows
from ..operators.pairing import attach_latest, connection
from ..schema import conform, field_type, fitted
from ..session import materialise
from ..sources.adapters import from_json_lines
from . import amqp, dns, http, kafka, mongo, mysql, pcap, postgres, resp, sniff
from .preview import shown


def stream(packets: list[tuple[int, int, bytes]]) -> tuple[bytes, list[tuple[int, int]], bool]:
    """(bytes, [(offset, time)], lost): payloads of one direction in order of sequence numbers,
    which may wrap, repeats dropped, up to the first gap."""
    out, marks, want, lost = bytearray(), [], None, False
    base = min(packets, key=lambda p: p[1])[0] if packets else 0
    near = lambda seq: (seq - base + (1 << 31)) % (1 << 32) - (1 << 31)
    for seq, at, data in sorted(((near(s), t, d) for s, t, d in packets if d), key=lambda p: p[:2]):
        want = seq if want is None else want
        if seq > want:
            lost = True
            break
        fresh = data[want - seq :]
        if fresh:
            marks.append((len(out), at))
            out += fresh
            want += len(fresh)
    return bytes(out), marks, lost


def _time(marks: list[tuple[int, int]], offset: int) -> int:
    """Time of the packet that brought the byte at an offset."""
    return marks[max(bisect_right(marks, offset, key=lambda m: m[0]) - 1, 0)][1]


def _body(m: http.Message) -> str:
    return shown(m.body, max(m.size, len(m.body) + (len(m.body) == http.MOST_BODY)))


def exchanges(kind: str, client: bytes, server: bytes) -> list[tuple[dict, dict | None]]:
    """(request, response) records of a connection, in order; a request may lack its response. ``at``
    tells where each begins in its direction, for requests that of the client unless ``from`` is 1;
    a response without it has the time of its request."""
    if kind == "http":
        asked = http.messages(client)
        heads = [m.first[1] == "HEAD" for m in asked]
        answers = [m for m in http.messages(server, heads)]
        out = []
        for k, m in enumerate(asked):
            path, _, _ = m.first[2].partition("#")
            request = {"at": m.at, "summary": f"{m.first[1]} {path}", "method": m.first[1], "path": path, "host": m.headers.get("host", ""), "headers": m.headers, "body": _body(m), "size": m.size, "http": {"version": m.first[3], "contentType": m.headers.get("content-type", "")}}
            response = None
            if k < len(answers):
                a = answers[k]
                code = a.first[1]
                response = {"at": a.at, "summary": f"{code} {a.first[2]}".strip(), "statusCode": code, "headers": a.headers, "body": _body(a), "size": a.size, "contentType": a.headers.get("content-type", ""), "status": "error" if code >= 500 else "warning" if code >= 400 else "success"}
            out.append((request, response))
        if asked and answers and answers[-1].first[1] == 101:
            for side, begin, data in ((0, asked[-1].end, client), (1, answers[-1].end, server)):
                for f in http.frames(data[begin:]):
                    out.append(({"at": begin + f["at"], "from": side, "summary": f"{f['opcode']} {f['length']} bytes", "wsOpcode": f["opcode"], "body": shown(f["preview"], f["length"]), "size": f["length"], "protocol": "ws"}, {"status": "success"}))
        return out
    if kind in ("redis", "valkey"):
        asked = [(at, c) for at, c in ((at, resp.command(v)) for at, v in resp.placed(client)) if c]
        answers = [(at, resp.reply(v)) for at, v in resp.placed(server) if v[0] != ">"]
        out, base = [], 0
        for k, (at, (name, args)) in enumerate(asked):
            response = None
            if k < len(answers):
                end, (text, how, status) = answers[k]
                response = {"at": end, "summary": text[:256], "redis": {"reply": text[:256], "replyType": how}, "status": status}
            out.append(({"at": at, "summary": " ".join([name, *args])[:256], "command": name, "redis": {"args": args, "dbIndex": base}}, response))
            if name == "SELECT" and response and response["status"] == "success" and args and args[0].isdecimal():
                base = min(int(args[0]), 2**31 - 1)
        return out
    if kind == "postgres":
        asked, answers = postgres.requests(client), postgres.responses(server)
        out = []
        for k, q in enumerate(asked):
            response = None
            if k < len(answers):
                a = answers[k]
                response = {"at": a["at"], "summary": a["summary"], "rowCount": a["rowCount"], "status": a["status"], "postgres": {"tag": a.get("tag", ""), "columns": a["columns"], "error": a.get("error"), "txStatus": a.get("txStatus", "")}}
            out.append(({"at": q["at"], "summary": q["query"][:256], "query": q["query"][:8192], "postgres": {"statementName": q["statementName"], "portal": q["portal"], "params": q["params"]}}, response))
        return out
    if kind == "kafka":
        asked = kafka.requests(client)
        known = {q["correlationId"]: (q["apiKey"], q["apiVersion"]) for q in asked}
        answers = {a["correlationId"]: a for a in kafka.responses(server, known)}
        out = []
        for q in asked:
            a = answers.get(q["correlationId"])
            response = {"at": a["at"], "summary": "" if not a["errorCode"] else f"error {a['errorCode']}", "kafka": {"errorCode": a["errorCode"], "correlationId": a["correlationId"]}, "status": a["status"]} if a else None
            out.append(({"at": q["at"], "summary": q["summary"], "kafka": {k: q[k] for k in ("apiKey", "apiVersion", "topic", "clientId", "correlationId")}}, response))
        return out
    if kind == "mysql":
        asked = mysql.requests(client)
        answers = iter(mysql.responses(server, [q["command"] for q in asked if q["answered"]]))
        out = []
        for q in asked:
            a = next(answers, None) if q["answered"] else None
            response = {"at": a["at"], "summary": a["errorMessage"] or f"{a['rowCount']} rows", "rowCount": a["rowCount"], "mysql": {"errorCode": a["errorCode"], "errorMessage": a["errorMessage"]}, "status": a["status"]} if a else None
            out.append(({"at": q["at"], "summary": f"{q['command']} {q['query']}".strip()[:256], "query": q["query"][:8192], "mysql": {"command": q["command"]}}, response))
        return out
    if kind == "mongodb":
        answers = {m["answers"]: m for m in mongo.messages(server)}
        out = []
        for m in mongo.messages(client):
            a = answers.get(m["number"])
            response = {"at": a["at"], "summary": a["errmsg"] or "ok", "mongo": {"ok": a["ok"], "errmsg": a["errmsg"]}, "status": a["status"]} if a else None
            out.append(({"at": m["at"], "summary": f"{m['command']} {m['collection']}".strip(), "mongo": {k: m[k] for k in ("command", "collection", "database")}}, response))
        return out
    if kind == "amqp":
        members = ("exchange", "routingKey", "queue", "deliveryTag", "class", "method", "correlationId", "replyTo", "messageId", "contentType", "size")
        seen = [(k, m) for k, side in enumerate((client, server)) for m in amqp.methods(side)]
        return [({"at": m["at"], "from": k, "summary": f"{m['class']}.{m['method']}", "body": shown(m["body"], m.get("size")), **{n: m[n] for n in members if n in m}}, {"summary": m.get("replyText", ""), "status": m["status"]}) for k, m in seen]
    return []


def redacted(entries: DataFrame) -> DataFrame:
    """``entries`` without the values of secret URL parameters and headers, of credentials in commands
    of key-value stores, and of bound parameters; summaries are made again from what is left."""
    request, response = F.col("request"), F.col("response")
    args = fn.redacted_command(request["command"], request["redis"]["args"])
    summary = F.when(args.isNotNull(), F.left(F.concat_ws(" ", request["command"], args), F.lit(256))).when(request["method"].isNotNull(), fn.redacted_url(request["summary"])).otherwise(request["summary"])
    shown = (
        request.withField("summary", summary)
        .withField("path", fn.redacted_url(request["path"]))
        .withField("headers", fn.redacted_headers(request["headers"]))
        .withField("redis", F.when(request["redis"].isNotNull(), request["redis"].withField("args", args)))
        .withField("postgres", F.when(request["postgres"].isNotNull(), request["postgres"].withField("params", fn.redacted_parameters(request["postgres"]["params"]))))
    )
    return entries.withColumn("request", shown).withColumn("response", response.withField("headers", fn.redacted_headers(response["headers"])))


def _numbered(entries: DataFrame) -> DataFrame:
    """Numbers in order of time, growing, not dense; written once, so they are the same for every reader."""
    return materialise(conform(entries.orderBy("timestamp", "id").withColumn("seq", F.monotonically_increasing_id() + 1)), "numbered")


def completed(entries: DataFrame) -> DataFrame:
    """``entries`` with trace ids and URL parameters."""
    request = F.col("request")
    http = F.when(request["http"].isNotNull(), request["http"].withField("query", fn.query_map(request["path"])))
    full = entries.withColumn("traceId", fn.trace_id(F.coalesce(request["headers"], F.create_map().cast("map<string,string>")))).withColumn("request", request.withField("http", http))
    return conform(full)


def openings(packets: DataFrame) -> DataFrame:
    """``packets`` with ``opening``: how many connections had begun on the same ports by then. A SYN
    begins one unless it repeats the number of the SYN before."""
    order = Window.partitionBy("conn").orderBy("ts_us", "seq")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    syn = F.col("flags").bitwiseAND(18) == 2
    last = F.last(F.when(syn, F.col("seq")), ignorenulls=True).over(before)
    new = F.when(syn & ~last.eqNullSafe(F.col("seq")), 1).otherwise(0)
    return packets.withColumn("__new", new).withColumn("opening", F.sum("__new").over(so_far)).drop("__new")


def stream_entries(packets: DataFrame, redact: bool = True) -> DataFrame:
    """Entries of TCP connections. The client is the side that opened it, else the higher port. Requests
    without a response give no entry. A message has the time of the packet that its first byte came in.
    ``redact``: see ``redacted``."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        opened = rows[(rows["flags"] & 18) == 2]
        first = opened.iloc[0] if len(opened) else rows.iloc[rows["sport"].to_numpy().argmax()]
        mine = (rows["src"] == first["src"]) & (rows["sport"] == first["sport"])
        sides = []
        for side in (mine, ~mine):
            part = rows[side]
            sides.append(stream(list(zip(part["seq"].tolist(), part["ts_us"].tolist(), part["payload"].tolist(), strict=True))))
        (client, asked, _), (server, answered, _) = sides
        kind = sniff.protocol(int(first["sport"]), int(first["dport"]), client)
        pairs = exchanges(kind, client, server)
        out = []
        for k, (request, response) in enumerate(pairs):
            if response is None:
                continue
            start = _time((asked, answered)[request.pop("from", 0)], request.pop("at"))
            stop = _time(answered, response.pop("at")) if "at" in response else start
            spoken = request.pop("protocol", kind)
            status, code = response.pop("status", "success"), response.get("statusCode", 0)
            out.append(
                json.dumps(
                    {
                        "id": f"{key[0]}#{key[1]}.{k}", "protocol": spoken, "timestamp": pd.Timestamp(start, unit="us", tz="UTC").isoformat(), "elapsedMs": max(stop - start, 0) // 1000, "status": status, "statusCode": code,
                        "src": {"ip": first["src"], "port": int(first["sport"])}, "dst": {"ip": first["dst"], "port": int(first["dport"])}, "request": request, "response": response,
                    }
                )
            )
        return pd.DataFrame({"value": out}, dtype=str)

    keyed = packets.filter("proto = 'tcp'").withColumn("conn", connection(F.col("src"), F.col("sport"), F.col("dst"), F.col("dport")))
    columns = ["conn", "ts_us", "src", "dst", "sport", "dport", "flags", "seq", "payload"]
    entries = completed(from_json_lines(openings(keyed.select(*columns)).groupBy("conn", "opening").applyInPandas(run, "value string")))
    return redacted(entries) if redact else entries


def dissect_streams(packets: DataFrame, redact: bool = True) -> DataFrame:
    """The exchanges of TCP connections, numbered."""
    return _numbered(stream_entries(packets, redact))


def dns_messages(packets: DataFrame) -> DataFrame:
    """Decoded DNS datagrams: client, port, number, time, and the message as JSON."""

    def run(frames):
        for frame in frames:
            parsed = [dns.parse(p) if p else None for p in frame["payload"]]
            keep = [i for i, m in enumerate(parsed) if m]
            out = frame.iloc[keep][["ts_us", "src", "dst", "sport", "dport"]].copy()
            out["id"] = [parsed[i]["id"] for i in keep]
            out["is_request"] = [not parsed[i]["response"] for i in keep]
            out["message"] = [json.dumps(parsed[i]) for i in keep]
            yield out

    rows = packets.filter("proto = 'udp' and (sport = 53 or dport = 53)").select("ts_us", "src", "dst", "sport", "dport", "payload")
    out = rows.mapInPandas(run, "ts_us bigint, src string, dst string, sport int, dport int, id int, is_request boolean, message string")
    asks = F.col("is_request")
    return out.select(F.when(asks, F.col("dst")).otherwise(F.col("src")).alias("server"), F.when(asks, F.col("src")).otherwise(F.col("dst")).alias("client"), F.when(asks, F.col("sport")).otherwise(F.col("dport")).alias("port"), "id", F.timestamp_micros("ts_us").alias("ts"), F.col("ts_us").alias("seq"), "is_request", "message")


def dns_entries(packets: DataFrame, expire_seconds: int = 30) -> DataFrame:
    """Entries of DNS over UDP, numbered."""
    return _numbered(_answered(packets, expire_seconds))


def _answered(packets: DataFrame, expire_seconds: int = 30) -> DataFrame:
    """Entries of DNS over UDP: the first response after a client's latest query of its number, within
    the time. Queries without one give no entry."""
    keys = ["client", "port", "server", "id"]
    order = Window.partitionBy(*keys).orderBy("ts", F.desc("is_request")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = dns_messages(packets).withColumn("turn", F.sum(F.col("is_request").cast("int")).over(order)).filter("turn > 0")
    said = F.struct("ts", "message")
    pairs = turns.groupBy(*keys, "turn").agg(F.max(F.when(F.col("is_request"), said)).alias("q"), F.min(F.when(~F.col("is_request"), said)).alias("r")).filter("r is not null")
    elapsed = F.floor((F.unix_micros("r.ts") - F.unix_micros("q.ts")) / 1000)
    record = f"struct<question: string, answer: string, status: string, {field_type('request.dns').simpleString()[7:-1]}>"
    pairs = pairs.filter(elapsed <= expire_seconds * 1000).withColumn("ask", F.from_json("q.message", record)).withColumn("got", F.from_json("r.message", record))
    members = lambda side, names: F.struct(*[F.col(f"{side}.{n}") for n in names]).alias("dns")
    entries = pairs.select(
        F.concat_ws("-", F.lit("dns"), "client", "port", "server", F.col("id"), F.unix_micros("q.ts")).alias("id"), F.lit("dns").alias("protocol"), F.col("q.ts").alias("timestamp"), elapsed.alias("elapsedMs"), "got.status",
        F.struct(F.col("client").alias("ip"), "port").alias("src"), F.struct(F.col("server").alias("ip"), F.lit(53).alias("port")).alias("dst"),
        F.struct(F.concat_ws(" ", F.get("ask.questions", 0)["type"], "ask.question").alias("summary"), "ask.question", members("ask", ("id", "questions"))).alias("request"),
        F.struct(F.when(F.col("got.answer") != "", F.col("got.answer")).otherwise(F.col("got.rcode")).alias("summary"), "got.answer", members("got", ("id", "answers", "authority", "additional", "rcode", "authoritative", "recursionAvailable"))).alias("response"),
    )
    return conform(entries)


def _flows(packets: DataFrame, idle_seconds: int) -> DataFrame:
    """(conn, session, started, e): each TCP connection and each flow of UDP other than DNS, as an entry."""
    rows = packets.filter("proto = 'tcp' or (proto = 'udp' and sport <> 53 and dport <> 53)")
    key = F.concat_ws(" ", "proto", connection(F.col("src"), F.col("sport"), F.col("dst"), F.col("dport")))
    found = flows.sessions(rows.withColumn("conn", key), idle_seconds)
    part = lambda k: F.regexp_extract("conn", r"^(\w+) (.*):(\d+)\|(.*):(\d+)$", k)
    ends = [F.struct(part(k).alias("ip"), part(k + 1).cast("int").alias("port")) for k in (2, 4)]
    first = ends[0]["port"] >= ends[1]["port"]
    either = F.concat_ws(",", "client_flags", "server_flags")
    reset, closed = either.contains("RST"), either.contains("FIN")
    millis = F.floor((F.unix_micros("ended") - F.unix_micros("started")) / 1000)
    made = found.withColumn("src", F.when(first, ends[0]).otherwise(ends[1])).withColumn("dst", F.when(first, ends[1]).otherwise(ends[0]))
    e = F.struct(
        F.concat(F.lit("flow "), "conn", F.lit("#"), F.col("session")).alias("id"), part(1).alias("protocol"), F.col("started").alias("timestamp"), millis.alias("elapsedMs"), "src", "dst", F.when(reset, "error").otherwise("success").alias("status"),
        F.struct(fn.port_label(part(1), F.col("dst.port")).alias("summary"), "packets", "bytes", F.concat_ws("/", F.nullif("client_flags", F.lit("")), F.nullif("server_flags", F.lit(""))).alias("flags")).alias("request"),
        F.struct(F.concat(F.when(reset | closed, "closed").otherwise("idle"), F.lit(" · "), fn.human_bytes(F.col("bytes")), F.lit(" · "), F.col("packets"), F.lit(" pkts")).alias("summary")).alias("response"),
        F.struct(F.col("client_flags").alias("clientTcpFlags"), F.col("server_flags").alias("serverTcpFlags"), "window", "mss", F.col("rtt_ms").alias("rttMs"), millis.alias("durationMs"), F.col("client_bytes").alias("clientBytes"), F.col("server_bytes").alias("serverBytes"), F.col("client_packets").alias("clientPackets"), F.col("server_packets").alias("serverPackets"), F.col("seq_start").alias("seqStart"), F.col("ack_start").alias("ackStart"), "ttl", F.col("ip_version").alias("ipVersion"), F.nullif("ip_flags", F.lit("")).alias("ipFlags"), F.nullif("src_mac", F.lit("")).alias("srcMac"), F.nullif("dst_mac", F.lit("")).alias("dstMac")).alias("l4"),
    )
    return made.select("conn", "session", "started", e.alias("e"))


def flow_entries(packets: DataFrame, idle_seconds: int = 20) -> DataFrame:
    """An entry per TCP connection and per flow of UDP other than DNS; resets are errors."""
    return _numbered(_flows(packets, idle_seconds).select("e.*"))


def capture_entries(packets: DataFrame, redact: bool = True, idle_seconds: int = 20) -> DataFrame:
    """All that a capture shows, numbered in order of time: exchanges of TCP connections with the figures of
    the connection they ran in, DNS over UDP, ICMP, and the flows in which no exchange was found. Packets
    are decoded once, and written for the readers that follow."""
    packets = materialise(packets, "packets")
    found = _flows(packets, idle_seconds)
    said = stream_entries(packets, redact)
    said = said.withColumn("conn", F.concat(F.lit("tcp "), connection(F.col("src.ip"), F.col("src.port"), F.col("dst.ip"), F.col("dst.port")))).withColumn("ts", F.col("timestamp"))
    told = attach_latest(said, found.select("conn", F.col("started").alias("ts"), F.struct("session", "e.l4").alias("state")))
    told = told.withColumn("session", F.col("state.session")).withColumn("l4", F.col("state.l4"))
    parts = told.select("conn", "session", F.struct(*fitted(told)).alias("e"), F.lit(True).alias("said"))
    rest = found.select("conn", "session", "e.*")
    parts = parts.unionByName(rest.select("conn", "session", F.struct(*fitted(rest)).alias("e"), F.lit(False).alias("said")))
    any_said = F.max("said").over(Window.partitionBy("conn", "session"))
    kept = parts.withColumn("any", any_said).filter("said or not any").select("e.*")
    return _numbered(kept.unionByName(_answered(packets)).unionByName(pcap.icmp_entries(packets)))
