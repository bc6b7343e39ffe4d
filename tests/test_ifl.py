"""The filter language against listed cases and a plain interpreter."""

import ipaddress
import json
import re
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirelake.plans import fields, ifl
from wirelake.schema import ENTRY, conform

# A weather service: a sensor's upload (w), a look-up in a database with a bit of everything (l), and nothing (n).
UPLOAD = {
    "id": "w1", "protocol": "http", "node": "rack-7", "timestamp": datetime(2023, 6, 5, tzinfo=UTC), "elapsedMs": 340, "status": "warning", "statusCode": 429, "seq": 1,
    "src": {"ip": "172.20.3.99", "port": 51000, "name": "sensor-12", "namespace": "field"},
    "dst": {"ip": "172.20.8.4", "port": 9443, "name": "collector", "namespace": "weather"},
    "request": {"method": "PUT", "path": "/readings/2023", "host": "collector.weather", "headers": {"x-firmware": "Aero/4.1"}},
    "response": {"summary": "429 Slow Down", "headers": {"retry-after": "15"}},
}
LOOKUP = {
    "id": "l1", "protocol": "postgres", "status": "error", "seq": 2, "src": {"namespace": "field"}, "dst": {"namespace": "archive", "ip": "fd12:7::25"},
    "request": {"size": 31, "http": {"version": "HTTP/1.0"}, "redis": {"dbIndex": 11, "pipelineDepth": 6}, "postgres": {"statementName": "station_by_id", "portal": "cursor4"}, "dns": {"questions": [{"name": "b", "type": "SRV", "class": "IN"}]}},
    "response": {"contentType": "text/csv", "size": 640, "rowCount": 53, "dns": {"rcode": "REFUSED", "answers": [{"name": "b", "type": "A", "ttl": 9, "data": "198.51.100.77"}], "authoritative": True}, "postgres": {"error": {"code": "57014", "severity": "ERROR"}}, "mysql": {"errorCode": 0}},
    "l4": {"ttl": 57, "retransmits": 5, "mss": 1220, "window": 29200, "rttMs": 0.25, "clientBytes": 4096, "ipVersion": 6, "ipFlags": "MF", "seqStart": 777, "durationMs": 61, "tls": {"sni": "archive.example.org"}},
}
NOTHING = {"id": "n1", "seq": 3}


def fit(value, kind):
    if value is None:
        return None
    if hasattr(kind, "fields"):
        return tuple(fit(value.get(f.name), f.dataType) for f in kind.fields)
    if hasattr(kind, "elementType"):
        return [fit(v, kind.elementType) for v in value]
    return value


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([fit(e, ENTRY) for e in (UPLOAD, LOOKUP, NOTHING)], ENTRY).cache()


CASES = [
    # bare words look through the haystack
    ("", "w l n"), ("collector", "w"), ("STATION_BY", "l"), ("hailstorm", ""), ("198.51.100", "l"), ('"archive.example"', "l"), ("not rack-7", "l n"),
    # comparisons fold case; what is absent is empty text
    ("status == WARNING", "w"), ('node != ""', "w"), ("src.name startswith Sensor", "w"), ("dns.type == srv", "l"), ("postgres.error in (57014, 40001)", "l"), ("ns contains ARCH", "l"),
    ("content-type contains csv", "l"), ("dns.authoritative == TRUE", "l"), ("dns.authoritative == false", ""), ("summary contains slow", "w"),
    # either end may hold a namespace
    ("namespace == archive", "l"), ("namespace in (weather, archive)", "w l"), ("ns != field", "n"), ("ns != harbour", "w l n"), ("ns == harbour", ""),
    # numbers: absent members of a plain row are zero, those of a missing object are nothing
    ("elapsedMs > 339", "w"), ("elapsedMs > 340", ""), ("latency <= 0", "l n"), ("packets < 1", "w l n"), ("l4.mss <= 1220", "l"), ("not l4.mss <= 1220", "w n"), ("l4.window == 0", ""),
    ("l4.rttms == 0.25", "l"), ("l4.rttms < 0.5", "l"), ("http.status == 429", "w"), ("http.status == 429.0", ""), ("status.code in (404, 429)", "w"), ("redis.db >= 11", "l"), ("redis.pipelinedepth != 6", "w n"),
    ("mysql.error == 0", ""), ("mysql.error < 1", ""), ("l4.ipversion >= 6", "l"), ("deliverytag >= 0", "w l n"), ("size > 600", "l"), ("request.host >= 1", ""), ("elapsed < inf", "w l n"), ("elapsed > nan", ""),
    # networks
    ("src.ip == 172.20.0.0/16", "w"), ("src.ip == 172.21.0.0/16", ""), ("dst.ip != 172.20.8.0/30", "w l n"), ("dst.ip != 172.20.8.4/30", "l n"), ("dst.ip == fd12::/16", "l"), ("dst.ip == 172.20/16", ""), ("path == 172.20.0.0/16", ""),
    # headers and patterns
    ("request.header.X-Firmware contains aero", "w"), ("response.header.retry-after in (15)", "w"), ('response.header.etag == ""', "w l n"),
    ('path matches "^/[a-z]+/[0-9]{4}$"', "w"), ('path matches "^/READ"', ""), ('path matches "(?i)^/READ"', "w"), ('postgres.statement matches "[$_]by"', "l"), ('path matches "\\\\Q/readings/\\\\E20"', "w"), ('node matches "[[:alpha:]]+-[]7]$"', "w"),
    # and binds closer than or; not closer than both
    ("protocol == http or status == error and node == none", "w"), ("(protocol == http or status == error) and node == none", ""), ("NOT NOT status == Error AND Dst.Port < 1", "l"), ("not (node == rack-7 or l4.ttl > 50)", "n"), ("protocol == and", ""),
]


def test_listed(entries):
    """Every case as a flag, and as a condition where it is one."""
    flags = [ifl.flag(source).alias(f"f{i}") for i, (source, _) in enumerate(CASES)]
    rows = entries.orderBy("seq").select("id", *flags).collect()
    for i, (source, want) in enumerate(CASES):
        assert " ".join(r.id[0] for r in rows if r[f"f{i}"]) == want, source
        assert all(r[f"f{i}"] is not None for r in rows), source
    for source, want in CASES[::6]:
        condition = ifl.where(source)
        got = entries if condition is None else entries.filter(condition)
        assert " ".join(r.id[0] for r in got.orderBy("seq").collect()) == want, source


@pytest.mark.parametrize("source", ["node ==", "(status == error", "node == \"open", "http.verb == PUT", "wether == rain", "elapsedms_total > 1", "(" * 4000, "not " * 4000 + "y", "y" * 4097, "rain snow", "node = x", "!rain", "size > large", "node in ()", "node in (a", "node in (a b)", f"node in ({','.join('z' * 65)})", 'path matches "("', 'path matches "x(?=y)"', 'path matches "(x)\\\\1"', f'path matches "{"z" * 257}"', "response.header. == 1", "not " * 65 + "y", "(" * 65 + "y" + ")" * 65])
def test_rejected(source):
    with pytest.raises(ifl.FilterError):
        ifl.parse(source)


@given(st.text(alphabet="ab ()<>=!\"',\\andornot.1/\n", max_size=40))
@settings(max_examples=400, deadline=None)
def test_only_filter_errors(source):
    try:
        ifl.parse(source)
    except ifl.FilterError:
        pass


def test_catalogue():
    names = fields.catalogue()
    assert len(names) == 81
    assert fields.find("HTTP.Status").name == "response.status" and fields.find("nope") is None and fields.find("request.header.") is None


def test_numbers_agree_with_text(entries):
    """Typed and textual reading of every number field give the same result for every operator."""
    rows = entries.orderBy("seq")
    for field in fields.catalogue().values():
        if not field.numeric:
            continue
        shown = [r.t for r in rows.select(field.text().alias("t")).collect()]
        checks, want = [], []
        for op in ("<", "<=", ">", ">="):
            for number in ("-1", "0", "1", "200", "500", "1e20"):
                checks.append(ifl.flag(f"{field.name} {op} {number}").alias(f"c{len(checks)}"))
                want.append([bool(t) and {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__}[op](float(t), float(number)) for t in shown])
        got = [list(r) for r in rows.select(*checks).collect()]
        assert [list(c) for c in zip(*got, strict=True)] == want, field.name


def test_pushdown(entries, tmp_path, spark):
    entries.write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    plan = df.filter(ifl.where("l4.ttl >= 48 and elapsedMs > 7")).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l4.ttl,48)" in plan and "GreaterThan(elapsedMs,7)" in plan


def test_json_round_trip(entries, spark):
    from wirelake.sources.adapters import from_json_lines

    lines = entries.select(F.to_json(F.struct("*")).alias("value"))
    assert sorted(map(str, from_json_lines(lines).collect())) == sorted(map(str, conform(entries).collect()))
    frames = [json.dumps({"type": "entryBatch", "entries": [{"id": "a"}, None, {"id": "b"}]}), json.dumps({"type": "entry", "entry": {"id": "c"}}), json.dumps({"type": "stats"}), "{broken", ""]
    got = from_json_lines(spark.createDataFrame([(f,) for f in frames], "value string"))
    assert sorted(r.id for r in got.collect()) == ["a", "b", "c"]


def test_networks(spark):
    values = ["10.1.2.3", "010.1.2.3", "::ffff:10.1.2.3", "10.1.2", "", "2001:db8::5", "300.1.1.1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for net in ("10.0.0.0/8", "0.0.0.0/0", "10.1.2.3/32", "2001:db8::/32", "::/0"):
        network = ifl.parse_network(net)

        def plain(v, network=network):
            try:
                a = ipaddress.ip_address(v)
            except ValueError:
                return False
            a = a.ipv4_mapped or a if a.version == 6 else a
            return a.version == network.version and a in network

        got = {r.v: r.x for r in df.select("v", ifl.in_network(F.col("v"), network).alias("x")).collect()}
        assert got == {v: plain(v) for v in values}, net
    assert all(ifl.parse_network(x) is None for x in ("10.0.0.0", "10.0.0.0/33", "10.0.0.0/08", "x/8", "01.0.0.0/8")) and re
