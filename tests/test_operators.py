"""Operators on small tables with listed results, and on random ones against plain versions."""

import math
import random
from collections import defaultdict, deque
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wirelake.functions import text as fn
from wirelake.operators import compare, facets, flows, history, pairing, stats
from wirelake.operators.summary import graph, label, summary, timeline
from wirelake.schema import conform
from wirelake.sources.adapters import worker_frames

BASE = datetime(2024, 1, 1, 14, tzinfo=UTC)


def rows_of(spark, rows):
    """(src, dst, protocol, status, elapsed, seconds after BASE) with 'ns/name' or an address."""

    def end(e):
        ns, slash, name = e.partition("/")
        return (None, name, ns) if slash else (e, None, None) if e[:1].isdigit() else (None, e, None)

    made = [(f"e{i}", end(a), end(b), p, s, ms, BASE + timedelta(seconds=at), i + 1) for i, (a, b, p, s, ms, at) in enumerate(rows)]
    side = "struct<ip: string, workload: string, namespace: string>"
    return conform(spark.createDataFrame(made, f"id string, src {side}, dst {side}, protocol string, status string, elapsedMs bigint, timestamp timestamp, seq bigint"))


def test_summary_by_workload(spark):
    df = rows_of(spark, [("shop/web", "shop/payment", "http", "success", 10, 0), ("shop/web", "shop/payment", "http", "error", 200, 1), ("shop/payment", "10.0.0.3", "redis", "success", 5, 2)])
    got = [(r.key, r["count"], r.errors, list(r.protocols)) for r in summary(df).collect()]
    assert got == [("shop/payment", 3, 1, ["http", "redis"]), ("shop/web", 2, 1, ["http"]), ("10.0.0.3", 1, 0, ["redis"])]
    loop = rows_of(spark, [("shop/a", "shop/a", "http", "success", 1, 0)])
    assert [(r.key, r["count"]) for r in summary(loop, "namespace").collect()] == [("shop", 1)]
    with pytest.raises(ValueError):
        summary(df, "WORKLOAD")


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100, 101])
def test_nearest_rank(spark, n):
    df = rows_of(spark, [("a", "b", "http", "success", ms, 0) for ms in random.Random(n).sample(range(1, n + 1), n)])
    r = graph(df).first()
    assert (r.p50, r.p95, r.max) == (math.ceil(n * 0.5), math.ceil(n * 0.95), n)


def test_timeline(spark):
    df = rows_of(spark, [("a", "b", "http", "success", 1, 10), ("a", "b", "http", "error", 1, 20), ("a", "b", "http", "success", 1, 70), ("a", "b", "http", "success", 1, -60), ("a", "b", "http", "success", 1, 600)])
    got = [(r.entries, r.errors) for r in timeline(df, BASE, BASE + timedelta(minutes=2), 60).collect()]
    assert got == [(2, 1), (1, 0), (0, 0)]
    assert timeline(df, BASE, BASE + timedelta(days=1), 1).count() == 1000
    assert timeline(df, BASE, BASE, 60).count() == 1
    odd = timeline(df, datetime(2024, 1, 1, 9, 55, 3, tzinfo=UTC), BASE, 7).first().start
    assert (odd.replace(tzinfo=UTC) - datetime(1, 1, 1, tzinfo=UTC)).total_seconds() % 7 == 0


def test_graph_and_labels(spark):
    df = rows_of(spark, [("shop/web", "shop/payment", "http", s, 5, 0) for s in ("success", "error", "warning")] + [("shop/payment", "shop/web", "http", "success", 1, 0), ("web", "10.0.0.9", "tcp", "success", 1, 0), ("10.0.0.8", "10.0.0.9", "tcp", "success", 1, 0), ("", "x", "tcp", "success", 1, 0)])
    edges = [(r.src, r.dst, r["count"], r.errors, r.warnings) for r in graph(df).collect()]
    assert edges[0] == ("shop/web", "shop/payment", 3, 1, 1) and len(edges) == 4
    assert graph(df, focus="payment").count() == 2 == graph(df, focus="shop/payment").count() and graph(df, focus="nobody").count() == 0
    assert df.select(label("src")).count() == 7


def test_cursors(spark):
    df = rows_of(spark, [("a", "b", "http", "success", i, i) for i in range(5)])
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(history.before_seq(df, 3)) == ["e1", "e0"] and len(ids(history.before_seq(df, 1000))) == 5
    assert ids(history.before_seq(df, 1)) == [] == ids(history.before_seq(df, 0)) and ids(history.before_seq(df, 5, 1)) == ["e3"]
    assert ids(history.before_id(df, "e2")) == ["e1", "e0"] and ids(history.before_id(df, "gone")) == []
    assert ids(history.replay(df, limit=3)) == ["e2", "e3", "e4"] and ids(history.by_id(df, "e4")) == ["e4"]
    assert ids(history.top_k(df, "elapsedMs", "asc", 2)) == ["e0", "e1"] and ids(history.top_k(df, "l4.ttl")) == []
    with pytest.raises(ValueError):
        history.top_k(df, "elapsedms")


def test_retention_matches_a_queue(spark):
    rng = random.Random(0)
    sizes = [rng.randint(1, 90) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sizes, 1)), "seq bigint, size bigint")
    for capacity, budget in ((5, 200), (50, 400), (100, 20), (3, 100_000)):
        held: deque = deque()
        for seq, size in enumerate(sizes, 1):
            if size > budget:
                continue
            held.append((seq, size))
            while len(held) > capacity or sum(s for _, s in held) > budget:
                held.popleft()
        got = sorted(r.seq for r in history.retained(df, capacity, budget, F.col("size")).collect())
        assert got == [s for s, _ in held]


def test_times():
    now = datetime(2024, 1, 2, tzinfo=UTC)
    assert history.parse_time("15m", now) == now - timedelta(minutes=15) and history.parse_time("1h30m", now) == now - timedelta(minutes=90)
    assert history.parse_time("1704067200", now) == datetime(2024, 1, 1, tzinfo=UTC) == history.parse_time("2024-01-01T00:00:00Z", now)
    for bad in ("", "-5m", "x", "5 m", "0s"):
        with pytest.raises(ValueError):
            history.parse_time(bad, now)
    assert [history.clamp(v, 50, 200) for v in ("7", "999", "0", "-1", "x", None)] == [7, 200, 50, 50, 50, 50]


def test_windows(spark):
    now = BASE + timedelta(minutes=10)
    df = rows_of(spark, [("a", "b", "http", s, 1, 600 - age) for age, s in ((600, "error"), (180, "error"), (30, "success"), (5, "error"))])
    got = {r.seconds: (r.entries, r.errors) for r in stats.trailing_windows(df, now).collect()}
    assert got == {5: (0, 0), 60: (2, 1), 300: (3, 2)}
    future = rows_of(spark, [("a", "b", "http", "success", 1, 9999)])
    assert [r.entries for r in stats.trailing_windows(future, now).collect()] == [1, 1, 1]
    totals = stats.totals(rows_of(spark, [("a", "b", "http", "", 1, 0), ("a", "b", "dns", "error", 1, 0)]))
    assert {(r.kind, r.name): r["count"] for r in totals.collect()} == {("total", ""): 2, ("protocol", "http"): 1, ("protocol", "dns"): 1, ("status", "error"): 1}
    left = stats.since_clear(totals, spark.createDataFrame([("total", "", 5), ("protocol", "dns", 1)], "kind string, name string, count bigint"))
    assert {(r.kind, r.name): r["count"] for r in left.collect()} == {("total", ""): 0, ("protocol", "http"): 1, ("status", "error"): 1}


def test_diff(spark):
    def window(src, n, errors, ms, at):
        return [(src, "", "http", "error" if i < errors else "success", ms, at) for i in range(n)]

    rows = window("legacy", 50, 0, 1, 10) + window("new-service", 30, 5, 1, 1010) + window("web", 100, 1, 50, 10) + window("web", 100, 20, 400, 1010)
    df = rows_of(spark, rows)
    w = lambda a, b: (BASE + timedelta(seconds=a), BASE + timedelta(seconds=b))
    got = {r.key: r for r in compare.diff(df, w(0, 100), w(1000, 1100)).collect()}
    assert (got["web"].errors_delta, got["web"].p95_delta, round(got["web"].rate_delta, 4), got["web"].status) == (19, 350, 0.19, "changed")
    assert (got["legacy"].count_delta, got["legacy"].status, got["new-service"].count_delta, got["new-service"].status) == (-50, "disappeared", 30, "appeared")
    assert list(got)[0] == "web"


def test_clusters(spark):
    df = rows_of(spark, [("a", "b", "http", "error", 1, i) for i in range(5)] + [("a", "b", "http", "success", 1, 9)])
    df = df.withColumn("response", F.struct(F.concat(F.lit("user "), F.col("seq") * 13, F.lit(" not found")).alias("summary")))
    r = compare.error_clusters(conform(df)).collect()
    assert len(r) == 1 and (r[0]["count"], r[0].summary, r[0].ids) == (5, "user # not found", ["e4", "e3", "e2"])


def test_facets(spark):
    df = rows_of(spark, [("shop/a", "b", "http", "success", 1, 0), ("shop/a", "b", "dns", "error", 1, 0), ("shop/c", "b", "http", "success", 1, 0)])
    assert [(r.value, r["count"]) for r in facets.field_values(df, "protocol", limit=3).collect()] == [("http", 2), ("dns", 1), ("amqp", 0)]
    assert [(r.value, r["count"]) for r in facets.field_values(df, "src.workload", "A").collect()] == [("a", 2)]
    assert facets.list_fields(spark).count() == 81


def test_fifo_matches_a_queue(spark):
    rng = random.Random(3)
    events = [(f"c{rng.randint(0, 20)}", BASE + timedelta(milliseconds=i * 7), i, rng.random() < 0.5) for i in range(1500)]
    want, queues = set(), defaultdict(deque)
    for conn, ts, i, ask in events:
        q = queues[conn]
        if ask:
            q.append((i, ts, len(q)))
        elif q:
            j, at, depth = q.popleft()
            want.add((conn, j, i, int((ts - at).total_seconds() * 1000 + 0.5), depth))
    df = spark.createDataFrame(events, "conn string, ts timestamp, seq bigint, is_request boolean")
    got = {(r.conn, r.request_seq, r.response_seq, r.elapsed_ms, r.depth) for r in pairing.fifo_pairs(df).collect()}
    assert got == want


def test_keyed_pairs(spark):
    t = lambda s: BASE + timedelta(seconds=s)
    rows = [("c", 1, t(0), 0, True), ("c", 1, t(1), 1, True), ("c", 1, t(2), 2, False), ("c", 1, t(3), 3, False), ("c", 2, t(0), 4, True), ("c", 2, t(40), 5, False), ("c", 3, t(1), 6, False)]
    df = spark.createDataFrame(rows, "conn string, number int, ts timestamp, seq bigint, is_request boolean")
    assert [(r.number, r.request_seq, r.response_seq, r.elapsed_ms) for r in pairing.keyed_pairs(df, ["conn", "number"]).collect()] == [(1, 1, 2, 1000)]


def test_sessions(spark):
    t = lambda ms: BASE + timedelta(milliseconds=ms)
    p = [("c", t(0), "a", 5000, "b", 80, 0, 2, 1, 1460, 100), ("c", t(3), "b", 80, "a", 5000, 0, 18, 9, None, 200), ("c", t(5), "a", 5000, "b", 80, 10, 24, 2, None, 100), ("c", t(9), "b", 80, "a", 5000, 30, 17, 10, None, 200), ("c", t(11), "a", 5000, "b", 80, 0, 16, 12, None, 100), ("c", t(30000), "a", 5000, "b", 80, 7, 16, 50, None, 90)]
    df = spark.createDataFrame(p, "conn string, ts timestamp, src string, sport int, dst string, dport int, length bigint, flags int, seq bigint, mss int, window int")
    a, b = flows.sessions(df).orderBy("session").collect()
    assert (a.packets, a.client_bytes, a.server_bytes, a.client_flags, a.server_flags, a.mss, a.rtt_ms, b.packets) == (4, 10, 30, "SYN,ACK,PSH", "SYN,ACK,FIN", 1460, 3.0, 1)
    assert (a.seq_start, a.ack_start, b.seq_start) == (1, 9, None) and "ttl" not in a
    linked = flows.sessions(df.withColumns({"ttl": F.lit(64) + F.col("sport") % 2, "src_mac": F.when(F.col("sport") == 80, "m")})).orderBy("session").first()
    assert (linked.ttl, linked.src_mac) == (64, "m")
    twice = df.unionByName(df.filter("length = 10").withColumn("ts", F.lit(t(7))))
    assert flows.without_repeats(twice).count() == df.count()


def test_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    assert [val(fn.human_bytes(F.lit(n))) for n in (0, 1023, 1536, 3 << 20)] == ["0 B", "1023 B", "1.5 KB", "3.0 MB"]
    assert val(fn.port_label(F.lit("tcp"), F.lit(443))) == "tcp https" and val(fn.port_label(F.lit("udp"), F.lit(1234))) == "udp/1234"
    assert val(fn.truncated(F.lit("aé日b"), 4)) == "aé…" and val(fn.truncated(F.lit("abc"), 4)) == "abc"
    assert val(fn.query_map(F.lit("/x?a=1&token=zz&a=2&b=%20c#f"))) == {"a": "1, 2", "token": "[REDACTED]", "b": " c"} and val(fn.query_map(F.lit("/x?a=%zz"))) == {}
    assert val(fn.redacted_headers(m({"Cookie": "x", "accept": "y"}))) == {"Cookie": "[REDACTED]", "accept": "y"}
    args = lambda *a: F.array(*map(F.lit, a))
    assert val(fn.redacted_command(F.lit("auth"), args("u", "p"))) == ["[REDACTED]"] * 2
    assert val(fn.redacted_command(F.lit("HELLO"), args("3", "AUTH", "u", "p"))) == ["3", "AUTH", "[REDACTED]", "[REDACTED]"]
    assert val(fn.redacted_command(F.lit("CONFIG"), args("SET", "requirepass", "p"))) == ["SET", "requirepass", "[REDACTED]"] and val(fn.redacted_command(F.lit("GET"), args("k"))) == ["k"]
    trace = "4bf92f3577b34da6a3ce929d0e0e4736"
    assert val(fn.trace_id(m({"traceparent": f"00-{trace}-00f067aa0ba902b7-01"}))) == trace and val(fn.trace_id(m({"x-request-id": "r"}))) == "r" and val(fn.trace_id(m({"a": "b"}))) == ""
    data = bytes(range(40))
    dump = val(fn.hex_dump(F.lit(bytearray(data))))
    assert dump.split("\n")[0] == "00000000  00 01 02 03 04 05 06 07  08 09 0a 0b 0c 0d 0e 0f  |................|" and bytes(val(fn.hex_undump(F.lit(dump)))) == data
    assert val(fn.csv_field(F.lit('a,"b"'))) == '"a,""b"""'
    assert val(fn.curl(F.lit("POST"), F.lit("http://h/p"), m({"host": "h", "x-a": "it's"}), F.lit("b"))) == "curl -X POST 'http://h/p' -H 'x-a: it'\\''s' --data-raw 'b'"


def test_retransmits(spark):
    t = lambda i: BASE + timedelta(milliseconds=i)
    walk = [(100, 10), (110, 10), (110, 10), (105, 3), (140, 5), (120, 10), (130, 10), (140, 5), (90, 0)]
    rows = [("c", t(i), "a", 1, s, n) for i, (s, n) in enumerate(walk)] + [("c", t(0), "b", 2, 5, 5), ("d", t(0), "a", 1, 7, 1)]
    df = spark.createDataFrame(rows, "conn string, ts timestamp, src string, sport int, seq bigint, length bigint")
    want = None
    count = 0
    for s, n in walk:
        if n and (want is None or s >= want):
            want = s + n
        elif n and s < want:
            count += 1
    assert {(r.conn, r.src): r.retransmits for r in flows.retransmits(df).collect()} == {("c", "a"): count, ("c", "b"): 0, ("d", "a"): 0}


def test_api(spark):
    from wirelake.api import Traffic, capped

    df = rows_of(spark, [("shop/a", "shop/b", "http", "error" if i % 4 == 0 else "success", i, i) for i in range(40)])
    t = Traffic(df, now=BASE + timedelta(seconds=40))
    assert t.entries(limit="3").count() == 3 and t.entries(before_seq=0).count() == 0 and t.entries(before="").count() == 0 and t.entries(since="10s").count() == 10
    assert t.entries(sort="elapsedMs", limit=1).first().elapsedMs == 39 and t.entry("e7").first().seq == 8
    assert t.summary(filter="status == error").first()["count"] == 10 and t.graph().count() == 1 and t.timeline(bucket="10", since="40s").count() == 5
    assert t.field_values("status").count() == 3 and t.fields().count() == 81 and t.list_namespaces().first().key == "shop" and t.metrics().count() == 4
    assert t.diff(("40s", "21s"), ("20s", "0.001s")).count() == 2 and t.error_clusters().count() == 1
    page = t.entries(limit=3)
    assert t.next_cursor(page, 3) == 38 and t.next_cursor(t.entries(before_seq=3, limit=3), 3) is None
    assert [r.seq for r in t.entries_table("latency", "desc", limit=2).collect()] == [40, 39] and [r.seq for r in t.entries_table("bytes", "asc", limit=2).collect()] == [40, 39]
    assert [r.key for r in t.top(sort="errRate").collect()] == ["shop/a", "shop/b"]
    with pytest.raises(ValueError):
        t.entries_table("colour")
    with pytest.raises(ValueError):
        t.top(sort="colour").count()
    assert capped("é" * 10, 5).startswith("éé\n") and capped("abc") == "abc"


def test_exporting(spark, tmp_path):
    from wirelake.operators import exporting

    df = rows_of(spark, [("shop/a", "10.0.0.1", "http", "success", 1, 0)])
    assert len(exporting.csv_rows(df).columns) == 14
    exporting.csv_rows(df).coalesce(1).write.csv(str(tmp_path / "c"), header=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().destination == "10.0.0.1"
    packets = spark.createDataFrame([("tcp", 1, 80), ("tcp", 1, 81), ("udp", 53, 9), ("udp", 80, 9), ("icmp", None, None)], "proto string, sport int, dport int")
    assert exporting.followed_packets(packets).count() == 3 and exporting.followed_packets(packets, more=[81]).count() == 4


def test_clauses():
    from wirelake.plans import clauses, ifl

    for source in (clauses.endpoint("src", workload="web", namespace="shop"), clauses.conversation({"name": "a b"}, {"ip": "10.0.0.1"}), clauses.group("workload", "shop/web"), clauses.group("workload", "and"), clauses.group("response.status", "500")):
        assert ifl.parse(source) is not None
    assert clauses.expects("")[0] == "field" and clauses.expects("http.me") == ("field", ["http.method"]) and clauses.expects("http.method ")[0] == "operator"
    assert clauses.expects("http.method == ")[0] == "value" and clauses.expects("http.method == GET ") == ("boolean", ["and", "or"])


@pytest.mark.parametrize(
    "source, want",
    [
        ("|", ("field", "", False, None)),
        ("pro|to", ("field", "pro", False, None)),
        ("proto |", ("operator", "", False, "proto")),
        ("proto =|", ("operator", "=", False, "proto")),
        ("proto ==|", ("operator", "==", False, "proto")),
        ("proto == |", ("value", "", False, "proto")),
        ("proto == 'a\\'b|c' and x", ("value", "a'b", True, "proto")),
        ("proto == 'abc'|", ("value", "abc", False, "proto")),
        ('proto contains "open|', ("value", "open", True, "proto")),
        ('proto contains "half\\|', ("value", "half", True, "proto")),
        ("proto == http |", ("boolean", "", False, None)),
        ("proto == http an|", ("boolean", "an", False, None)),
        ("proto == http and not (st|atus", ("field", "st", False, None)),
        ("(proto == http) |", ("boolean", "", False, None)),
        ("status in (4|", ("field", "4", False, None)),
        ("503 |", ("boolean", "", False, None)),
        ("'two words' |", ("boolean", "", False, None)),
        ("a == b or c |== d", ("operator", "", False, "c")),
    ],
)
def test_caret(source, want):
    from wirelake.plans import clauses

    at = clauses.context_at(source.replace("|", ""), source.index("|"))
    assert (at.expects, at.prefix, at.quoted, at.field) == want


def test_entry_text(spark):
    import json

    from wirelake.api import Traffic

    df = rows_of(spark, [("shop/web", "10.0.0.1", "http", "success", 5, 0)])
    entry = df.first()
    (text,) = Traffic(df).entry_text(entry.id).collect()
    assert json.loads(text.text)["src"]["workload"] == "web" and "\n  " in text.text
    assert Traffic(df).entry_text("nobody").count() == 0


def test_line_diff(spark):
    rng = random.Random(4)
    texts = [("\n".join(rng.choices("abc", k=rng.randint(0, 12))), "\n".join(rng.choices("abc", k=rng.randint(0, 12)))) for _ in range(60)]
    rows = texts + [("a\nb\nc", "a\nx\nc"), (None, "q"), ("x\n" * 500, "y")]
    got = compare.line_diff(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, before string, after string")).orderBy("i").collect()
    assert [(c.op, c.line) for c in got[60].changes] == [("same", "a"), ("del", "b"), ("add", "x"), ("same", "c")]
    assert [(c.op, c.line) for c in got[61].changes] == [("del", ""), ("add", "q")] and got[62].changes is None
    for (old, new), r in zip(texts, got, strict=False):
        assert [c.line for c in r.changes if c.op != "add"] == old.split("\n") and [c.line for c in r.changes if c.op != "del"] == new.split("\n")
        a, b = old.split("\n"), new.split("\n")
        best = [0] * (len(b) + 1)
        for x in a:
            before = list(best)
            for j, y in enumerate(b):
                best[j + 1] = before[j] + 1 if x == y else max(before[j + 1], best[j])
        assert sum(c.op == "same" for c in r.changes) == best[-1]


def plain_queues(rows, expire, backlog):
    """(conn, request, response, elapsed, waiting before) of queues that are walked message by message."""
    out, queues = [], defaultdict(deque)
    for conn, us, seq, is_request in sorted(rows, key=lambda r: (r[1], r[2])):
        waiting = queues[conn]
        while waiting and expire is not None and us - waiting[0][0] > expire * 10**6:
            waiting.popleft()
        if is_request:
            waiting.append((us, seq, len(waiting)))
            if backlog is not None and len(waiting) > backlog:
                waiting.popleft()
        elif waiting:
            at, request, depth = waiting.popleft()
            out.append((conn, request, seq, (us - at) // 1000, depth))
    return sorted(out)


@pytest.mark.parametrize("expire, backlog, share, span", [(30, 1024, 0.6, 500), (3, 4, 0.7, 60), (3, 4, 0.4, 300), (None, None, 0.55, 100), (None, 5, 0.7, 100), (1, 1, 0.5, 60)])
def test_queues_that_forget(spark, expire, backlog, share, span):
    rng = random.Random(span)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.randrange(0, span * 10**6, 250_000), i, rng.random() < share) for i in range(1500)]
    df = spark.createDataFrame(rows, "conn int, us long, seq long, is_request boolean").select("conn", F.timestamp_micros("us").alias("ts"), "seq", "is_request")
    assert sorted(tuple(r) for r in pairing.fifo_pairs(df, expire, backlog).collect()) == plain_queues(rows, expire, backlog)


def test_a_rush_on_one_connection_is_cut_into_slices(spark, monkeypatch):
    """However many messages come within the time that a request waits, what is sorted together is bounded."""
    rng, sizes, scan = random.Random(8), [], pairing._running_bounds

    def watched(rows, group, order):
        sizes.append(rows.groupBy(*group).count().agg(F.max("count")).first()[0])
        return scan(rows, group, order)

    monkeypatch.setattr(pairing, "SLICE_ROWS", 256, raising=False)
    monkeypatch.setattr(pairing, "_running_bounds", watched)
    rows = sorted((0, rng.randrange(0, 20_000_000, 500), i, rng.random() < 0.55) for i in range(6000))
    df = spark.createDataFrame(rows, "conn long, us long, seq long, is_request boolean").withColumn("ts", F.timestamp_micros("us"))
    assert sorted(tuple(r) for r in pairing.fifo_pairs(df, 4, 64).collect()) == plain_queues(rows, 4, 64)
    assert sizes[0] < 600


def test_an_expired_request_lets_the_next_one_pair(spark):
    df = spark.sql("SELECT 0 conn, timestamp_seconds(s) ts, s seq, q is_request FROM VALUES (0, true), (100, true), (101, false) t(s, q)")
    assert [tuple(r) for r in pairing.fifo_pairs(df).collect()] == [(0, 100, 101, 1000, 0)]


@pytest.mark.parametrize(
    "url, shown",
    [
        ("/pay?%74oken=s&b=1", "/pay?b=1&token=%5BREDACTED%5D"),
        ("/pay?Api%5FKey=s&to=%2Fx&who=a+b", "/pay?Api_Key=%5BREDACTED%5D&to=%2Fx&who=a+b"),
        ("/pay?token=s&z=1&token=t&a=~*", "/pay?a=~%2A&token=%5BREDACTED%5D&z=1"),
        ("/pay?token=s;c=1", "/pay?%5BREDACTED%5D"),
        ("/pay?sig=s&b=%zz", "/pay?%5BREDACTED%5D"),
        ("/pay?b=%4", "/pay?%5BREDACTED%5D"),
        ("/list?z=a+b&a=%2f", "/list?z=a+b&a=%2f"),
        ("/list?", "/list?"),
        ("/list", "/list"),
    ],
)
def test_secrets_in_urls(spark, url, shown):
    row = spark.range(1).select(fn.redacted_url(F.lit(url)).alias("u"), fn.query_map(F.lit(url)).alias("m")).head()
    assert row.u == shown
    assert (row.m == {}) == ("?%5B" in shown or "=" not in url) and "s" not in row.m.values()


def test_worker_frames(spark):
    """A connection is its latest greeting's node; broken and early frames give nothing; null entries don't count."""
    t = lambda s: BASE + timedelta(seconds=s)
    rows = [
        ("x", 0, '{"type": "entry", "entry": {"id": "early"}}'),
        ("x", 1, '{"type": "hello", "hello": {"node": "n1", "version": "2"}}'),
        ("x", 2, '{"type": "entryBatch", "entries": [{"id": "a"}, null, {"id": "b"}]}'),
        ("x", 3, '{"type": "workerStats", "workerStats": {"dropped": 3, "captureTls": true}}'),
        ("x", 4, '{"type": "workerStats"}'),
        ("x", 5, '{"type": "entry"'),
        ("y", 6, '{"type": "hello", "hello": {"node": "n2"}}'),
        ("y", 7, '{"type": "entry", "entry": null}'),
        ("y", 8, None),
        ("x", 9, '{"type": "filter", "filter": "a"}'),
        ("z", 10, '{"type": "hello", "hello": {"node": "gone", "version": "1"}}'),
        ("z", 11, None),
    ]
    frames = spark.createDataFrame([(c, t(s), s, v) for c, s, v in rows], "conn string, at timestamp, place int, value string")
    seen = {r.node: r for r in stats.registry(worker_frames(frames), t(3608), 3600).collect()}
    assert set(seen) == {"n1", "gone"}
    one = seen["n1"]
    assert (one.connected, one.version, one.entries, one.dropped, one.captureTls, one.ringDrops) == (True, "2", 2, 3, True, None)
    assert not seen["gone"].connected and seen["gone"].entries == 0
