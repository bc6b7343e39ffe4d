"""Streams: jobs over ordered rows against plain versions, feeds, filters that change, late rows."""

import random
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wirelake.operators import flows
from wirelake.plans import ifl
from wirelake.queries import _many_filters
from wirelake.schema import conform
from wirelake.streaming import jobs, ordered
from wirelake.streaming.feed import Feed, Switchboard, delivered

BASE = datetime(2024, 1, 1, 14, tzinfo=UTC)


def test_sessions_in_order_are_those_of_windows(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for i in range(1200):
        at += rng.choice([1000, 50_000, 3_000_000])
        rows.append((rng.randint(0, 5), at, i, "10.0.0.1", rng.choice([6000, 80]), 443, rng.randint(0, 9), rng.choice([2, 18, 16, 24, 17, 4, 20]), rng.choice([None, 1460, 9000]), rng.randint(1, 99)))
    df = spark.createDataFrame(rows, "conn long, us long, seq long, src string, sport int, dport int, length long, flags int, mss long, window long").withColumn("ts", F.timestamp_micros("us"))
    batch = flows.sessions(df, 20).select("conn", F.unix_micros("started"), F.unix_micros("ended"), "packets", "bytes", "client_bytes", "server_bytes", "client_packets", "server_packets")
    got = []
    for conn in range(6):
        mine = [(r[1], r[2], *r[4:]) for r in rows if r[0] == conn]
        got += [(conn, *s[:8]) for s in ordered.of_keys(mine, ordered.Sessions(20))]
    assert sorted(got) == sorted(tuple(r) for r in batch.collect())


@pytest.mark.parametrize("seed", range(5))
def test_memory_survives_being_saved(seed):
    """A job gives the same whether or not its memory goes through JSON between rows."""
    rng = random.Random(seed)
    rows = sorted((rng.randrange(0, 60_000_000, 250_000), i, rng.random() < 0.6) for i in range(400))
    for job in (ordered.Queues(3, 4), ordered.Latest(3)):
        want, memory, got = ordered.of_keys(rows, job), None, []
        for us, seq, ask in rows:
            memory = None if memory is None else job.load(job.save(memory))
            memory = job.row(job.clock(memory, us - 1, got), {"us": us, "seq": seq, "is_request": ask}, got)
        assert got == want and want
        assert job.clock(memory, 1 << 61, []) is None


def test_wakes_when_the_clock_changes_something():
    """At the time a job asks to be woken it forgets, and not a microsecond before."""
    for job, r in ((ordered.Queues(3), {"is_request": True}), (ordered.Latest(3), {"is_request": True}), (ordered.Once(), {"length": 3}), (ordered.Sessions(3), {"sport": 2, "dport": 1, "length": 3, "flags": 16, "mss": 1, "window": 1})):
        memory = job.row(None, {"us": 1_000_000, "seq": 1, **r}, [])
        at = job.wakes(memory)
        memory = job.clock(memory, at - 1, [])
        assert memory is not None and job.clock(memory, at, []) is None


class Kept:
    """The state and timers of one key in memory, and which pieces were read."""

    def __init__(self):
        self.pieces, self.known, self.timers, self.read = {}, None, set(), []

    def handle(self):
        def read(k):
            self.read.append(k[0])
            return self.pieces[k]

        pieces = SimpleNamespace(getValue=read, updateValue=self.pieces.__setitem__, removeKey=self.pieces.pop)
        known = SimpleNamespace(exists=lambda: self.known is not None, get=lambda: self.known, update=lambda v: setattr(self, "known", v), clear=lambda: setattr(self, "known", None))
        return SimpleNamespace(getMapState=lambda *_: pieces, getValueState=lambda *_: known, listTimers=lambda: iter(self.timers), deleteTimer=self.timers.discard, registerTimer=self.timers.add)


def test_rows_wait_in_bounded_pieces(spark, monkeypatch):
    """Many rows of a key cost a few pieces of state, of which only those are read whose time has come."""
    monkeypatch.setattr(ordered, "PIECE", 100)
    rng = random.Random(6)
    rows = [(rng.randrange(0, 9_000_000, 1000), i, rng.random() < 0.6) for i in range(1000)]
    held, kept, got = StructType.fromDDL("us long, seq long, is_request boolean"), Kept(), []
    replay = ordered.Replay(ordered.Queues(3, 40), held, ["conn"])
    replay.init(kept.handle())
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    for part in (rows[:600], rows[600:]):
        got += replay.handleInputRows((7,), iter([pd.DataFrame(part[k : k + 150], columns=held.names) for k in range(0, len(part), 150)]), at(0))
    assert len(kept.pieces) == 10 and not kept.read and not got
    for ms in (1000, 5000, 9000, 99_000):
        kept.read.clear()
        got += replay.handleExpiredTimer((7,), at(ms), None)
        assert ms > 1000 or len(kept.read) < 5
    assert [tuple(r)[1:] for f in got for r in f.itertuples(index=False)] == ordered.of_keys(rows, ordered.Queues(3, 40))
    assert not kept.pieces and kept.known is None and not kept.timers


def test_packets_without_flags_or_mss_at_the_same_time(spark, tmp_path):
    """Rows that differ in a null alone have an order, and what is null stays so."""
    ordered.with_timers(spark)
    names = "conn long, ts timestamp, seq long, sport int, dport int, length long, flags int, mss long, window long"
    big = (1 << 53) + 1
    rows = [(1, BASE, 1, 9, 5, 4, None, None, 7), (1, BASE, 1, 9, 5, 4, None, 5, 7), (2, BASE, big, 5, 9, 3, None, None, None), (None, BASE + timedelta(days=9), *[None] * 7)]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/in")
    stream = ordered.sessions(spark.readStream.schema(names).parquet(f"{tmp_path}/in"), 60)
    write = lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("conn", "packets", "bytes", "client_bytes", "mss", "window").collect())
    assert got == [(1, 2, 8, 8, 5, 7), (2, 1, 3, 0, None, None)]


def some_entries(spark, n=60):
    rows = [(f"e{i}", i, BASE + timedelta(seconds=i), ("http", "dns")[i % 2], ("success", "error")[i % 3 == 0], i % 7 * 100, (f"10.0.1.{i % 9}", "", ("Shop", "")[i % 4 == 0])) for i in range(n)]
    return conform(spark.createDataFrame(rows, "id string, seq long, timestamp timestamp, protocol string, status string, elapsedMs long, src struct<ip: string, name: string, namespace: string>"))


def test_feed_is_each_filter_alone(spark):
    """Anchored by tables or not, shared or not, a subscriber gets what its filter alone lets through."""
    filters = {
        "all": "",
        "blank": "  ",
        "eq": "protocol == HTTP",
        "two": "protocol == http and status == error",
        "list": "src.ip in (10.0.1.1, 10.0.1.2, 10.0.1.1) and elapsedMs >= 200",
        "side": "namespace == shop and not status == error",
        "net": 'src.ip == "10.0.1.4/30"',
        "or": "protocol == dns or status == error",
        "not": "protocol != http",
        "bad": "protocol ==",
        "same": "protocol == HTTP",
        "word": "10.0.1.3",
        "number": "elapsedMs == 300",
    }
    entries, feed = some_entries(spark), Feed(filters)
    assert set(feed.errors) == {"bad"} and len(feed.subscribers) == 10
    got = {(r.subscriber, r.seq) for r in delivered(entries, feed).collect()}
    rows = entries.select("seq", *[ifl.flag(f).alias(s) for s, f in filters.items() if s != "bad"]).collect()
    assert got == {(s, r.seq) for r in rows for s in filters if s != "bad" and r[s]}
    assert delivered(entries, Feed({})).count() == 0 and delivered(entries, Feed({"x": "("})).count() == 0


def test_feed_evaluates_each_condition_once(spark):
    """Not once more to leave out entries for nobody, and not within a lambda function."""
    feed = Feed({"a": "protocol == http and elapsedMs >= 123457", "b": "elapsedMs < 765432 or status == error"})
    plan = delivered(some_entries(spark), feed).select("subscriber", "seq")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("123457") == plan.count("765432") == 1 and "lambda" not in plan


def test_feed_groups_what_filters_share():
    feed = Feed({f"s{i}": f for i, (f, _) in enumerate(_many_filters())})
    assert not feed.errors and sum(map(len, feed.subscribers)) == len(_many_filters()) > len(feed.subscribers)
    assert len(feed.rests) < 100 and len(feed.others) < 60


def test_a_batch_tried_again_sends_the_same(spark, tmp_path):
    rows = some_entries(spark).withColumns({"subscriber": F.lit(None).cast("string"), "filter": F.lit(None).cast("string")})
    ask = lambda *some: spark.createDataFrame([(i, *s) for i, s in enumerate(some)], "seq long, subscriber string, filter string")
    board = Switchboard(spark, f"file://{tmp_path}/b", history=5)
    batches = [
        rows.filter("seq < 20").unionByName(ask(("a", "status == success"), ("a", "protocol == http"), ("b", ""), ("c", "==")), allowMissingColumns=True),
        rows.filter("seq >= 20 and seq < 40").unionByName(ask(("a", "protocol =="), ("b", None)), allowMissingColumns=True),
        rows.filter("seq >= 40").unionByName(ask(("a", "protocol == dns")), allowMissingColumns=True),
    ]
    for k, b in enumerate(batches):
        for _ in range(2):
            board.deliver(b, k)
    sent = {(r.subscriber, r.batch, r.replayed, r.seq) for r in board.sent().collect()}
    assert board.sent().count() == len(sent)
    want = {("a", k, False, n) for k in (0, 1) for n in range(20 * k, 20 * k + 20) if n % 2 == 0} | {("b", 0, False, n) for n in range(20)}
    want |= {("a", 2, False, n) for n in range(40, 60) if n % 2} | {("a", 2, True, n) for n in range(31, 40, 2)}
    assert sent == want
    errors = {(r.batch, r.subscriber) for r in spark.read.json(f"file://{tmp_path}/b/errors").collect()}
    assert errors == {(0, "c"), (1, "a")}


def test_a_switchboard_computes_a_batch_once(spark, tmp_path):
    """What a stream does to a row is not done again to find who asks for what."""
    rows = some_entries(spark).withColumns({"subscriber": F.lit(None).cast("string"), "filter": F.lit(None).cast("string")})
    rows = rows.unionByName(spark.createDataFrame([(0, "a", "protocol == http")], "seq long, subscriber string, filter string"), allowMissingColumns=True)
    rows.write.parquet(f"{tmp_path}/in")
    done = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(node):
        done.add(1)
        return node

    board = Switchboard(spark, f"file://{tmp_path}/b")
    board.start(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").withColumn("node", noted("node")), availableNow=True).awaitTermination()
    assert done.value == 61
    assert sorted(r.seq for r in board.sent().collect()) == list(range(0, 60, 2))


def test_no_entry_is_both_counted_and_late(spark, tmp_path):
    """What rates leaves out is what too_late counts, batch by batch."""
    entries = some_entries(spark)
    parts = [entries.filter("seq >= 30 and seq < 50"), entries.filter("seq < 30"), entries.filter("seq >= 50").withColumn("timestamp", F.lit(BASE + timedelta(days=400)))]
    now = F.lit(BASE + timedelta(seconds=55))
    entries.limit(0).write.parquet(f"{tmp_path}/in")
    found = {}
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        for name, job in (("rates", jobs.rates), ("late", jobs.too_late)):
            stream = job(spark.readStream.schema(entries.schema).parquet(f"{tmp_path}/in"), 10, now)
            write = lambda df, _, name=name: found.setdefault(name, []).extend(df.collect())
            stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert sum(r.late for r in found["late"]) == 30
    assert {r.second.replace(tzinfo=UTC) if r.second.tzinfo is None else r.second for r in found["rates"]} == {BASE + timedelta(seconds=n) for n in range(30, 45)}
