"""Stateful streams whose rows are handled in the order of their event times.

Rows of a key wait as state until the watermark has passed them, so what comes out depends on the
rows alone and not on how they arrived, as long as none comes later than the watermark allows; those
are dropped. What is remembered of a key is kept while it matters, and a timer wakes the key when
time alone changes something: a row may be handled, a request expires, a connection has been idle.
Rows wait in pieces of ``PIECE``, columns in Arrow's format, cut from rows in order: a row costs no state
of its own, and a piece is read when its first row's time has come.

A job is a small class: ``row`` takes a row in its turn, ``clock`` says that time has come so far,
``wakes`` when it wants to hear of that next, in microseconds. ``load`` and ``save`` turn its memory from and to
what JSON can hold; None means that nothing needs to be remembered.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.flows import ACK, FIN, RST, SYN, flag_names, from_client

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a key that are kept as one piece of state, and that are handed to a job at once.
PIECE = 1 << 16


class Replay(StatefulProcessor):
    """Holds back rows (us, seq, …) until the watermark and hands them to a job in order."""

    def __init__(self, job, held: StructType, keys: list[str]):
        self.job, self.schema = job, to_arrow_schema(held)
        self.names = [*keys, *(c.split()[0] for c in job.columns.split(", "))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "number long", "rows binary")
        #: the job's memory; number and first time of each piece; the number of the next one
        self.known = handle.getValueState("known", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        return self._go(key, [pa.RecordBatch.from_pandas(r[names], self.schema, preserve_index=False) for r in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._go(key, [], timerValues)

    def _taken(self, number: int) -> list[pa.RecordBatch]:
        rows = bytes(self.pieces.getValue((number,))[0])
        self.pieces.removeKey((number,))
        return pa.ipc.open_stream(rows).read_all().to_batches()

    def _kept(self, number: int, piece: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as writer:
            writer.write_table(piece)
        self.pieces.updateValue((number,), (sink.getvalue().to_pybytes(),))

    def _go(self, key, rows: list[pa.RecordBatch], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        saved, pieces, number = json.loads(self.known.get()[0]) if self.known.exists() else (None, [], 0)
        memory = None if saved is None else self.job.load(saved)
        for n, first in pieces:
            if first <= now:
                rows += self._taken(n)
        pieces = [p for p in pieces if p[1] > now]
        waiting = pa.Table.from_batches(rows, self.schema).combine_chunks()
        rows.clear()
        waiting = waiting.take(pa.compute.sort_indices(waiting, [(n, "ascending") for n in self.schema.names]))
        ready = int(waiting["us"].to_numpy().searchsorted(now, "right"))
        for at in range(0, ready, PIECE):
            out: list[tuple] = []
            part = waiting.slice(at, min(PIECE, ready - at))
            for r in zip(*(_values(c) for c in part.columns)):
                memory = self.job.clock(memory, r[0] - 1, out)
                memory = self.job.row(memory, dict(zip(self.schema.names, r)), out)
            if out:
                yield self._frame(key, out)
        out = []
        memory = self.job.clock(memory, now, out)
        if out:
            yield self._frame(key, out)
        for at in range(ready, len(waiting), PIECE):
            piece = waiting.slice(at, PIECE)
            self._kept(number, piece)
            pieces.append((number, piece["us"][0].as_py()))
            number += 1
        if memory is None and not pieces:
            self.known.clear()
        else:
            self.known.update((json.dumps((None if memory is None else self.job.save(memory), pieces, number)),))
        wakes = [first for _, first in pieces] + ([self.job.wakes(memory)] if memory is not None else [])
        at = max(-(-min(wakes) // 1000), now // 1000 + 1) if wakes else None
        timers = list(self.handle.listTimers())
        for t in timers:
            if t != at:
                self.handle.deleteTimer(t)
        if at is not None and at not in timers:
            self.handle.registerTimer(at)

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=self.names[len(key) :], dtype=object)
        for k, (name, value) in enumerate(zip(self.names, key)):
            made.insert(k, name, pd.Series([value] * len(made), dtype=object))
        return made

    def close(self) -> None:
        pass


def _values(column: pa.ChunkedArray) -> list:
    return column.to_pylist() if column.null_count or not pa.types.is_integer(column.type) else column.to_numpy().tolist()


def replayed(rows: DataFrame, keys: list[str], job, late: str) -> DataFrame:
    """The output of a job over a stream: its keys and ``job.columns``. ``rows``: keys, ts, seq and
    ``job.reads``. Rows without a key only move the watermark.

    State is kept in RocksDB, which the session that starts the query must name: see ``with_timers``.
    """
    reads = ["us", "seq", *job.reads]
    timed = rows.withWatermark("ts", late).filter(F.col(keys[0]).isNotNull() | F.col("ts").isNull())
    timed = timed.select(*keys, "ts", F.unix_micros("ts").alias("us"), "seq", *job.reads)
    held = StructType([timed.schema[n] for n in reads])
    out = ", ".join(f"{k} {timed.schema[k].dataType.simpleString()}" for k in keys) + ", " + job.columns
    return timed.groupBy(*keys).transformWithStateInPandas(Replay(job, held, keys), out, "Append", "EventTime")


def with_timers(spark) -> None:
    """Let the streams that this session starts keep state with timers."""
    spark.conf.set(PROVIDER, ROCKSDB)


class Job:
    """What the jobs have in common: memory that JSON holds as it is."""

    def load(self, saved):
        return saved

    def save(self, memory):
        return memory


class Queues(Job):
    """Each response with the oldest request that waits; requests expire, and overflow drops the oldest."""

    reads, columns = ("is_request",), "request_seq long, response_seq long, elapsed_ms long, depth long"

    def __init__(self, expire_seconds: int = 30, backlog: int = 1024):
        self.expire, self.backlog = expire_seconds * 1_000_000, backlog

    def load(self, saved):
        return deque(saved)

    def save(self, memory):
        return list(memory)

    def row(self, waiting, r: dict, out: list):
        waiting = deque() if waiting is None else waiting
        if r["is_request"]:
            waiting.append((r["us"], r["seq"], len(waiting)))
            if len(waiting) > self.backlog:
                waiting.popleft()
        elif waiting:
            us, seq, depth = waiting.popleft()
            out.append((seq, r["seq"], (r["us"] - us) // 1000, depth))
        return waiting or None

    def clock(self, waiting, us: int, out: list):
        while waiting and us - waiting[0][0] >= self.expire:
            waiting.popleft()
        return waiting or None

    def wakes(self, waiting) -> int:
        return waiting[0][0] + self.expire


class Latest(Job):
    """The first response after the latest request of a number, within the time."""

    reads, columns = ("is_request",), "request_seq long, response_seq long, elapsed_ms long"

    def __init__(self, expire_seconds: int = 30):
        self.expire = expire_seconds * 1_000_000 + 999  # times are compared in whole milliseconds

    def row(self, request, r: dict, out: list):
        if r["is_request"]:
            return [r["us"], r["seq"]]
        if request is not None:
            out.append((request[1], r["seq"], (r["us"] - request[0]) // 1000))
        return None

    def clock(self, request, us: int, out: list):
        return None if request is None or us - request[0] >= self.expire else request

    def wakes(self, request) -> int:
        return request[0] + self.expire


class Once(Job):
    """Packets but those with data that repeat number and length of the one before within a few milliseconds."""

    reads, columns = ("length",), "us long, seq long, length long"

    def __init__(self, milliseconds: int = 5):
        self.near = milliseconds * 1000

    def row(self, last, r: dict, out: list):
        now = [r["us"], r["seq"], r["length"]]
        if not (last and r["length"] and last[1:] == now[1:] and now[0] - last[0] <= self.near):
            out.append(tuple(now))
        return now

    def clock(self, last, us: int, out: list):
        return None if last is None or us - last[0] >= self.near else last

    def wakes(self, last) -> int:
        return last[0] + self.near


class Sessions(Job):
    """Connections as sessions of packets; one ends at the first FIN or RST or after idle time. What
    follows a FIN or RST isn't counted until a SYN opens the next session."""

    reads = ("sport", "dport", "length", "flags", "mss", "window")
    columns = (
        "started_us long, ended_us long, packets long, bytes long, client_bytes long, server_bytes long, client_packets long, server_packets long, "
        "client_bits int, server_bits int, mss long, window long, syn_us long, answer_us long"
    )

    def __init__(self, idle_seconds: int = 20):
        self.idle = idle_seconds * 1_000_000

    def row(self, m, r: dict, out: list):
        bits = r["flags"] or 0
        opens, closes = bits & (SYN | ACK) == SYN, bits & (FIN | RST) != 0
        if m and opens and m["ended"]:
            m = None
        m = m or {"last": r["us"], "ended": False, "sum": None}
        if not m["ended"]:
            s = m["sum"] or [r["us"], r["us"], 0, 0, 0, 0, 0, 0, 0, 0, None, None, None, None]
            side = 0 if from_client(r["sport"], r["dport"]) else 1
            s[1] = r["us"]
            for k, more in ((2, 1), (3, r["length"]), (4 + side, r["length"]), (6 + side, 1)):
                s[k] += more
            s[8 + side] |= bits
            s[10] = max((x for x in (s[10], r["mss"]) if x is not None), default=None)
            s[11] = r["window"]
            s[12] = r["us"] if s[12] is None and opens else s[12]
            s[13] = r["us"] if s[13] is None and bits & (SYN | ACK) == SYN | ACK else s[13]
            m["sum"] = s
        if closes and not m["ended"]:
            out.append(tuple(m["sum"]))
            m["sum"], m["ended"] = None, True
        m["last"] = r["us"]
        return m

    def clock(self, m, us: int, out: list):
        if m is None or us - m["last"] < self.idle:
            return m
        if m["sum"]:
            out.append(tuple(m["sum"]))
        return None

    def wakes(self, m) -> int:
        return m["last"] + self.idle


def pair_in_order(messages: DataFrame, expire_seconds: int = 30, backlog: int = 1024, late: str = "60 seconds") -> DataFrame:
    """(conn, request_seq, response_seq, elapsed_ms, depth) of a stream of conn, ts, seq, is_request."""
    return replayed(messages, ["conn"], Queues(expire_seconds, backlog), late)


def pair_by_number(messages: DataFrame, keys: list[str], expire_seconds: int = 30, late: str = "60 seconds") -> DataFrame:
    """(keys…, request_seq, response_seq, elapsed_ms) of a stream of keys, ts, seq, is_request. A number
    may be used again at once, so requests and responses aren't joined pair by pair: one request is kept."""
    return replayed(messages, keys, Latest(expire_seconds), late)


def without_repeats(packets: DataFrame, milliseconds: int = 5, late: str = "60 seconds") -> DataFrame:
    """(conn, src, sport, us, seq, length) of the packets that don't repeat the one before."""
    return replayed(packets.withColumn("length", F.col("length").cast("long")), ["conn", "src", "sport"], Once(milliseconds), late)


def sessions(packets: DataFrame, idle_seconds: int = 20, late: str = "60 seconds") -> DataFrame:
    """The sessions of a stream of packets, without their numbers: each as soon as it has ended."""
    wide = packets.withColumns({c: F.col(c).cast("long") for c in ("length", "mss", "window")})
    out = replayed(wide, ["conn"], Sessions(idle_seconds), late)
    flags = {f"{side}_flags": flag_names(F.col(f"{side}_bits")) for side in ("client", "server")}
    return out.withColumns(flags).withColumn("rtt_ms", (F.col("answer_us") - F.col("syn_us")) / 1000.0).drop("client_bits", "server_bits", "syn_us", "answer_us")


def of_keys(rows: Iterable[tuple], job) -> list[tuple]:
    """What a job gives for rows of one key that are all there, as (us, seq, …) in any order."""
    names, memory, out = ("us", "seq", *job.reads), None, []
    for r in sorted(rows):
        memory = job.clock(memory, r[0] - 1, out)
        memory = job.row(memory, dict(zip(names, r)), out)
    if memory is not None:
        job.clock(memory, 1 << 62, out)
    return out
