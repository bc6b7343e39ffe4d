"""Capture files as a data source: byte ranges of large files read side by side.

Nothing in a capture file marks where a record begins, so a task that starts inside one looks for a
place from which records follow each other. Such a place may lie within a packet that itself holds
records, but their chain meets the true one at the end of that packet at the latest; so a task begins
its search several longest records ahead of its range and believes only what it has reached by then.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..wire.pcap import HEADER, PACKET, RECORD, _batch, decode, header
from .rotating import file_system

#: Records that must follow each other where a chain begins, and the bytes of the longest where a file's header names none.
CHAIN, LONGEST = 4, 1 << 18


@dataclass
class Range(InputPartition):
    """Records that begin in [start, end) of a file."""

    file: str
    start: int
    end: int


class CaptureFiles(DataSource):
    """Format ``captures``: option ``path``, ``splitBytes``, ``ports``. Equalities of proto and ports are
    applied before a packet becomes a row; the session has to push filters to Python sources."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return PACKET

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return CaptureReader(o["path"], int(o.get("splitBytes", 64 << 20)), frozenset(int(p) for p in o.get("ports", "").split(",") if p))


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, split: int, ports: frozenset):
        self.path, self.split, self.ports = path, max(split, 1), ports
        self.wanted: dict[str, frozenset] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name not in ("proto", "sport", "dport"):
                yield f
                continue
            values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        files, root = file_system(self.path)
        folder, _, pattern = root.rpartition("/")
        if any(c in pattern for c in "*?["):
            import fnmatch

            found = [f for f in files.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, pattern)]
        else:
            one = files.get_file_info(root)
            found = files.get_file_info(fs.FileSelector(root, recursive=True)) if one.type == fs.FileType.Directory else [one]
            if one.type == fs.FileType.NotFound:
                raise FileNotFoundError(self.path)
        named = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file://"
        return [Range(scheme + p, at, min(at + self.split, size)) for p, size in named for at in range(HEADER, size, self.split)]

    def read(self, partition: Range) -> Iterator:
        files, path = file_system(partition.file)
        with files.open_input_file(path) as f:
            mark, scale, longest, link = header(f.read_at(HEADER, 0))
            longest = longest if 0 < longest <= LONGEST else LONGEST
            rows = []
            for at, time, frame in records(f, partition.start, partition.end, mark, scale, longest):
                packet = decode(link, frame)
                if packet and self._passes(packet):
                    rows.append(packet | {"file": partition.file, "number": at, "ts_us": time, "length": len(frame)})
                if len(rows) >= 5000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    def _passes(self, packet: dict) -> bool:
        if self.ports and packet["proto"] != "icmp" and not self.ports & {packet["sport"], packet["dport"]}:
            return False
        return all(packet.get(name) in values for name, values in self.wanted.items())


class _Window:
    """Bytes of a file, read in stretches."""

    def __init__(self, f, stretch: int):
        self.f, self.size, self.stretch = f, f.size(), stretch
        self.at, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at`` on, fewer at the end of the file."""
        if not self.at <= at <= at + n <= self.at + len(self.data):
            self.at, self.data = at, self.f.read_at(min(max(n, self.stretch), max(self.size - at, 0)), at)
        return self.data[at - self.at : at - self.at + n]


def records(f, start: int, end: int, mark: str, scale: int, longest: int) -> Iterator[tuple[int, int, bytes]]:
    """(place, microseconds, frame) of the records that begin in [start, end); a record that the file's end
    cuts off is none."""
    window = _Window(f, 8 << 20)

    def head(at: int):
        """(seconds, part, size) of what would be a record at ``at``; None if it can't be one."""
        data = window.get(at, RECORD)
        if len(data) < RECORD:
            return None
        seconds, part, size, whole = struct.unpack(mark + "IIII", data)
        if part >= 1_000_000 * scale or not size <= longest or whole < size or at + RECORD + size > window.size:
            return None
        return seconds, part, size

    def chained(at: int) -> bool:
        first = None
        for _ in range(CHAIN):
            if at == window.size:
                return first is not None
            found = head(at)
            if found is None or first is not None and abs(found[0] - first) > 1 << 26:
                return False
            first, at = found[0] if first is None else first, at + RECORD + found[2]
        return True

    def follow(at: int, until: int) -> int | None:
        """The first place of the chain from ``at`` that isn't before ``until``; None where it breaks."""
        while at < until:
            found = head(at)
            if found is None:
                return None
            at += RECORD + found[2]
        return at

    at = max(HEADER, start - 8 * (longest + RECORD))
    if at == HEADER:
        at = follow(at, start)
    else:
        while at is not None and at < start:
            reached = follow(at, start) if chained(at) else None
            if reached is not None:
                at = reached
            else:
                at += 1
    while at is not None and at < end:
        seconds, part, size, _ = struct.unpack(mark + "IIII", d) if len(d := window.get(at, RECORD)) == RECORD else (0, 0, 1 << 32, 0)
        if at + RECORD + size > window.size:
            return
        yield at, seconds * 1_000_000 + part // scale, window.get(at + RECORD, size)
        at += RECORD + size
