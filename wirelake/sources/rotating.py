"""A sink of text lines in files of bounded size, of which the newest are kept.

Tasks write files that nobody reads yet, each closed once it has reached the size; the driver, told by
every task that finished what it wrote, gives these their names, in the order of batches. A task that is
lost or runs twice leaves a file that no message names, so its lines count once; a batch that is
committed again finds its names taken and only clears up. Only names pass through the driver.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

OPEN, DONE = "_open-", "lines-"


def file_system(path: str):
    """The file system of a URI and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    """The open files of one task, in order."""

    names: list[str] = field(default_factory=list)


class RotatingLines(DataSource):
    """Format ``rotating_lines``: option ``path``; ``mostBytes`` (100 MiB) closes a file, ``keep`` (5) stay,
    or all for 0. The stream has one column of text, a line each."""

    @classmethod
    def name(cls) -> str:
        return "rotating_lines"

    def schema(self) -> str:
        return "value string"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        o = self.options
        return LineWriter(o["path"], int(o.get("mostBytes", 100 << 20)), int(o.get("keep", 5)))


class LineWriter(DataSourceStreamWriter):
    def __init__(self, path: str, most_bytes: int, keep: int):
        self.path, self.most_bytes, self.keep = path, most_bytes, keep

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = file_system(self.path)
        files.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for row in iterator:
                if out is None:
                    names.append(f"{OPEN}{uuid.uuid4().hex}")
                    out, size = files.open_output_stream(f"{root}/{names[-1]}"), 0
                line = (row[0] or "").encode() + b"\n"
                out.write(line)
                size += len(line)
                if size >= self.most_bytes:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files, root, have = self._listed()
        known = [n for m in messages if m for n in m.names]
        for place, name in enumerate(known):
            done = f"{DONE}{batchId:012d}-{place:06d}.jsonl"
            if name in have and done not in have:
                files.move(f"{root}/{name}", f"{root}/{done}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        files, root, _ = self._listed()
        self._clear(files, root)

    def _listed(self):
        from pyarrow import fs

        files, root = file_system(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return files, root, {f.base_name for f in found}

    def _clear(self, files, root) -> None:
        """Open files go, since no task of the batch still writes one that counts, and so do the oldest."""
        have = self._listed()[2]
        done = sorted(n for n in have if re.fullmatch(rf"{DONE}\d+-\d+\.jsonl", n))
        for name in [n for n in have if n.startswith(OPEN)] + (done[: -self.keep] if self.keep else []):
            files.delete_file(f"{root}/{name}")
