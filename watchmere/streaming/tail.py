"""Log tailing as a streaming source: ``spark.dataSource.register(Tail)``, then ``readStream.format("tail")``.

Options: path (files by comma), startingOffset (earliest or latest), chunkBytes, shared.
An offset holds each file's inode and byte; a new inode or a shorter file starts over,
a line without its end waits, and a missing file is no error.  The files are those
of the driver's machine, as a log shipper's are, and pass through the driver, up to
chunkBytes of each a batch.  With shared=true the files lie where every executor sees
them by the same path: a batch takes all whole lines that there are, cut into ranges of
chunkBytes, one a task; the driver keeps offsets only, and lines bring their byte (at).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

CHUNK_BYTES = 5000 * 2048


def read_lines(path: str, inode: int, at: int, limit: int = CHUNK_BYTES) -> tuple[list[str], int, int]:
    """Whole lines after a byte of a file, its inode and the byte after them."""
    try:
        with open(path, "rb") as fh:
            now = os.fstat(fh.fileno())
            if now.st_ino != inode or now.st_size < at:
                inode, at = now.st_ino, 0
            fh.seek(at)
            chunk = fh.read(limit)
            if len(chunk) == limit and b"\n" not in chunk:  # one line longer than a chunk
                chunk += fh.readline()
    except FileNotFoundError:
        return [], inode, at
    end = chunk.rfind(b"\n") + 1
    lines = chunk[:end].decode("utf-8", errors="replace").split("\n")[:-1]
    return [s.rstrip("\r") for s in lines], inode, at + end


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.latest = options.get("startingOffset", "latest") == "latest"
        self.limit = int(options.get("chunkBytes", CHUNK_BYTES))

    def initialOffset(self) -> dict:
        out = {}
        for p in self.paths:
            s = os.stat(p) if os.path.exists(p) else None
            out[p] = [s.st_ino if s else 0, s.st_size if s and self.latest else 0]
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], {}
        for p in self.paths:
            at = start[p][1] if p in start else 0
            lines, inode, upto = read_lines(p, start.get(p, [0, 0])[0], at, self.limit)
            rows += [(line, p) for line in lines if line.strip()]
            end[p] = [inode, upto]
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The lines of a batch that runs again."""
        for p in self.paths:
            inode, upto = end[p]
            at = start[p][1] if start.get(p, [0])[0] == inode else 0
            try:
                with open(p, "rb") as fh:
                    if os.fstat(fh.fileno()).st_ino != inode:
                        continue
                    fh.seek(at)
                    chunk = fh.read(max(upto - at, 0))
            except FileNotFoundError:
                continue
            for line in chunk.decode("utf-8", errors="replace").split("\n"):
                if line.strip():
                    yield (line.rstrip("\r"), p)


@dataclass
class Range(InputPartition):
    """The lines of a file that start at a byte from lo on and before hi; a batch's lines start at byte ``first``."""

    path: str
    inode: int
    first: int
    lo: int
    hi: int


def whole_lines(path: str, block: int = 1 << 16) -> tuple[int, int] | None:
    """A file's inode and the byte after its last whole line, looked for from the end; None if there is no file."""
    try:
        with open(path, "rb") as fh:
            s = os.fstat(fh.fileno())
            at = s.st_size
            while at > 0:
                lo = max(0, at - block)
                fh.seek(lo)
                found = fh.read(at - lo).rfind(b"\n")
                if found >= 0:
                    return s.st_ino, lo + found + 1
                at = lo
            return s.st_ino, 0
    except FileNotFoundError:
        return None


class SharedTailReader(DataSourceStreamReader):
    """Tailing by the executors: the driver looks up how far each file goes, tasks read ranges of bytes."""

    def __init__(self, options: dict[str, str]):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.latest = options.get("startingOffset", "latest") == "latest"
        self.step = int(options.get("chunkBytes", CHUNK_BYTES))
        self.seen: dict[str, list[int]] = {}

    def latestOffset(self) -> dict:
        """A file that is gone for the moment stays where it was."""
        for p in self.paths:
            found = whole_lines(p)
            self.seen[p] = list(found) if found else self.seen.get(p, [0, 0])
        return {p: list(self.seen[p]) for p in self.paths}

    def initialOffset(self) -> dict:
        return {p: [inode, at if self.latest else 0] for p, (inode, at) in self.latestOffset().items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.seen = {p: list(at) for p, at in start.items()} | self.seen
        made = []
        for p, (inode, upto) in end.items():
            was, at = start.get(p, [0, 0])
            first = at if was == inode and at <= upto else 0
            made += [Range(p, inode, first, lo, min(lo + self.step, upto)) for lo in range(first, upto, self.step)]
        return made

    def read(self, partition: Range) -> Iterator[tuple]:
        try:
            fh = open(partition.path, "rb")
        except FileNotFoundError:
            return
        with fh:
            if os.fstat(fh.fileno()).st_ino != partition.inode:
                return
            at = partition.lo
            if at > partition.first:  # a line that began in the range before belongs to it
                fh.seek(at - 1)
                at += len(fh.readline()) - 1
            fh.seek(at)
            while at < partition.hi:
                line = fh.readline()
                if not line.endswith(b"\n"):
                    return
                text = line.decode("utf-8", errors="replace").rstrip("\r\n")
                if text.strip():
                    yield text, partition.path, at
                at += len(line)


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    @property
    def shared(self) -> bool:
        return self.options.get("shared", "false").lower() == "true"

    def schema(self) -> str:
        return "value string, file string" + (", at long" if self.shared else "")

    def streamReader(self, schema) -> SharedTailReader:
        return SharedTailReader(self.options) if self.shared else super().streamReader(schema)

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options)
