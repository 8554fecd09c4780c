"""A data source for logs: lines by byte ranges, ends of files by seeking, and growing files as streams.

    spark.dataSource.register(LogSource)
    spark.read.format("perfloom-log").option("newest", 3).option("tail", 100).load("/var/log/app/*.log")
    spark.readStream.format("perfloom-log").load("/var/log/app/*.log")

Rows are file (name), start (offset of the line's first byte, which orders a file's lines) and line (UTF-8; broken bytes are
replaced). A file of any size is read in ranges of bytes, each line by the range that its first byte lies in; with tail, only
the blocks at its end are. Paths are what Arrow's file systems open (local, hdfs, s3, gs), on all machines.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, start long, line string"
NAMES = ["file", "start", "line"]
#: Bytes of a range, and of a block that is read at a time.
SPLIT, BLOCK = 64 << 20, 1 << 20


@dataclass
class Part(InputPartition):
    """Lines that begin at first or later, before last; with tail, the last so many lines before last."""

    uri: str
    first: int
    last: int
    tail: int = 0


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def listed(path: str, newest: int = 0) -> list[tuple[str, int]]:
    """(path for opened, size) of the files that a path names: a file, a folder or a pattern for names in a folder; of these the newest ones, if asked."""
    root = path[: path.index("://") + 3] if "://" in path else ""
    store, at = opened(path)
    if any(c in at for c in "*?["):
        folder, name = at.rsplit("/", 1)
    else:
        folder, name = (at, "*") if store.get_file_info(at).type == fs.FileType.Directory else (at.rsplit("/", 1)[0], at.rsplit("/", 1)[1])
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    files = [f for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, name)]
    if newest:
        files = sorted(files, key=lambda f: (-(f.mtime_ns or 0), f.path))[:newest]
    return sorted((f"{root or 'file://'}{f.path}", f.size) for f in files)


def after_newline(f, at: int, end: int) -> int:
    """The place after the first newline at or after a place; end if there is none."""
    while at < end:
        f.seek(at)
        block = f.read(min(BLOCK, end - at))
        if (k := block.find(b"\n")) >= 0:
            return at + k + 1
        at += len(block)
    return end


def begin_of_tail(f, end: int, n: int) -> int:
    """Where the last n lines before end begin; only what holds them is read, from the end."""
    at, missing = end, n
    last = True
    while at > 0:
        size = min(BLOCK, at)
        at -= size
        f.seek(at)
        block = f.read(size)
        k = len(block)
        if last and block.endswith(b"\n"):  # the end of the last line
            k -= 1
        last = False
        while (k := block.rfind(b"\n", 0, k)) >= 0:
            missing -= 1
            if not missing:
                return at + k + 1
    return 0


def lines(part: Part) -> Iterator[pa.RecordBatch]:
    store, at = opened(part.uri)
    name = at.rsplit("/", 1)[-1]
    with store.open_input_file(at) as f:
        size = f.size()
        if part.tail:
            pos = begin_of_tail(f, part.last, part.tail)
        else:
            pos = after_newline(f, part.first - 1, size) if part.first else 0
        held, offsets, body = 0, [], []
        rest, start = b"", pos
        while start < part.last:
            f.seek(pos)
            block = f.read(min(BLOCK, size - pos))
            pos += len(block)
            whole = rest + block
            cut = whole.split(b"\n")
            rest = cut.pop()
            if not block:  # the file's end: what is left is a line without newline
                cut, rest = ([rest] if rest else []), b""
            for line in cut:
                if start >= part.last:
                    break
                offsets.append(start)
                body.append(line.decode("utf-8", "replace"))
                start += len(line) + 1
                held += len(line) + 16
            if held > BLOCK or not block:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(body), pa.string()), pa.array(offsets, pa.int64()), pa.array(body, pa.string())], names=NAMES)
                held, offsets, body = 0, [], []
            if not block:
                return
        if body:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(body), pa.string()), pa.array(offsets, pa.int64()), pa.array(body, pa.string())], names=NAMES)


def ranges(uri: str, first: int, last: int, split: int) -> list[Part]:
    return [Part(uri, k, min(k + split, last)) for k in range(first, last, split)]


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "perfloom-log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return LogStream(self.options)


class LogReader(DataSourceReader):
    """Options: path, newest (files, by time of change), tail (lines of each file), split (bytes of a range)."""

    def __init__(self, options: dict):
        self.path, self.newest, self.tail, self.split = options["path"], int(options.get("newest", 0)), int(options.get("tail", 0)), int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path, self.newest)
        return [Part(u, 0, n, self.tail) for u, n in files if n] if self.tail else [p for u, n in files for p in ranges(u, 0, n, self.split)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return lines(partition) if partition is not None else iter(())


class LogStream(DataSourceStreamReader):
    """Lines as files grow: an offset holds, for each file, where its last whole line ends. A file that got shorter is a new one."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for uri, size in listed(self.path):
            store, at = opened(uri)
            with store.open_input_file(at) as f:
                end = begin_of_tail(f, size, 1) if size else 0
                f.seek(max(0, size - 1))
                out[uri] = size if size and f.read(1) == b"\n" else end
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for uri, last in sorted(end.items()):
            first = start.get(uri, 0)
            parts += ranges(uri, first if first <= last else 0, last, self.split)
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return lines(partition)

    def commit(self, end: dict) -> None:
        pass
