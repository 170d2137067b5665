"""A streaming source of files that grow: each whole line once, also where a line arrives in pieces.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").option("glob", "*.jsonl").load("/landed/responses")

The offset of a batch is the number of bytes of each file up to its last line break; what stands behind it waits. A file that nobody
writes any more has a file of its name and `.end` beside it: then its last line counts without a break as well. Ranges of `range_bytes` are
read apart, each from its first line on to the line that runs over its end. Lines are cut at bytes, so that no character is torn.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructType

ENDED = ".end"


@dataclass
class Range(InputPartition):
    name: str
    first: int  # of the batch's bytes of the file
    start: int
    stop: int
    last: int


def last_break(file, size: int, known: int, step: int = 1 << 16) -> int:
    """The offset behind the last line break before `size`, but no less than `known`."""
    end = size
    while end > known:
        begin = max(known, end - step)
        file.seek(begin)
        at = file.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return known


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.system, self.root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.glob, self.range_bytes = options.get("glob", "*"), int(options.get("range_bytes", 64 << 20))
        self.known: dict[str, int] = {}

    def _files(self) -> dict[str, int]:
        found = self.system.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return {f.path[len(self.root) :].lstrip("/"): f.size for f in found if f.type == fs.FileType.File}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        there = self._files()
        for name, size in sorted(there.items()):
            if name.endswith(ENDED) or not fnmatch.fnmatch(name, self.glob) or size == self.known.get(name, 0):
                continue
            if name + ENDED in there:
                self.known[name] = size
            else:
                with self.system.open_input_file(f"{self.root}/{name}") as file:
                    self.known[name] = last_break(file, size, self.known.get(name, 0))
        return {"files": json.dumps({k: v for k, v in self.known.items() if v}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        self.known = {**self.known, **{k: max(v, self.known.get(k, 0)) for k, v in now.items()}}
        ranges = []
        for name, last in sorted(now.items()):
            first = before.get(name, 0)
            ranges += [Range(name, first, at, min(at + self.range_bytes, last), last) for at in range(first, last, self.range_bytes)]
        return ranges

    def read(self, partition: Range) -> Iterator[tuple]:
        with self.system.open_input_file(f"{self.root}/{partition.name}") as file:
            at, pending = partition.start, b""
            if at > partition.first:  # a line that began before belongs to the range before
                file.seek(at - 1)
                while at < partition.stop and not pending:
                    block = file.read(min(1 << 16, partition.stop - at + 1))
                    cut = block.find(b"\n")
                    if cut < 0:
                        at += len(block) if at > partition.start else len(block) - 1
                        continue
                    at += cut + 1 if at > partition.start else cut
                    break
                if at >= partition.stop:
                    return
            file.seek(at)
            while at < partition.stop:
                line = self._line(file, partition.last - at)
                yield partition.name, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)
                file.seek(at)

    def _line(self, file, most: int) -> bytes:
        parts, left = [], most
        while left:
            block = file.read(min(1 << 16, left))
            if not block:
                break
            cut = block.find(b"\n") + 1
            parts.append(block[:cut] if cut else block)
            if cut:
                break
            left -= len(block)
        return b"".join(parts)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """file, offset (of its first byte), value."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> StructType:
        return StructType().add("file", StringType()).add("offset", LongType()).add("value", StringType())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingLinesReader(self.options)
