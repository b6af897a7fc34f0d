"""Logs as a Python data source: ``format("trace")``, batch and stream, cut at block ends.

A file is dealt over ranges of bytes. A range owns the footers that end in it, and each footer closes what the lines
since the footer before it have opened, so a range is read from the last footer before it to the last one in
it, and no line is passed through the driver. Lines end in a newline, or a carriage return and one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tracelake.operators.core import scanned
from tracelake.sources.trace import FOOTER, HEADER

#: A row per footer that closes a block, and one (without tag) for lines at a range's end that no block holds: where it ends, how
#: many lines it is since the one before, which of these is the header.
RAW = "trace_id string, end_at long, lines long, head long, tag string, function string, source_file string, source_line int, body array<string>"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
_NAMES = [f.split()[0] for f in RAW.split(", ")]
_FOOTER_END = re.compile(rb"(?:\A|(?<=\n))-{48} *\r?\n")
BLOCK, ROWS = 64 << 20, 1000


class Blocks:
    """The entry that is open in one log; ``feed`` takes a line and returns the entry that it closes, as (line of the header, tag, function, file, line, body)."""

    def __init__(self, number: int | None = None, lines: list[str] | None = None):
        self.number, self.lines = number, lines or []

    def feed(self, number: int, line: str) -> tuple | None:
        if re.fullmatch(FOOTER, line.rstrip(" ")):
            found, head = self.lines, self.number
            self.number, self.lines = None, []
            if head is None:
                return None
            m = re.match(HEADER, found[0])
            return head, m[1], m[2], m[3], int(m[4]), found[1:]
        if self.number is None:
            if not re.match(HEADER, line):
                return None
            self.number = number
        self.lines.append(line)
        return None


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    whole: bool  # the file ends with this range


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """The files at or below a path and their sizes; names that begin with _ or . are left out."""
    system, at = _system(path)
    found = system.get_file_info(at)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if found.type == fs.FileType.File:
        return {path: found.size}
    below = system.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x[:1] in "_." for x in p[len(at) :].split("/") if x)
    return {prefix + x.path: x.size for x in below if x.type == fs.FileType.File and not hidden(x.path)}


def _ranges(path: str, start: int, end: int, block: int, whole: bool) -> list[Range]:
    cuts = [*range(start, end, block), end]
    return [Range(path, a, b, whole and b == end) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _last_footer(source, at: int, whole: bool) -> int:
    """Where the last footer that ends at ``at`` or before ends; 0 without one. ``whole``: the file ends there, a last line needs no newline."""
    size = 1 << 16
    while True:
        low = max(0, at - size)
        source.seek(low)
        data = source.read(at - low)
        if whole and not data.endswith(b"\n"):
            data += b"\n"
        found = [m.end() for m in _FOOTER_END.finditer(data) if m.start() or not low]
        if found:
            return min(low + found[-1], at)
        if not low:
            return 0
        size *= 4


def _entries(part: Range, name: str) -> Iterator[pa.RecordBatch]:
    system, path = _system(part.path)
    with system.open_input_file(path) as source:
        stop = _last_footer(source, part.end, part.whole)
        if stop <= part.start:
            return
        at = _last_footer(source, part.start, False)
        source.seek(at)
        blocks, number, since, rows, left = Blocks(), 0, 0, [], b""
        while at < stop:
            data = left + source.read(min(1 << 20, stop - source.tell()))
            if source.tell() == stop and not data.endswith(b"\n"):
                data += b"\n"
            *lines, left = data.split(b"\n")
            for raw in lines:
                number, at = number + 1, at + len(raw) + 1
                entry = blocks.feed(number, raw.removesuffix(b"\r").decode("utf-8", "replace"))
                if entry:
                    rows.append((name, min(at, stop), number - since, entry[0] - since, *entry[1:]))
                    since = number
            if len(rows) >= ROWS:
                yield _batch(rows)
                rows = []
        if number > since:
            rows.append((name, stop, number - since, None, None, None, None, None, None))
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _name(path: str) -> str:
    """As Spark's own readers name a file."""
    return path if "://" in path else f"file:{path}"


class TraceReader(DataSourceReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def partitions(self) -> list[Range]:
        return [r for path, size in sorted(_files(self.path).items()) for r in _ranges(path, 0, size, self.block, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _entries(partition, _name(partition.path))


class TraceStreamReader(DataSourceStreamReader):
    """New blocks of growing files: an offset is every file's size."""

    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _files(self.path)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for path, size in sorted(end.items()) for r in _ranges(path, start.get(path, 0), size, self.block, False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _entries(partition, _name(partition.path))

    def commit(self, end: dict) -> None:
        pass


class TraceSource(DataSource):
    """Options: ``path`` (a file, or a folder of files) and ``blockBytes`` (a task's range)."""

    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> TraceReader:
        return TraceReader(self.options["path"], int(self.options.get("blockBytes", BLOCK)))

    def streamReader(self, schema) -> TraceStreamReader:
        return TraceStreamReader(self.options["path"], int(self.options.get("blockBytes", BLOCK)))


def numbered(raw: DataFrame) -> DataFrame:
    """``segment``'s rows: each log's lines and entries are counted over its blocks, in spans of bytes."""
    own = F.col("tag").isNotNull()
    found = scanned(raw, "trace_id", "end_at", {"_lines": F.col("lines"), "_n": own.cast("int")}, span=BLOCK).where(own)
    return found.select("trace_id", (F.col("_n") + 1).alias("entry_id"), (F.col("_lines") + F.col("head")).alias("line_number"), "tag", "function", "source_file", "source_line", "body")


def read_trace(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """The entries of the logs at a path."""
    spark.dataSource.register(TraceSource)
    return numbered(spark.read.format("trace").option("blockBytes", block).load(path))


def stream_trace(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """A stream of the entries of growing logs: where each ends in place of its numbers; a footer counts once its line has ended."""
    spark.dataSource.register(TraceSource)
    found = spark.readStream.format("trace").option("blockBytes", block).load(path)
    return found.where("tag is not null").select("trace_id", "end_at", "tag", "function", "source_file", "source_line", "body")
