"""Growing text files as a data source of their own, for batches and streams.

    tail.register(spark)
    spark.readStream.format("tidemark_tail").option("path", folder).load()

Unlike Spark's text source, which takes a file once, a stream of it goes on where a file ended the last time. What was not
read yet is cut into ranges of bytes, so a large file is many tasks. The number of a line is the place of its first byte,
which orders the lines of a file without counting them. The driver holds a place for each file, as Spark's file sources do
for what they have seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from tidemark.operators.fold import CONTEXT
from tidemark.sources.bulk import described_lines
from tidemark.sources.files import LINE_ENDS

SHAPE = "file_id string, name string, line_no long, line string"
SPLIT_BYTES = 64 << 20
#: How far the end of the last whole line is looked for at a time, and what a task reads and hands on at a time.
BACK_BYTES = 1 << 16
BATCH_BYTES = 1 << 20


@dataclass
class Span(InputPartition):
    """The lines of a file that begin at ``start`` or later and before ``end``, known not to begin before ``first``."""

    file_id: str
    first: int
    start: int
    end: int


class _Files:
    """The files below a path and the lines in them."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.known: dict[str, tuple] = {}

    def listed(self) -> list[fs.FileInfo]:
        system, path = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return sorted((i for i in found if i.is_file and i.size and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)

    def whole_lines(self, info: fs.FileInfo) -> int:
        """Where the last line of a file that has its end was ended; looked for backwards, in files that changed."""
        seen = self.known.get(info.path)
        if seen is None or seen[0] != (info.size, info.mtime_ns):
            system, _ = fs.FileSystem.from_uri(self.path)
            at, floor = info.size, seen[1] if seen else 0
            with system.open_input_file(info.path) as f:
                while at > floor:
                    start = max(floor, at - BACK_BYTES)
                    found = f.read_at(at - start, start).rfind(b"\n")
                    if found >= 0:
                        at = start + found + 1
                        break
                    at = start
            self.known[info.path] = seen = ((info.size, info.mtime_ns), at)
        return seen[1]

    def spans(self, file_id: str, start: int, end: int) -> list[Span]:
        return [Span(file_id, start, a, min(a + self.split_bytes, end)) for a in range(start, end, self.split_bytes)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(span.file_id) as raw:
            at = self.first_line(raw, span)
            raw.seek(at)
            rest, places, lines, weight = [], [], [], 0
            while at < span.end:
                more = raw.read(BATCH_BYTES)
                if not more and not any(rest):
                    break  # shorter than it was when it was listed
                pieces = more.split(b"\n") if more else [b"", b""]
                rest.append(pieces[0])
                if len(pieces) > 1:
                    pieces[0] = b"".join(rest)
                    rest = [pieces.pop()]
                    for piece in pieces:
                        if at < span.end:
                            places.append(at)
                            lines.append(piece.decode("utf-8", "replace"))
                            weight += len(piece)
                        at += len(piece) + 1
                if weight >= BATCH_BYTES or len(lines) >= 10_000 or at >= span.end:
                    yield self.batch(span, places, lines)
                    places, lines, weight = [], [], 0
            yield self.batch(span, places, lines)

    def first_line(self, raw: pa.NativeFile, span: Span) -> int:
        """Where the first line of a span begins; its end if none does."""
        at = max(span.first, span.start - 1)
        raw.seek(at)
        while span.start > span.first and at < span.end:  # what runs into the span began before it
            more = raw.read(min(BATCH_BYTES, span.end - at))
            found = more.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(more) or span.end - at
        return at

    def batch(self, span: Span, places: list[int], lines: list[str]) -> pa.RecordBatch:
        n, name = len(lines), span.file_id.rsplit("/", 1)[-1]
        columns = [pa.array([span.file_id] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["file_id", "name", "line_no", "line"])


class TailReader(DataSourceReader):
    """All lines, the last one of a file without its end too. Conditions on names choose the files that are read."""

    def __init__(self, options: dict):
        self.files, self.names = _Files(options), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("name",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = named if self.names is None else self.names & named
            else:
                yield f

    def partitions(self) -> list[Span]:
        chosen = (i for i in self.files.listed() if self.names is None or i.base_name in self.names)
        return [s for i in chosen for s in self.files.spans(i.path, 0, i.size)] or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        return self.files.read(span) if span.file_id else iter(())


class TailStream(DataSourceStreamReader):
    """Lines that have their end, from where the last trigger stopped. A file that became shorter is an error."""

    def __init__(self, options: dict):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {i.path: self.files.whole_lines(i) for i in self.files.listed()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        shorter = [f for f, e in end.items() if e < start.get(f, 0)]
        if shorter:
            raise ValueError(f"files became shorter: {shorter[:5]}")
        return [s for f, e in end.items() for s in self.files.spans(f, start.get(f, 0), e)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        return self.files.read(span)


class Tail(DataSource):
    """Options: path; splitBytes, the bytes a task reads."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_tail"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> TailReader:
        return TailReader(self.options)

    def streamReader(self, schema) -> TailStream:
        return TailStream(self.options)


def register(spark: SparkSession) -> None:
    """Lets ``spark`` read ``tidemark_tail``, and sources in Python see conditions, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(Tail)


def growing_lines(spark: SparkSession, path: str, format: str, split_bytes: int = SPLIT_BYTES, **declared: str | int | None) -> DataFrame:
    """A stream of (CONTEXT, line_no, line) for ``streaming.files``: the files below ``path``, which are of one ``format``."""
    register(spark)
    read = spark.readStream.format("tidemark_tail").option("path", path).option("splitBytes", split_bytes).load()
    parts = read.select("file_id", "name", "line_no", F.posexplode(F.split("line", LINE_ENDS, -1)).alias("pos", "text"))
    lines = parts.select("file_id", "name", (F.col("line_no") + F.col("pos")).alias("line_no"), F.col("text").alias("line"))
    return described_lines(lines, format=format, **declared).withColumn("flavor", F.lit(None).cast("string")).select(*CONTEXT, "line_no", "line")
