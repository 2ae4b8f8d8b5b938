"""A streaming source of lines that are appended to files, and the rule by which following them ends.

The offset of a stream is how many bytes of each file have been taken. A round takes whole lines only: what follows the last
line end stays for a later one, so a line that is written in pieces comes once. Files are append-only; a file that shrinks
ends the stream with an error. Long backlogs are cut into parts that are read side by side; a task takes several where there
are more parts than tasks, so small parts cost no task and no output file each.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from turnframe.sources.folders import files, store
from turnframe.sources.records import MANIFEST

LINES = "path string, at long, line string"
BLOCK, PART, STEP = 1 << 20, 64 << 20, 4096


@dataclass
class Span(InputPartition):
    """The lines of a file that begin in [first, last), the whole range being [start, end)."""

    path: str
    start: int
    first: int
    last: int
    end: int


@dataclass
class Spans(InputPartition):
    """What one task reads, in order."""

    spans: list[Span]


def bundled(spans: list[Span], tasks: int) -> list[Spans]:
    """Spans in runs of about equal bytes: as many as tasks, or more where a run would be longer than PART."""
    total = sum(s.last - s.first for s in spans)
    most, runs, size = min(PART, -(-total // tasks)), [], 0
    for s in spans:
        if not runs or size + s.last - s.first > most:
            runs.append(Spans([]))
            size = 0
        runs[-1].spans.append(s)
        size += s.last - s.first
    return runs


def _blocks(f, at: int, last: int, end: int) -> Iterator[bytes]:
    """Bytes from at: up to last, and on to end in small steps for the line that goes on there."""
    f.seek(at)
    while at < end:
        block = f.read(min(BLOCK, max(last - at, STEP), end - at))
        if not block:
            return
        at += len(block)
        yield block


def lines_of(span: Span) -> Iterator[tuple[str, int, str]]:
    """(path, byte at which the line begins, line) without line ends; bytes that are not UTF-8 are replaced."""
    system, path = store(span.path)
    inside = span.first > span.start  # the range begins in the middle of a line, unless the byte before ends one
    at, rest = span.first - inside, b""
    with system.open_input_file(path) as f:
        for block in _blocks(f, at, span.last, span.end):
            *whole, rest = (rest + block).split(b"\n")
            for raw in whole:
                if at >= span.last:
                    return
                if not inside:
                    yield span.path, at, raw.removesuffix(b"\r").decode("utf-8", "replace")
                inside, at = False, at + len(raw) + 1


def whole_upto(path: str, size: int, known: int) -> int:
    """The byte after the last line end before size, or known where none follows it."""
    system, path = store(path)
    with system.open_input_file(path) as f:
        end = size
        while end > known:
            begin = max(known, end - BLOCK)
            f.seek(begin)
            cut = f.read(end - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            end = begin
    return known


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, glob: str, part: int, tasks: int = 200):
        self.path, self.glob, self.part, self.tasks = path, glob, part, tasks
        self.seen: dict[str, int] = {}  # spares reading again what has been looked through

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for f in files(self.path):
            if fnmatch(f.base_name, self.glob) and f.size > self.seen.get(f.path, 0):
                self.seen[f.path] = whole_upto(f.path, f.size, self.seen.get(f.path, 0))
        return {p: n for p, n in sorted(self.seen.items()) if n}

    def partitions(self, start: dict, end: dict) -> list[Spans]:
        spans = []
        for path in sorted(set(start) | set(end)):
            a, b = start.get(path, 0), end.get(path, 0)
            if b < a:
                raise ValueError(f"{path} has shrunk: {a} bytes of it were taken, and it has {b} of whole lines")
            spans += [Span(path, a, x, min(x + self.part, b), b) for x in range(a, b, self.part)]
        return bundled(spans, self.tasks)

    def read(self, partition: Spans) -> Iterator[tuple[str, int, str]]:
        for span in partition.spans:
            yield from lines_of(span)


class TailSource(DataSource):
    """Format `tail_lines`: options path (a folder), glob (of file names), part (bytes that are read as one) and tasks (of a round, about; more only for long backlogs)."""

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("glob", "*"), int(self.options.get("part", PART)), int(self.options.get("tasks", 200)))


def tail_lines(spark: SparkSession, path: str, glob: str = "*", part: int = PART) -> DataFrame:
    """A stream (path, at, line) of the lines appended to the files below a folder."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail_lines").option("path", path).option("glob", glob).option("part", part).option("tasks", 4 * spark.sparkContext.defaultParallelism).load()


def tail_manifest(spark: SparkSession, path: str, glob: str = "*.segments.jsonl") -> DataFrame:
    """A stream of manifest rows; empty and corrupt lines are skipped and not tried again."""
    row = F.from_json("line", f"{MANIFEST}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return tail_lines(spark, path, glob).select(row.alias("r")).where("r._corrupt is null and r.path is not null").select("r.*").drop("_corrupt")


def follow(query: StreamingQuery, done: Callable[[], bool], poll: float = 1.0) -> None:
    """Waits until the sentinel is there and a round after it has brought nothing new, and stops the query then. A failed query raises."""
    taken = lambda: query.lastProgress.batchId if query.lastProgress else -1
    while query.isActive:
        ended, before = done(), taken()
        query.processAllAvailable()
        if ended and taken() == before:
            query.stop()
        elif not ended:
            time.sleep(poll)
    if failed := query.exception():
        raise failed
