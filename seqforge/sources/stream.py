"""Labelled lines as a stream: a Python data source that follows growing files, such as those into which a pipe is spooled.

An offset is the number of bytes of each file that have been taken, always up to the end of a line, so a restarted query goes on
behind the last committed line and reads none twice. A micro-batch is dealt to tasks by byte ranges; a range has the lines that begin
in it. With ``limit`` the offsets end behind the so many first accepted lines, in the order of file names and places: what
lies behind is never planned, let alone read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from seqforge.session import ship_package
from seqforge.sources.labelled import one_vs_rest, parse_lines

#: Bytes of a task's range, and of what is read at once.
RANGE, CHUNK = 32 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[fs.FileInfo]:
    """A file, or the files of a folder by name, without hidden ones."""
    system, where = opened(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return sorted((x for x in found if x.is_file and x.base_name[0] not in "._"), key=lambda x: x.path)


def last_line_end(system: fs.FileSystem, path: str, size: int, begin: int) -> int:
    """Where the last complete line that ends behind ``begin`` ends."""
    with system.open_input_file(path) as f:
        end = size
        while end > begin:
            low = max(begin, end - CHUNK)
            f.seek(low)
            at = f.read(end - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            end = low
    return begin


def lines_of(system: fs.FileSystem, path: str, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """place and bytes, without its end, of each line that begins from ``begin`` to before ``end``."""
    with system.open_input_file(path) as f:
        # the line that runs into the range from before is not its own
        at = begin - 1 if begin else 0
        f.seek(at)
        rest, skip = b"", bool(begin)
        while chunk := f.read(CHUNK):
            *whole, rest = (rest + chunk).split(b"\n")
            for line in whole:
                if not skip and at < end:
                    yield at, line
                at, skip = at + len(line) + 1, False
            if at >= end:
                return
        if rest and not skip and at < end:  # a last line without an end
            yield at, rest


def accepted(line: bytes) -> bool:
    """As :func:`parse_lines` takes a line: neither blank nor a comment, and with a sequence."""
    text = line.removesuffix(b"\r")
    if not line or line.startswith(b";"):
        return False
    cut = min((i for i in (text.find(b" "), text.find(b"\t")) if i >= 0), default=-1)
    return len(text[cut + 1 :]) > 0


class LinesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.limit = options["path"], int(options.get("limit", "-1"))
        self.taken: dict[str, int] = {}
        self.rows = 0

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        """How far each file can be read; with a limit, behind its last accepted line."""
        system, _ = opened(self.path)
        for info in files_of(self.path):
            begin = self.taken.get(info.path, 0)
            end = last_line_end(system, info.path, info.size, begin)
            if self.limit < 0:
                self.taken[info.path] = max(begin, end)
                continue
            for place, line in lines_of(system, info.path, begin, end):
                if self.rows >= self.limit:
                    break
                self.rows += accepted(line)
                self.taken[info.path] = place + len(line) + 1
        return {"rows": self.rows, **self.taken}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # after a restart, what is planned first tells where the last run ended
        for path, n in end.items():
            if path != "rows":
                self.taken[path] = max(n, self.taken.get(path, 0))
        self.rows = max(self.rows, end.get("rows", 0))
        out = []
        for path in sorted(set(end) - {"rows"}):
            begin = start.get(path, 0)
            out += [Range(path, i, min(i + RANGE, end[path])) for i in range(begin, end[path], RANGE)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for place, line in lines_of(system, partition.path, partition.begin, partition.end):
            yield partition.path, place, line.decode("utf-8", "replace")


class LabelledLines(DataSource):
    """``path``: a file or folder; ``limit``: the first accepted lines only."""

    @classmethod
    def name(cls) -> str:
        return "labelled_lines"

    def schema(self) -> str:
        return "file string, place long, value string"

    def streamReader(self, schema) -> LinesReader:
        return LinesReader(self.options)


def read_labelled_stream(spark: SparkSession, path: str, limit: int = -1, drop_empty: bool = True, positive: int | None = None) -> DataFrame:
    """A stream of file, place, y, seq and malformed, as :func:`seqforge.sources.labelled.read_labelled` reads files."""
    ship_package(spark)
    spark.dataSource.register(LabelledLines)
    lines = spark.readStream.format("labelled_lines").option("limit", str(limit)).load(path)
    out = parse_lines(lines, drop_empty=drop_empty)
    return out if positive is None else out.withColumn("y", one_vs_rest(out["y"], positive))


def spool(lines: Iterable[str], path: str, name: str = "lines.txt", at_once: int = 10_000) -> None:
    """Append lines, such as those of standard input, to a file that a stream follows; only whole lines become visible to it."""
    system, where = opened(path)
    system.create_dir(where, recursive=True)
    held: list[str] = []
    with system.open_append_stream(f"{where}/{name}") as f:
        for line in lines:
            held.append(line.rstrip("\n"))
            if len(held) >= at_once:
                f.write(("\n".join(held) + "\n").encode())
                f.flush()
                held.clear()
        if held:
            f.write(("\n".join(held) + "\n").encode())
