"""JSON lines as a data source of Spark: read by byte ranges, followed as a stream, written by a commit of whole files.

spark.dataSource.register(Lines), then spark.read.format("lines"), spark.readStream.format("lines"), df.write.format("lines").
Paths are those of pyarrow.fs: local ones, and URIs of stores that it knows (hdfs, s3, gs); other stores go by jsonl.lines().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "source_file string, offset long, value string"
#: Bytes of a range, rows of a batch; where files lie until they are committed.
RANGE, ROWS, STAGED = 64 << 20, 4096, "_staged"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files at a path (a file, or a folder's), without hidden ones, in order."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(at) :].strip("/").split("/"))
    return sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not hidden(f.path))


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at these bytes."""

    file: str
    begin: int
    end: int


def ranges(file: str, begin: int, end: int, size: int) -> list[Range]:
    return [Range(file, a, min(a + size, end)) for a in range(begin, end, size)]


def read_range(system: fs.FileSystem, part: Range) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a range, blank ones left out. Whichever range a line begins in reads it to its end."""
    name, rows = part.file.rsplit("/", 1)[-1], []
    with system.open_input_file(part.file) as f:
        f.seek(max(0, part.begin - 1))
        if part.begin and f.read(1) != b"\n":
            while (rest := f.read(1 << 16)) and b"\n" not in rest:
                pass
            f.seek(f.tell() - len(rest) + rest.find(b"\n") + 1 if rest else f.tell())
        at, held = f.tell(), b""
        while at < part.end:
            more = f.read(1 << 20)
            held += more
            *lines, held = held.split(b"\n") if more else (held, b"")
            for line in lines:
                if at < part.end and line.strip():
                    rows.append((name, at, line.rstrip(b"\r").decode("utf-8", "replace")))
                at += len(line) + 1
            while len(rows) >= ROWS or rows and (not more or at >= part.end):
                yield batch(rows[:ROWS])
                rows = rows[ROWS:]
            if not more:
                break


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["source_file", "offset", "value"])


class Lines(DataSource):
    """Lines of text files with the byte that each begins at, which orders a file's lines and names them for good."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return Follower(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options, schema, overwrite)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("range_bytes", RANGE))

    def partitions(self) -> Sequence[InputPartition]:
        return [r for file, n in files(self.path) for r in ranges(file, 0, n, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(opened(self.path)[0], partition)


class Follower(DataSourceStreamReader):
    """Files that appear in a folder, and lines that are added to them. An offset is how far each file was read: to the end
    of a line; one that isn't ended yet waits."""

    def __init__(self, options: dict[str, str]):
        self.path, self.size, self.ends = options["path"], int(options.get("range_bytes", RANGE)), {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system = opened(self.path)[0]
        for file, n in files(self.path):
            if n != self.ends.get(file, (0, 0))[0]:
                self.ends[file] = (n, self.last_line(system, file, n))
        return {file: end for file, (_, end) in self.ends.items()}

    def last_line(self, system: fs.FileSystem, file: str, n: int) -> int:
        """The byte after the last line that is ended."""
        with system.open_input_file(file) as f:
            while n > 0:
                a = max(0, n - (1 << 16))
                f.seek(a)
                at = f.read(n - a).rfind(b"\n")
                if at >= 0:
                    return a + at + 1
                n = a
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [r for file, n in sorted(end.items()) for r in ranges(file, start.get(file, 0), n, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(opened(self.path)[0], partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    staged: str | None


class Writer(DataSourceArrowWriter):
    """One column of lines. A task writes to a staged file of its own; when all have ended, the driver moves the files of the
    successful attempts to their names and marks the folder. A task or job that breaks off leaves nothing but staged files, which
    no reader sees, and a job that is aborted removes its own."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        if [f.dataType.simpleString() for f in schema] != ["string"]:
            raise ValueError("lines are written from one column of strings")
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, at = opened(self.path)
        folder = f"{at}/{STAGED}/{self.job}"
        system.create_dir(folder, recursive=True)
        name, n = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(name) as f:
            for rows in iterator:
                for value in rows.column(0).to_pylist():
                    if value is not None:
                        f.write(value.encode() + b"\n")
                        n += 1
        return Written(name if n else None)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        old = [f for f, _ in files(self.path)] if self.overwrite else []
        for m in messages:
            if m and m.staged:
                name = m.staged.rsplit("/", 1)[1]
                system.move(m.staged, f"{at}/{name}")
        for f in old:
            system.delete_file(f)
        self.abort(messages)
        with system.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        system, at = opened(self.path)
        folder = f"{at}/{STAGED}/{self.job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
