"""Log files and zip files as a Python data source, `opslog`: lines (source_file, part, line, level, text).

A plain file is read in ranges of bytes and a zip file member by member, so that each range and each member is a task of its
own; lines are counted from 1 in each part. `level` is the level of a header line, null for others. Options: path, kind
(log or zip), include and exclude (patterns of names, joined by commas), encoding, errors (strict, replace or ignore),
rangeBytes, and the limits of a zip file. Filters on source_file leave out whole parts before they are read, and filters on
level leave out lines. As a stream the source tells what is appended to files, whole lines only.

A zip file with a member of another kind, a path that leads out, too many members or bytes, or one that shrinks too much is
refused as a whole, from its directory, before any of it is read. Files of unknown encoding errors fail the task unless
errors says otherwise; a byte range begins after the first line end at or behind its start, so encodings of two bytes a
character are read whole."""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringStartsWith

#: Limits of a zip file: members, bytes of all of them, and how much one of more than 10 MiB may shrink.
MAX_MEMBERS, MAX_BYTES, MAX_RATIO, RATIO_FROM = 2000, 1000 << 20, 500, 10 << 20
RANGE_BYTES, BATCH_LINES = 64 << 20, 10_000
SCHEMA = "source_file string, part long, line long, level string, text string"
_ARROW = pa.schema([("source_file", pa.string()), ("part", pa.int64()), ("line", pa.int64()), ("level", pa.string()), ("text", pa.string())])
# Fixed value: how a header line begins.
_LEVEL = re.compile(r"^(?:\d{2}/\d{2}/\d{2}|\d{4}[-/]\d{2}[-/]\d{2})\s+\d{2}:\d{2}:\d{2}\.\d{3}\s+(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\s+---\s")


@dataclass
class Part(InputPartition):
    """A range of a file's bytes, or a member of a zip file."""

    file: str
    start: int
    stop: int
    member: str = ""


def _wide(encoding: str) -> bool:
    """Whether line ends are more than one byte, so that a file can't be cut at any of them."""
    return "\n".encode(encoding) != b"\n"


class _Files:
    """What readers share: the options and the files they name."""

    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "log")
        self.include = [p for p in options.get("include", "*.zip" if self.kind == "zip" else "*.log").split(",") if p]
        self.exclude = [p for p in options.get("exclude", "").split(",") if p]
        self.encoding, self.errors = options.get("encoding", "utf-8"), options.get("errors", "replace")
        self.range = int(options.get("rangebytes", RANGE_BYTES))
        self.members, self.bytes = int(options.get("maxmembers", MAX_MEMBERS)), int(options.get("maxbytes", MAX_BYTES))
        self.levels: set[str] | None = None

    def system(self):
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def files(self) -> list[fs.FileInfo]:
        system, root = self.system()
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        fits = lambda name, patterns: any(fnmatch.fnmatchcase(name, p) for p in patterns)
        return sorted((f for f in found if f.type == fs.FileType.File and fits(f.base_name, self.include) and not fits(f.base_name, self.exclude)), key=lambda f: f.path)

    def ranges(self, file: str, start: int, stop: int) -> list[Part]:
        step = max(stop - start, 1) if _wide(self.encoding) else self.range
        return [Part(file, at, min(at + step, stop)) for at in range(start, stop, step)]

    def zipped(self, file: fs.FileInfo) -> list[Part]:
        """The members of a zip file, or what is wrong with it."""
        with self.system()[0].open_input_file(file.path) as raw, zipfile.ZipFile(raw) as archive:
            members = [m for m in archive.infolist() if not m.is_dir()]
        if len(members) > self.members or sum(m.file_size for m in members) > self.bytes:
            raise ValueError(f"{file.path}: more than {self.members} members or {self.bytes} bytes")
        for m in members:
            name = PurePosixPath(m.filename.replace("\\", "/"))
            if name.is_absolute() or ".." in name.parts or name.suffix.lower() not in (".log", ".txt"):
                raise ValueError(f"{file.path}: refused member {m.filename}")
            if m.file_size > RATIO_FROM and m.file_size > MAX_RATIO * max(1, m.compress_size):
                raise ValueError(f"{file.path}: {m.filename} shrinks too much")
        return [Part(file.path, 0, m.file_size, m.filename) for m in members]

    def lines(self, part: Part):
        """The decoded lines of a part."""
        system = self.system()[0]
        with system.open_input_file(part.file) as raw:
            if part.member:
                with zipfile.ZipFile(raw) as archive, archive.open(part.member) as inner:
                    yield from io.TextIOWrapper(inner, self.encoding, self.errors, newline="\n")
                return
            if _wide(self.encoding):
                yield from io.TextIOWrapper(raw, self.encoding, self.errors, newline="\n")
                return
            raw.seek(max(part.start - 1, 0))
            buffered = io.BufferedReader(_Raw(raw), 1 << 20)
            at = part.start
            if part.start:  # the line that the part's first byte stands in belongs to the part before, unless it begins there
                at += len(buffered.readline()) - 1
            while at < part.stop and (line := buffered.readline()):
                at += len(line)
                yield line.decode(self.encoding, self.errors)

    def read(self, part: Part):
        rows: list[tuple] = []
        name = part.member or part.file
        for number, text in enumerate(self.lines(part), 1):
            text = text.rstrip("\r\n")
            level = found[1] if (found := _LEVEL.match(text)) else None
            if self.levels is None or level in self.levels:
                rows.append((name, part.start, number, level, text))
            if len(rows) >= BATCH_LINES:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


class _Raw(io.RawIOBase):
    """An Arrow file for Python's buffered reader."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def readinto(self, into):
        got = self.file.read(len(into))
        into[: len(got)] = got
        return len(got)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.files, self.wanted = _Files(options), []

    def pushFilters(self, filters):
        """Equal names, lists and beginnings of source_file, and equal levels and lists of them; the rest is left to Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("source_file",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.wanted.append(f)
            elif column == ("level",) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files.levels = named if self.files.levels is None else self.files.levels & named
            else:
                yield f

    def _fits(self, part: Part) -> bool:
        name = part.member or part.file
        return all(name == f.value if isinstance(f, EqualTo) else name in f.value if isinstance(f, In) else name.startswith(f.value) for f in self.wanted)

    def partitions(self):
        every = self.files.files()
        parts = [p for f in every for p in (self.files.zipped(f) if self.files.kind == "zip" else self.files.ranges(f.path, 0, f.size))]
        return [p for p in parts if self._fits(p)] or [Part("", 0, 0)]

    def read(self, partition):
        return self.files.read(partition) if partition.file else iter(())


class StreamReader(DataSourceStreamReader):
    """Offsets are the bytes of whole lines that each file had."""

    def __init__(self, options):
        self.files = _Files(options)

    def initialOffset(self):
        return {}

    def latestOffset(self):
        system, _ = self.files.system()
        return {f.path: _whole(system, f) for f in self.files.files()}

    def partitions(self, start, end):
        return [p for file, stop in sorted(end.items()) for p in self.files.ranges(file, start.get(file, 0), stop)] or [Part("", 0, 0)]

    def read(self, partition):
        return self.files.read(partition) if partition.file else iter(())

    def commit(self, end):
        pass


def _whole(system, file: fs.FileInfo, step: int = 1 << 16) -> int:
    """The bytes of a file up to its last line end."""
    with system.open_input_file(file.path) as raw:
        stop = file.size
        while stop > 0:
            start = max(0, stop - step)
            raw.seek(start)
            at = raw.read(stop - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


class LogFiles(DataSource):
    @classmethod
    def name(cls):
        return "opslog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


def load(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Lines of the files under a path. Options as above."""
    spark.dataSource.register(LogFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = (spark.readStream if stream else spark.read).format("opslog").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, ",".join(value) if isinstance(value, (tuple, list)) else value)
    return reader.load()
