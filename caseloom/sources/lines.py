"""Long text files read in parallel, with the line numbers they have as a whole.

A PySpark data source plans byte ranges of files. A line belongs to the range that
holds its first byte, so a range begins behind the first line end at or after the
byte before it, and reads on past its end to finish its last line. A first pass counts
the lines of every range; added up along each file, the counts say at which number a
range begins, and the second pass numbers lines with no shuffle. What the driver
holds is one planned range with one number, whatever the lines.

What a line says of those after it is carried across ranges the same way: inside a
range by a window, and from range to range by the last value of each.

Empty files have no lines; a last line without an end is a line, and after a last
line end there is none; bytes that are no UTF-8 are replaced; a very long line is held
whole by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import scratch_folder

SPLIT_BYTES = 64 << 20
_READ_BYTES = 1 << 20
_TAIL_BYTES = 1 << 14
#: Tasks that small input is dealt over at least, where it has as many ranges.
_TASKS = 64
_LINE_SCHEMA = "file string, start long, line_no long, line string"
_COUNT_SCHEMA = "file string, start long, n long"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"\w+:/", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), path


@dataclass
class Range:
    path: str
    start: int
    end: int
    first_line: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads."""

    parts: list[Range]


def _dealt(parts: list[Range], tasks: int) -> list[Ranges]:
    """Neighbouring ranges together: about as many bytes a task as ``tasks`` tasks would read, at most ``SPLIT_BYTES`` unless one range has more."""
    most = min(SPLIT_BYTES, sum(p.end - p.start for p in parts) // tasks)
    dealt, held = [], 0
    for part in parts:
        size = part.end - part.start
        if not dealt or held + size > most:
            dealt.append(Ranges([]))
            held = 0
        dealt[-1].parts.append(part)
        held += size
    return dealt


class LineReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, counts: str | None):
        self.path, self.split_bytes, self.counts = path, split_bytes, counts

    def partitions(self) -> list[Ranges]:
        fs, folder = _file_system(self.path)
        found = fs.get_file_info(folder)
        infos = [found] if found.is_file else fs.get_file_info(pafs.FileSelector(folder, recursive=True))
        below = lambda path: path[len(folder) :].split("/")
        files = sorted((i.path, i.size) for i in infos if i.is_file and i.size and not any(p.startswith(("_", ".")) for p in below(i.path)))
        firsts: dict[tuple[str, int], int] = {}
        if self.counts is not None:
            counts_fs, counts_folder = _file_system(self.counts)
            table = pq.read_table(counts_folder, filesystem=counts_fs)
            held = dict(zip(zip(table["file"].to_pylist(), table["start"].to_pylist(), strict=True), table["n"].to_pylist(), strict=True))
        parts = []
        for path, size in files:
            first = 1
            for start in range(0, size, self.split_bytes):
                parts.append(Range(path, start, min(size, start + self.split_bytes), first))
                if self.counts is not None:
                    first += held[path, start]
        return _dealt(parts, _TASKS) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.path)
        for part in partition.parts:
            yield from self._read(fs, part)

    def _read(self, fs: pafs.FileSystem, partition: Range) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(partition.path) as file:
            if self.counts is None:
                n = _count(file, partition)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([partition.start]), pa.array([n])], ["file", "start", "n"])
                return
            number, held, size = partition.first_line, [], 0
            for line in _lines(file, partition):
                held.append(line.decode("utf-8", "replace"))
                size += len(line)
                if len(held) >= 10_000 or size >= 8 << 20:
                    yield _batch(partition, number, held)
                    number, held, size = number + len(held), [], 0
            if held:
                yield _batch(partition, number, held)


def _batch(part: Range, number: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array([part.start] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()), pa.array(lines)], ["file", "start", "line_no", "line"])


def _count(file, part: Range) -> int:
    """Lines that begin in a range: behind every line end from the byte before it to its last but one."""
    at, n = max(part.start - 1, 0), int(part.start == 0)
    file.seek(at)
    while at < part.end - 1:
        data = file.read(min(_READ_BYTES, part.end - 1 - at))
        n += data.count(b"\n")
        at += len(data)
    return n


def _lines(file, part: Range) -> Iterator[bytes]:
    at = max(part.start - 1, 0)
    file.seek(at)
    rest, skipping = b"", part.start > 0
    while data := file.read(max(_TAIL_BYTES, len(rest), min(_READ_BYTES, part.end - at))):  # behind its end what finishes a line, twice as much each time
        data, begin = rest + data, at - len(rest)  # begin: where the line in hand starts
        at = begin + len(data)
        pieces = data.split(b"\n")
        rest = pieces.pop()
        for piece in pieces:
            if begin >= part.end:
                return
            if not skipping:
                yield piece
            skipping = False
            begin += len(piece) + 1
        if begin >= part.end:
            return
    if rest and not skipping:
        yield rest


class LinesDataSource(DataSource):
    """Options: ``path``, ``splitBytes``, and ``counts``, a table of the lines of every range; without it such rows are what is read."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return _LINE_SCHEMA if "counts" in self.options else _COUNT_SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)), self.options.get("counts"))


def numbered_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, start, line_no, line) of all lines of the files below a path; ``start`` names the range that a line was read in."""
    spark.dataSource.register(LinesDataSource)
    read = spark.read.format("numbered_lines").option("splitBytes", split_bytes)
    counts = f"{scratch_folder(spark)}/counts"
    read.load(path).write.parquet(counts)
    return read.option("counts", counts).load(path)


def carried_lines(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """``lines`` with the last given value up to and with each line of its file, as in reports that name a thing once and then speak of it."""
    inside = Window.partitionBy("file", "start").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valued = lines.withColumn(name, value)
    last = valued.groupBy("file", "start").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line_no"))).alias("last"))
    along = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = last.select("file", "start", F.last_value("last", F.lit(True)).over(along).alias("before"))
    filled = valued.withColumn(name, F.last_value(name, F.lit(True)).over(inside)).join(before, ["file", "start"])
    return filled.withColumn(name, F.coalesce(name, "before")).select(*lines.columns, name)


def integer_samples(lines: DataFrame, arity: int, least: int = 2) -> DataFrame:
    """(file, line_no, values): comma-separated lines of exactly ``arity`` integers; files with fewer than ``least`` of them are left out."""
    values = F.transform(F.split("line", ","), lambda x: F.trim(x).try_cast("long"))
    read = lines.select("file", "line_no", values.alias("values")).where((F.size("values") == arity) & ~F.exists("values", lambda x: x.isNull()))
    enough = read.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("file")
    return read.join(enough, "file", "left_semi")
