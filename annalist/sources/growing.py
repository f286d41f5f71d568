"""Lines of files that grow: only the bytes after those that were read before.

In a batch Spark lists the files; a join with what was seen gives each file's new bytes, which are cut into ranges and
read by tasks. As a stream the bytes of each file are the source's offset, which the query's checkpoint keeps, and the
ranges are its partitions. A line belongs to the range that its first byte is in. A last line without its end isn't read
yet, and a file that has become shorter is read anew.
"""

from __future__ import annotations

import fnmatch
import io
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES = 16 << 20
LINES = "path string, modified timestamp, line long, end long, value string"


def files(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """path, modified, length of the files below a folder; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), "length")


def _lines(system, name: str, start: int, stop: int, first: int):
    """(offset, end, line) of whole lines that begin in [start, stop); first is where the file's new bytes begin."""
    with io.BufferedReader(system.open_input_file(name), 1 << 20) as f:
        f.seek(max(first, start - 1))
        at = f.tell()
        if start > first:  # the line that the byte before belongs to is another range's
            at += len(f.readline())
        while at < stop:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield at, at + len(line), line
            at += len(line)


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri)))


def _range_lines(path: str, modified, first: int, start: int, stop: int):
    """Record batches of LINES of the whole lines that begin in [start, stop)."""

    def batch(found):
        columns = [pa.array([path] * len(found), pa.string()), pa.array([modified] * len(found), pa.timestamp("us", "UTC"))]
        columns += [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["path", "modified", "line", "end", "value"])

    system, name = _opened(path)
    found, size = [], 0
    for at, end, line in _lines(system, name, start, stop, first):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        found.append((at, end, text))
        size += len(text)
        if size > 4 << 20:
            yield batch(found)
            found, size = [], 0
    yield batch(found)


def new_lines(spark: SparkSession, folder: str, seen: DataFrame, glob: str = "*.jsonl", most: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, modified, line (its first byte), end, value, v: lines after the `bytes` that seen (path, bytes) has of a file.

    most: at most so many new bytes of each file, for runs that save their progress in between.
    """
    known = seen.groupBy("path").agg(F.max("bytes").alias("bytes"))
    rows = files(spark, folder, glob).join(known, "path", "left").withColumn("first", F.when(F.col("bytes") <= F.col("length"), F.col("bytes")).otherwise(0))
    rows = rows.withColumn("stop", F.col("length") if most is None else F.least("length", F.col("first") + most)).where("stop > first")
    rows = rows.select("path", "modified", "first", "stop", F.explode(F.sequence("first", F.col("stop") - 1, F.lit(range_bytes))).alias("start"))
    ranges = rows.collect()  # like the listing of the files itself; from here on a file that grows changes nothing
    n = max(1, len(ranges))  # a number that is given: these few small rows would all come to one task

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _range_lines(r["path"], r["modified"], r["first"], r["start"], min(r["stop"], r["start"] + range_bytes))

    return spark.createDataFrame(ranges, rows.schema).repartitionByRange(n, "path", "start").mapInArrow(read, LINES).withColumn("v", F.try_parse_json("value"))


def first_lines(spark: SparkSession, folder: str, glob: str = "*.jsonl", most: int = 16 << 20) -> DataFrame:
    """path, value: the first line of each file that isn't empty. Tasks read a file up to its first line end and no further.

    Of a first line over `most` bytes only these are read.
    """

    def read(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                system, name = _opened(path)
                with system.open_input_file(name) as f:
                    line, piece = b"", b"."
                    while piece and len(line) < most and b"\n" not in line:
                        piece = f.read(8192)
                        line += piece
                if line:
                    rows.append((path, line.partition(b"\n")[0].decode("utf-8", "replace").rstrip("\r")))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["path", "value"])

    return files(spark, folder, glob).where("length > 0").select("path").mapInArrow(read, "path string, value string")


def progress(lines: DataFrame) -> DataFrame:
    """path, bytes: how far each file was read."""
    return lines.groupBy("path").agg(F.max("end").alias("bytes"))


@dataclass
class Range(InputPartition):
    path: str
    modified: object
    first: int
    start: int
    stop: int


class GrowingReader(DataSourceStreamReader):
    """Offsets are the bytes of each file up to the end of its last whole line: {path: bytes}, as the checkpoint's JSON.

    The files are listed where the query is planned, and of a file that has grown the tail is read back to its last line
    end; all lines are read by tasks.
    """

    def __init__(self, options: dict[str, str]):
        self.folder, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.range_bytes, self.ends = int(options.get("range_bytes", RANGE_BYTES)), {}

    def _files(self):
        from pyarrow import fs

        folder = self.folder if re.match(r"[a-zA-Z0-9+.-]+:/", self.folder) else f"file://{self.folder}"
        system, top = _opened(folder)
        head = folder[: folder.rfind(top.rstrip("/"))]
        for info in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.glob):
                yield head + info.path, info, system

    def _whole(self, system, name: str, size: int) -> int:
        """Where the last whole line of a file ends."""
        with system.open_input_file(name) as f:
            at = size
            while at > 0:
                start = max(0, at - (1 << 16))
                f.seek(start)
                found = f.read(at - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                at = start
        return 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        for path, info, system in self._files():
            if self.ends.get(path, (None, 0))[0] != info.size:
                self.ends[path] = (info.size, self._whole(system, info.path, info.size))
        return {path: end for path, (_, end) in sorted(self.ends.items()) if end}

    def partitions(self, start: dict, end: dict):
        when = {path: info.mtime for path, info, _ in self._files()}
        out = []
        for path, stop in end.items():
            first = start.get(path, 0) if start.get(path, 0) <= stop else 0
            out += [Range(path, when.get(path), first, at, min(stop, at + self.range_bytes)) for at in range(first, stop, self.range_bytes)]
        return out

    def read(self, partition: Range):
        yield from _range_lines(partition.path, partition.modified, partition.first, partition.start, partition.stop)


class GrowingLines(DataSource):
    """The stream source `growing_lines`; options path, glob, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> GrowingReader:  # noqa: N802
        return GrowingReader(dict(self.options))


def stream_lines(spark: SparkSession, folder: str, glob: str = "*.jsonl", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, modified, line, end, value, v: a stream of the lines of files that grow, each once."""
    spark.dataSource.register(GrowingLines)
    rows = spark.readStream.format("growing_lines").option("path", folder).option("glob", glob).option("range_bytes", str(range_bytes)).load()
    return rows.withColumn("v", F.try_parse_json("value"))
