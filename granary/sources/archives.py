"""Members of zip archives as a data source: a partition for each member and range of its lines, read as streams."""

from __future__ import annotations

import csv
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a member that one partition turns into rows, bytes read at once, rows handed on at once.
RANGE, STEP, ROWS = 64 << 20, 1 << 20, 5000
SCHEMA = "file string, member string, line long, cells map<string,string>"
_ARROW = pa.schema([("file", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])


def opened(path: str):
    """A file that can be read at any place, on whatever store its URI names."""
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    if "://" not in uri:
        return pa.fs.LocalFileSystem().open_input_file(uri)
    files, name = pa.fs.FileSystem.from_uri(uri)
    return files.open_input_file(name)


def decoded(raw: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


class Range(InputPartition):
    def __init__(self, file: str, member: str, start: int, end: int):
        self.file, self.member, self.start, self.end = file, member, start, end


def lines_of(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The number and bytes of each line that begins in a range of a stream, and line 0, the head. What comes before the range is
    unpacked and its lines counted, but none of it is kept."""
    at, number, rest = 0, 0, b""  # `rest` is the beginning of line `number`, which begins at `at`
    while at < end:
        block = stream.read(STEP)
        if not block:
            if rest and (number == 0 or start <= at):
                yield number, rest
            return
        pieces = (rest + block).split(b"\n")
        rest = pieces.pop()
        for piece in pieces:
            if at >= end:
                return
            if number == 0 or at >= start:
                yield number, piece
            at += len(piece) + 1
            number += 1


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.ending = json.loads(options["files"]), options.get("member", "").lower()
        self.range, self.separator = int(options.get("range", RANGE)), options.get("separator", "\t")

    def partitions(self) -> list[Range]:
        made = []
        for file in self.files:
            with opened(file) as raw, zipfile.ZipFile(raw) as z:
                for info in z.infolist():
                    if not info.is_dir() and info.filename.lower().endswith(self.ending):
                        made += [Range(file, info.filename, a, a + self.range) for a in range(0, max(info.file_size, 1), self.range)]
        return made

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        head, separator, rows = [], self.separator, []
        with opened(part.file) as raw, zipfile.ZipFile(raw) as z, z.open(part.member) as stream:
            for number, line in lines_of(stream, part.start, part.end):
                text = decoded(line.rstrip(b"\r"))
                if number == 0:
                    text = text.removeprefix("﻿")
                    if separator == "auto":  # tab or comma, whichever the head has more of
                        separator = "\t" if text.count("\t") >= text.count(",") else ","
                cells = next(csv.reader([text]), []) if separator == "," else text.split(separator)
                cells = [c.strip() for c in cells]
                if number == 0:
                    head = [c.upper() for c in cells]
                    continue
                rows.append((part.file, part.member, number - 1, list(dict(zip(head, [*cells, *[""] * len(head)], strict=False)).items())))
                if len(rows) == ROWS:
                    yield self.batch(rows)
                    rows = []
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ArchiveSource(DataSource):
    """spark.read.format("zipped_lines") with options files (a JSON list), member (the end of its name, any case), separator (one
    character, or auto) and range (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "zipped_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a path with wildcards names, on any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    held = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(x.getPath().toString() for x in held if x.isFile())


def zipped_lines(spark: SparkSession, pattern: str, member: str, separator: str = "\t", size: int = RANGE) -> DataFrame:
    """(file, member, line, cells) of the members whose names end in `member` (any case): cells maps upper-case column names to
    trimmed texts, "" for missing ones. A line of quoted values may not hold a line break."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("zipped_lines").option("files", json.dumps(found(spark, pattern))).option("member", member).option("separator", separator).option("range", str(size)).load()
