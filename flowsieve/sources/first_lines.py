"""Files of a folder, and the first line of each of many files as a data source that reads no further."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIRST_STEP = 1 << 10  # bytes; doubled until a line break is found
LAST_STEP = 1 << 20
FILES_OF_TASK = 256


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below ``folder``, empty ones included; no content is read.

    Spark's scans pass empty files over, so names come from its file index, which the driver holds in any case.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    # the index writes file:///a%20b where the column has file:/a b
    names = [(unquote(re.sub(r"^([^:/]+):///", r"\1:/", uri)),) for uri in files.inputFiles()]
    listed = spark.createDataFrame(names, "path string").join(files.select("path", "length"), "path", "left")
    return listed.select("path", F.coalesce("length", F.lit(0)).alias("length"))


def open_stream(path: str):
    """Byte stream of one file on any file system that pyarrow knows and the workers can reach.

    ``path`` is written as Spark's readers take it, with blanks, percent signs and the like as they are.
    """
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", path)
    if "://" not in uri:
        uri = "file://" + uri
    place, name = re.fullmatch(r"([^:]+://[^/]*)(.*)", uri, re.DOTALL).groups()
    filesystem, inner = fs.FileSystem.from_uri(place + quote(name))
    return filesystem.open_input_stream(inner)


def first_line(stream, step: int = FIRST_STEP) -> tuple[bytes, int]:
    """(first line without its break, bytes read) of a byte stream; a file without a break is one line."""
    held, size = [], 0
    while part := stream.read(step):
        held.append(part)
        size += len(part)
        if b"\n" in part or b"\r" in part:
            break
        step = min(2 * step, LAST_STEP)
    return re.split(rb"[\r\n]", b"".join(held), maxsplit=1)[0], size


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_Files(self.paths[k : k + FILES_OF_TASK]) for k in range(0, len(self.paths), FILES_OF_TASK)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            with open_stream(path) as stream:
                line, size = first_line(stream)
            yield path, line.decode("ISO-8859-1"), size


class FirstLines(DataSource):
    """(path, first_line, bytes_read) of the files that the option ``paths`` lists as a JSON array; Latin-1 text."""

    @classmethod
    def name(cls) -> str:
        return "first_lines"

    def schema(self) -> str:
        return "path string, first_line string, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]))


def read_first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(FirstLines)
    return spark.read.format("first_lines").option("paths", json.dumps(paths)).load()
