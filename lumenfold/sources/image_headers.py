"""Width and height of image files from their headers: the format `image_headers`.

PNG, JPEG, GIF and WebP say their size in the first segments. A file is read in small ranges, as many
as its header needs and never more than `max_bytes` of them; pixels are neither read nor decoded.
Paths are local, shared or of any store that pyarrow opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lumenfold.sources.json_object import list_files, open_store

SCHEMA = "path string, format string, width int, height int, bytes_read bigint, problem string"
FILES_PER_TASK = 2000
MAX_BYTES = 1 << 20
STEP = 512
# Markers of JPEG segments that carry a size, and of those that stand alone.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
ALONE = {0x01, *range(0xD0, 0xD9)}


class Unreadable(ValueError):
    """A file that is no image of a known kind, or whose header is broken or cut short."""


class Ranges:
    """Bytes of a file by position, read in steps; counts what was read."""

    def __init__(self, stream, max_bytes: int):
        self.stream, self.left, self.count = stream, max_bytes, 0
        self.start, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            size = max(n, STEP)
            if self.left < size:
                raise Unreadable("header too long")
            self.stream.seek(at)
            self.start, self.data = at, self.stream.read(size)
            self.left -= size
            self.count += len(self.data)
        found = self.data[at - self.start : at - self.start + n]
        if len(found) < n:
            raise Unreadable("file cut short")
        return found

    def number(self, at: int, n: int, order: str = "big") -> int:
        return int.from_bytes(self.get(at, n), order)


def _png(f: Ranges) -> tuple[int, int]:
    if f.get(12, 4) != b"IHDR":
        raise Unreadable("no image header")
    return f.number(16, 4), f.number(20, 4)


def _gif(f: Ranges) -> tuple[int, int]:
    return f.number(6, 2, "little"), f.number(8, 2, "little")


def _jpeg(f: Ranges) -> tuple[int, int]:
    at = 2
    while True:
        if f.number(at, 1) != 0xFF:
            raise Unreadable("no marker where a segment should start")
        while (marker := f.number(at + 1, 1)) == 0xFF:  # fill bytes
            at += 1
        if marker in FRAMES:
            return f.number(at + 7, 2), f.number(at + 5, 2)
        if marker in (0xD9, 0xDA):
            raise Unreadable("no frame before the pixels")
        at += 2 if marker in ALONE else 2 + f.number(at + 2, 2)


def _webp(f: Ranges) -> tuple[int, int]:
    kind = f.get(12, 4)
    if kind == b"VP8X":
        return 1 + f.number(24, 3, "little"), 1 + f.number(27, 3, "little")
    if kind == b"VP8L":
        if f.get(20, 1) != b"\x2f":
            raise Unreadable("no image header")
        bits = f.number(21, 4, "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 ":
        if f.get(23, 3) != b"\x9d\x01\x2a":
            raise Unreadable("no image header")
        return f.number(26, 2, "little") & 0x3FFF, f.number(28, 2, "little") & 0x3FFF
    raise Unreadable("unknown kind of image")


def read_size(f: Ranges) -> tuple[str, int, int]:
    """(format, width, height) of one file."""
    head = f.get(0, 12)
    if head.startswith(b"\x89PNG\r\n\x1a\n"):
        kind, size = "png", _png(f)
    elif head.startswith(b"\xff\xd8"):
        kind, size = "jpeg", _jpeg(f)
    elif head[:6] in (b"GIF87a", b"GIF89a"):
        kind, size = "gif", _gif(f)
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        kind, size = "webp", _webp(f)
    else:
        raise Unreadable("unknown kind of image")
    if not all(0 < n < 1 << 31 for n in size):
        raise Unreadable("no size")
    return kind, *size


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ImageHeaders(DataSource):
    """Options: path (a file or a folder); `files_per_task`; `max_bytes` of one file's header."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(self.options)


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.per_task = int(options.get("files_per_task", FILES_PER_TASK))
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        paths = [p for p, _ in list_files(self.path)]
        return [Files(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(self.path)
        rows = []
        for path in partition.paths:
            row = {"path": path, "format": None, "width": None, "height": None, "problem": None}
            with fs.open_input_file(path) as stream:
                f = Ranges(stream, self.max_bytes)
                try:
                    row["format"], row["width"], row["height"] = read_size(f)
                except Unreadable as why:
                    row["problem"] = str(why)
            rows.append(row | {"bytes_read": f.count})
        schema = pa.schema([
            ("path", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()),
            ("bytes_read", pa.int64()), ("problem", pa.string())])
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_headers(spark: SparkSession, path: str, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """`path, format, width, height, bytes_read, problem`, one row a file; an unreadable one says why."""
    spark.dataSource.register(ImageHeaders)
    return spark.read.format("image_headers").option("path", path).option("files_per_task", files_per_task).load()


# Tasks need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
