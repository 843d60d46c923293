"""WARC archives: a PySpark Python data source, and writing pages with revisit records.

`register(spark)` adds the format `warc`. Reading plans one partition for each group of archive
files, takes predicates on the record type and on header columns into the reader, parses a record's
headers first, and steps over the block of an unwanted record, or of any record if the query's
schema has no payload, without decoding it. Files are plain WARC/1.1, or gzip with a member for
each record; both are read. Writers give every attempt its own file and the commit names the files
that count, so a lost or repeated task leaves no record twice.

Paths are local, shared or of any store that pyarrow opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, "
    "content_length long, http_length long, payload binary"
)
# Columns that are a header each.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_files.json"
ROLL_BYTES = 32 << 20
BATCH_BYTES = 8 << 20


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def archive_files(path: str) -> list[tuple[str, int]]:
    """Committed files under a folder, all archives of a folder without a commit list, or one file."""
    fs, root = open_store(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    found = {i.base_name: i for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File}
    if MANIFEST in found:
        with fs.open_input_stream(found[MANIFEST].path) as f:
            names = json.loads(f.read())
    else:
        names = sorted(n for n in found if re.search(r"\.warc(\.gz)?$", n))
    return [(found[n].path, found[n].size) for n in names]


class WarcError(ValueError):
    """A file that is not an archive, or a payload that does not match its digest."""


def _header_lines(stream) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def records(stream, wanted, with_block) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block of the wanted records; blocks are read only where `with_block` says so."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise WarcError(f"not a WARC record: {line[:40]!r}")
        head = _header_lines(stream)
        length = int(head.get("content-length", 0))
        if wanted(head):
            block = stream.read(length) if with_block(head) else None
            if block is None:
                stream.seek(length, io.SEEK_CUR)
            elif len(block) < length:
                raise WarcError("record cut short")
            yield head, block
        else:
            stream.seek(length, io.SEEK_CUR)


class WarcSource(DataSource):
    """Options: path; `header.<name>` = a value that a header must have; `verify` = true checks digests
    of payloads that are read; `compress` = gzip on writing; `roll_bytes` for files and partitions."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path = options["path"]
        self.columns = columns
        self.verify = options.get("verify", "false").lower() == "true"
        self.group_bytes = int(options.get("roll_bytes", ROLL_BYTES))
        self.equal = {k[len("header."):].lower(): {v} for k, v in dict(options).items() if k.lower().startswith("header.")}
        self.starts: list[tuple[str, str]] = []
        self.present: set[str] = set()

    def pushFilters(self, filters):
        """Takes =, IN, IS NOT NULL and prefixes on header columns; all others stay with Spark."""
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if len(f.attribute) == 1 else None if hasattr(f, "attribute") else None
            if name and isinstance(f, EqualTo):
                self._allow(name, {f.value})
            elif name and isinstance(f, In):
                self._allow(name, set(f.value))
            elif name and isinstance(f, StringStartsWith):
                self.starts.append((name, f.value))
            elif name and isinstance(f, IsNotNull):
                self.present.add(name)
            else:
                yield f

    def _allow(self, name: str, values: set) -> None:
        self.equal[name] = self.equal[name] & values if name in self.equal else values

    def partitions(self):
        groups: list[list[str]] = []
        room = 0
        for path, size in archive_files(self.path):
            if not groups or room < size:
                groups.append([])
                room = self.group_bytes
            groups[-1].append(path)
            room -= size
        return [InputPartition(g) for g in groups] or [InputPartition([])]

    def wanted(self, head: dict[str, str]) -> bool:
        return (
            all(head.get(n) in v for n, v in self.equal.items())
            and all(head.get(n, "").startswith(v) for n, v in self.starts)
            and all(n in head for n in self.present)
        )

    def read(self, partition):
        # HTTP parts are looked at only for the columns that need them.
        blocks = {"payload", "http_length"} & set(self.columns) or self.verify
        is_http = lambda h: bool(blocks) and h.get("content-type", "").startswith("application/http")
        plain = lambda h: bool({"payload"} & set(self.columns)) and "content-type" in h
        schema = pa.schema([(c, _ARROW.get(c, pa.string())) for c in self.columns])
        rows: list[list] = [[] for _ in self.columns]
        held = 0
        fs, _ = open_store(self.path)
        for path in partition.value:
            raw = fs.open_input_file(path)
            stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
            for head, block in records(stream, self.wanted, lambda h: is_http(h) or plain(h)):
                row = {c: head.get(h) for c, h in HEADERS.items()}
                row |= {"content_length": int(head.get("content-length", 0)), "http_length": None, "payload": None}
                if block is not None and is_http(head):
                    inner = io.BytesIO(block)
                    inner.readline()
                    http = _header_lines(inner)
                    row["http_length"] = int(http["content-length"]) if "content-length" in http else None
                    if head.get("warc-type") != "revisit":
                        row["payload"] = inner.read()
                        if self.verify and row["payload_digest"] not in (None, "sha1:" + base32_sha1(row["payload"])):
                            raise WarcError(f"payload of {row['record_id']} does not match its digest")
                elif block is not None:
                    row["payload"] = block
                for k, c in enumerate(self.columns):
                    rows[k].append(row[c])
                held += 200 + len(row["payload"] or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict(dict(zip(self.columns, rows)), schema=schema)
                    rows, held = [[] for _ in self.columns], 0
            stream.close()
        if rows and rows[0]:
            yield pa.RecordBatch.from_pydict(dict(zip(self.columns, rows)), schema=schema)


_ARROW = {"content_length": pa.int64(), "http_length": pa.int64(), "payload": pa.binary()}


def _clean(value: str) -> str:
    """One header line: control characters and line ends are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(row: dict) -> bytes:
    """A response or revisit record. A revisit keeps the HTTP head, whose length is that of the full payload."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['http_length']}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Date: {row['warc_date']}"]
    for name, key in (("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to")):
        if row[key] is not None:
            head.append(f"{name}: {_clean(row[key])}")
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {IDENTICAL}")
    head += [f"WARC-Payload-Digest: {row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcMessage(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        self.gzip = options.get("compress", "none").lower() == "gzip"
        self.roll = int(options.get("roll_bytes", ROLL_BYTES))
        self.overwrite = overwrite

    def write(self, iterator) -> WarcMessage:
        fs, root = open_store(self.path)
        fs.create_dir(root, recursive=True)
        names: list[str] = []
        out = None
        for batch in iterator:
            for row in batch.to_pylist():
                if row["payload_digest"] is None:
                    row["payload_digest"] = "sha1:" + base32_sha1(row["payload"] or b"")
                elif not row["payload_digest"].startswith("sha1:"):
                    row["payload_digest"] = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
                if row["http_length"] is None:
                    row["http_length"] = len(row["payload"] or b"")
                data = record_bytes(row)
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out = fs.open_output_stream(f"{root}/{names[-1]}", compression=None)
                out.write(gzip.compress(data, 6, mtime=0) if self.gzip else data)
                if out.tell() >= self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return WarcMessage(names)

    def commit(self, messages) -> None:
        fs, root = open_store(self.path)
        fs.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m for n in m.names)
        if not self.overwrite and fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                names = sorted({*names, *json.loads(f.read())})
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages) -> None:
        fs, root = open_store(self.path)
        for m in messages:
            for n in m.names if m else []:
                fs.delete_file(f"{root}/{n}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """Records of archives. `columns` limits what is parsed: without `payload`, blocks are stepped over."""
    register(spark)
    schema = StructType.fromDDL(SCHEMA)
    if columns:
        schema = StructType([schema[c] for c in columns])
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def page_records(pages: DataFrame, min_bytes: int = 0, warc_date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record for each page; of equal payloads, the smallest page_id is the response, the rest revisit it.

    Payloads under `min_bytes` are all responses. A null html is an empty payload. Rows that repeat
    the smallest page_id with the same payload are all responses. A null page_id is larger than any
    other, and its record's id says null. Other columns are ignored.
    """
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), raw.alias("payload"))
    rows = rows.withColumns({"http_length": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    same = rows.groupBy("payload_digest", "http_length").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = same.filter((F.col("_n") > 1) & (F.col("http_length") >= min_bytes)).drop("_n")
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(firsts, ["payload_digest", "http_length"], "left").select(
        named("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.lit(warc_date).alias("warc_date"), F.when(revisit, named("_first")).alias("refers_to"), "payload_digest",
        F.octet_length("payload").cast("long").alias("content_length"), "http_length",
        F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(rows: DataFrame, path: str, **options: str) -> None:
    """Writes records with the columns of SCHEMA. A digest is hex or sha1:BASE32; null ones are computed."""
    register(rows.sparkSession)
    rows.select(*StructType.fromDDL(SCHEMA).names).write.format("warc").mode("append").options(**options).save(path)


def page_digests(found: DataFrame) -> DataFrame:
    """Digest columns of records read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return found.select(
        number("record_id").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), F.col("http_length")).alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
