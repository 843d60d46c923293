"""Best-fit packing by length-histogram planning.

The plan is made from counts of pieces by length, never from pieces: sequences with the same room
left are one entry, and a length with n pieces takes whole entries, smallest sufficient room first.
The plan's size depends on the capacity alone. Pieces then take planned slots by their rank within
their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import scratch, tokens

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Slots(NamedTuple):
    """Pieces of `length` with ranks from `rank` on: `per` to a sequence, sequences from `sequence` on."""

    length: int
    rank: int
    sequence: int
    per: int
    offset: int


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of encoded documents, each text followed by `end_id`; null texts are empty.

    Only documents over `capacity` tokens are cut, into pieces of `capacity` and a rest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokens.read_tokenizer(tokenizer_path))
    end, width = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(shared.value).encode
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    doc.append(i), piece.append(k // width), start.append(k // 4)
                    length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA)


def plan(counts: dict[int, int], capacity: int) -> list[Slots]:
    """Best-fit decreasing over counts. Sequences are numbered from 0."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences (first, number)
    sizes: list[int] = []  # rooms with sequences, ascending
    out: list[Slots] = []
    opened = 0

    def put(left: int, first: int, number: int) -> None:
        if left > 0:
            if left not in room:
                room[left] = []
                insort(sizes, left)
            room[left].append((first, number))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        rank, rest = 0, counts[length]
        while rest and (at := bisect_left(sizes, length)) < len(sizes):
            left = sizes[at]
            first, number = room[left].pop()
            if not room[left]:
                del room[left]
                sizes.pop(at)
            # What fits once more is the best fit again, so a sequence takes all it can.
            per = left // length
            take = min(number, rest // per)
            if take:
                out.append(Slots(length, rank, first, per, capacity - left))
                put(left - per * length, first, take)
                rank, rest = rank + take * per, rest - take * per
            if take < number:
                if rest and rest < per:
                    out.append(Slots(length, rank, first + take, rest, capacity - left))
                    put(left - rest * length, first + take, 1)
                    take, rank, rest = take + 1, rank + rest, 0
                if take < number:
                    put(left, first + take, number - take)
        if rest:
            per = capacity // length
            full, tail = divmod(rest, per)
            if full:
                out.append(Slots(length, rank, opened, per, 0))
                put(capacity - per * length, opened, full)
                rank, opened = rank + full * per, opened + full
            if tail:
                out.append(Slots(length, rank, opened, tail, 0))
                put(capacity - tail * length, opened, 1)
                opened += 1
    return out


def place(ranked: DataFrame, slots: list[Slots], rank: str = "_rank") -> DataFrame:
    """Adds sequence_id and offset: the plan row of a piece is the last of its length not above its rank."""
    spark = ranked.sparkSession
    if not slots:
        return ranked.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    rows = sorted(slots)
    shared = spark.sparkContext.broadcast(np.array(rows, dtype=np.int64))
    at = ranked.columns

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        key = (p[:, 0] << 44) + p[:, 1]
        for batch in batches:
            length = batch.column(at.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            r = batch.column(at.index(rank)).to_numpy(zero_copy_only=False).astype(np.int64)
            row = p[np.searchsorted(key, (length << 44) + r, side="right") - 1]
            n, per = r - row[:, 1], row[:, 3]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(row[:, 2] + n // per), pa.array(row[:, 4] + n % per * length)],
                [*at, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    return ranked.mapInArrow(take, StructType([*ranked.schema, *StructType().add("sequence_id", LongType()).add("offset", LongType())]))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces with their sequence and offset.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are
    one piece with the end id alone. Repeated rows and doc_ids are packed each for themselves; a
    null doc_id stays null. Other columns are ignored. An empty table gives no rows.
    """
    pieces = scratch.keep(cut_documents(docs, tokenizer_path, capacity, end_id))
    # At most `capacity` rows, whatever the size of the input.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.coalesce("doc_id", F.lit(-1)), "piece", "ids_crc32"]
    ranked = scratch.positions(pieces, ["length"], order, sum(counts.values()), "_rank")
    return place(ranked, plan(counts, capacity)).drop("_rank")
