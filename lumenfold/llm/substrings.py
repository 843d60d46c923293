"""Removal of repeated word windows, with a count-min prefilter.

Pass one folds every partition's windows into a sparse count-min sketch and merges the sketches;
a window is counted by its anchor (see `rolling`), which never counts less than the window itself.
Pass two emits only windows estimated to occur twice, and groups them exactly. No window that
repeats is lost: the sketch only overestimates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm import scratch
from lumenfold.llm.rolling import SEEDS, Windows, Words, anchors, mix

GRAM = 5
DEPTH = 3
STRIPE_BITS = 22
# The merged sketch is sent to the tasks as one bit a cell: 3 * 2**27 bits are 48 MB. Beyond that
# input (some 3 TB of text at two cells a window anchor) it prunes less, and results stay exact.
MAX_WIDTH_BITS = 27
FLUSH = 4 << 20
NO_ID = -(1 << 63)
LOW = (1 << 32) - 1


def _row_cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    salted = mix(values + np.uint64((row + 1) * SEEDS[1] & (1 << 64) - 1))
    return (salted >> np.uint64(64 - bits)).astype(np.int64)


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    gaps = np.diff(cells, prepend=0).astype("<u4").tobytes()
    return pa.compress(gaps + counts.astype(np.uint8).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(blob, 5 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64), np.frombuffer(raw, np.uint8, n, 4 * n)


class Sketch:
    """A count-min sketch in stripes of cells; counters stop at 255."""

    def __init__(self, width_bits: int):
        self.bits = width_bits
        self.stripe = min(STRIPE_BITS, width_bits)

    def parts(self, values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(stripe, cells, counters) of a partition's sketch."""
        for row in range(DEPTH):
            cells, counts = np.unique(_row_cells(values, row, self.bits), return_counts=True)
            counts = np.minimum(counts, 255)
            stripes = cells >> self.stripe
            cuts = np.flatnonzero(np.diff(stripes, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(cells)]):
                where = int(stripes[a]) + (row << (self.bits - self.stripe))
                yield where, int(b - a), _pack(cells[a:b] & ((1 << self.stripe) - 1), counts[a:b])


def _merge(parts: DataFrame, stripe_bits: int, *, final: bool) -> DataFrame:
    """Adds up sketches of the same stripe, one at a time; the last round keeps the bits of cells with 2 or more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(1 << stripe_bits, dtype=np.uint8)

        def done() -> pa.RecordBatch:
            if final:
                n, blob = 0, np.packbits(total >= 2, bitorder="little").tobytes()
            else:
                cells = np.flatnonzero(total)
                n, blob = len(cells), _pack(cells, total[cells])
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())],
                ["stripe", "part", "n", "counters"])

        for batch in batches:
            for stripe, part, n, blob in zip(*(batch.column(c).to_pylist() for c in ("stripe", "part", "n")), batch.column("counters")):
                if (stripe, part) != at:
                    if at is not None:
                        yield done()
                    at = (stripe, part)
                    total[:] = 0
                cells, counts = _unpack(blob.as_py(), n)
                total[cells] = np.minimum(total[cells].astype(np.uint16) + counts, 255)
        if at is not None:
            yield done()

    keyed = parts.repartition("stripe", "part").sortWithinPartitions("stripe", "part")
    return keyed.mapInArrow(add, parts.schema)


def _word_grams(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, the first-seed word hashes, and which windows lie in one text."""
    h = words.hashes(SEEDS[0])
    gram = min(GRAM, window)
    grams = mix(Windows(h, SEEDS[1]).all(gram)) | np.uint64(1)
    n = max(0, len(h) - window + 1)
    return grams, h, words.text[:n] == words.text[window - 1 : window - 1 + n]


def sketch_windows(docs: DataFrame, window: int, total_bytes: int) -> tuple[np.ndarray, int]:
    """Bits of the cells counted twice or more, all rows one after the other, and the width in bits."""
    bits = min(MAX_WIDTH_BITS, max(16, math.ceil(math.log2(max(1, total_bytes / 24)))))
    sketch = Sketch(bits)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            rows = list(sketch.parts(np.concatenate(held)))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([rows[0][1] % 8] * len(rows), pa.int32()),
                 pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                ["stripe", "part", "n", "counters"])

        for batch in scratch.text_slices(batches):
            words = Words([t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist() if t])
            if len(words.starts) < window:
                continue
            grams, _, valid = _word_grams(words, window)
            _, at = anchors(grams, window - min(GRAM, window) + 1, valid)
            if len(at):
                held.append(grams[at])
            if sum(map(len, held)) > FLUSH:
                yield flush()
        if held:
            yield flush()

    parts = docs.select("text").mapInArrow(fold, "stripe int, part int, n long, counters binary")
    merged = _merge(parts, sketch.stripe, final=False).withColumn("part", F.lit(0))
    out = np.zeros(DEPTH << (bits - 3), dtype=np.uint8)
    size = 1 << (sketch.stripe - 3)
    # At most DEPTH * 2**MAX_WIDTH_BITS bits.
    for row in _merge(merged, sketch.stripe, final=True).toLocalIterator():
        out[row["stripe"] * size : (row["stripe"] + 1) * size] = np.frombuffer(row["counters"], np.uint8)
    return out, bits


def _estimated_twice(values: np.ndarray, seen: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(values), dtype=bool)
    for row in range(DEPTH):
        cell = _row_cells(values, row, bits) + (row << bits)
        out &= (seen[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _runs(doc: np.ndarray, tag: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive tags of a document as (doc, first tag, high, number)."""
    if not len(doc):
        return doc, tag, high, tag
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(tag) != 1) | (np.diff(high) != 0)]))
    return doc[cut], tag[cut], high[cut], np.diff(np.append(cut, len(doc)))


def repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """(_d, _t, _e, spans): for each document, runs of window starts (place, number) that repeat an earlier window.

    `docs` has _d (id), _h (hash of the text) and text; _t and _e are the low and the high half of _h. Windows are grouped by 96 bits of hash. Of equal windows in one batch of a task only
    the first can be the earliest of all; the others are known to repeat and travel as runs. So a
    window that a third of all documents share reaches its group once for each batch.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    seen, bits = sketch_windows(docs, window, total)
    shared = docs.sparkSession.sparkContext.broadcast(seen)
    span = window - min(GRAM, window) + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_d", "_h"))
            order = np.lexsort((hashes, ids))
            fresh = np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(hashes[order]) != 0)]) if len(order) else []
            found: list[tuple[np.ndarray, ...]] = []
            for part in scratch.text_slices(iter([batch.take(pa.array(order[fresh]))])):
                ids, hashes = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_d", "_h"))
                words = Words([(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()])
                if len(words.starts) < window:
                    continue
                grams, h, valid = _word_grams(words, window)
                least, _ = anchors(grams, span, valid)
                change = np.flatnonzero(np.diff(least, prepend=~least[:1]))
                twice = np.repeat(_estimated_twice(least[change], shared.value, bits), np.diff(np.append(change, len(least))))
                at = np.flatnonzero(twice & valid)
                if len(at):
                    one, two = Windows(h, SEEDS[0]), Windows(words.hashes(SEEDS[1]), SEEDS[1])
                    text = words.text[at]
                    place = (at - words.first[text]).astype(np.uint64)
                    tag = (hashes[text].view(np.uint64) << np.uint64(32) | place).view(np.int64)
                    high = (hashes[text] >> 32).astype(np.int32)
                    found.append((mix(one.ranges(at, at + window)), mix(two.ranges(at, at + window)), ids[text], tag, high))
            if not found:
                continue
            w1, w2, doc, tag, high = (np.concatenate(c) for c in zip(*found))
            _, first, back = np.unique(w1, return_index=True, return_inverse=True)
            again = (first[back] != np.arange(len(w1))) & (w2[first[back]] == w2)
            d, t, e, n = _runs(doc[again], tag[again], high[again])
            go = ~again
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([w1[go].view(np.int64), mix(d.view(np.uint64)).view(np.int64)])),
                 pa.array(np.concatenate([(w2[go] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.zeros(len(d), np.int32)])),
                 pa.array(np.concatenate([doc[go], d])), pa.array(np.concatenate([tag[go], t])), pa.array(np.concatenate([high[go], e])),
                 pa.array(np.concatenate([np.zeros(go.sum(), np.int32), n.astype(np.int32)]))],
                ["w1", "w2", "doc", "tag", "high", "n"])

    rows = docs.select("_d", "_h", "text").mapInArrow(emit, "w1 long, w2 int, doc long, tag long, high int, n int")
    me = F.struct("doc", "tag", "high")
    least = F.min(F.when(F.col("n") == 0, me)).over(Window.partitionBy("w1", "w2"))
    again = rows.withColumn("_first", least).filter((F.col("n") > 0) | (F.col("_first") != me))
    return again.groupBy(F.col("doc").alias("_d"), F.shiftrightunsigned("tag", 32).alias("_t"), F.col("high").alias("_e")).agg(F.collect_list(F.struct(
        F.col("tag").bitwiseAND(F.lit(LOW)).alias("at"), F.greatest("n", F.lit(1)).alias("n"))).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Documents without words covered by a window that also starts earlier.

    Earlier is: smaller doc_id, or the same document and a smaller place; windows are judged on the
    input. Columns: doc_id, n_words, n_removed, kept_text (kept words joined by one space; null
    texts have none), kept_sha256. Words lie between ASCII white space, unchanged. Rows that repeat
    doc_id and text are one document and share the result; rows that repeat only the doc_id are
    ordered by a hash of the text. A null doc_id is before any other. Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"),
        F.xxhash64("text").alias("_h"), "text")
    spans = repeated_windows(rows, window)
    halves = {"_t": F.col("_h").bitwiseAND(F.lit(LOW)), "_e": F.shiftright("_h", 32).cast("int")}
    joined = rows.withColumns(halves).drop("_h").join(spans, ["_d", "_t", "_e"], "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scratch.text_slices(batches, limit=2 << 20):
            n_words, n_removed, kept, sha = [], [], [], []
            flat = batch.column("spans")
            for text, spans in zip(batch.column("text").to_pylist(), flat):
                words = (text or "").encode("utf-8", "surrogatepass").translate(_WHITE).split()
                n_words.append(len(words))
                if spans.is_valid:
                    at, n = (spans.values.field(k).to_numpy() for k in (0, 1))
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + n - 1 + window, -1)
                    stay = np.cumsum(cover[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                n_removed.append(n_words[-1] - len(words))
                joined_words = b" ".join(words)
                kept.append(joined_words)
                sha.append(hashlib.sha256(joined_words).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return joined.select("doc_id", "text", "spans").mapInArrow(
        apply, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


_WHITE = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)
