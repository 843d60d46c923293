"""Benchmark decontamination with a distributed positional inverted index.

Training documents are indexed in segments of 2 MB of text: sorted terms, and for each term the places
where it stands. A segment answers a phrase by intersecting the places of its words, each less the
word's offset, from the word that is rarest in the segment on. Segments hold whole documents, so
hits of a document are complete where they are found.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import scratch
from lumenfold.llm.rolling import SEEDS, Words

SEGMENT_BYTES = 2 << 20
BLOCK_WINDOWS = 500_000
CANDIDATES = 500_000
# Bytes that are no word characters, in lower-cased text.
BETWEEN = np.zeros(256, dtype=bool)
BETWEEN[0x00:0x30] = BETWEEN[0x3A:0x61] = BETWEEN[0x7B:0x80] = True
SEGMENT_SCHEMA = (
    "seg long, doc_ids array<long>, n_words array<long>, n_terms long, n_places long, terms binary, counts binary, places binary"
)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of the positional index, one row each; every word of every text is in it.

    A place counts words through the segment and leaves one free after each document, so that no
    phrase runs over into the next. Null texts have no words. Terms are kept as 64-bit hashes.
    `seg` names a segment by chance: store the index before use.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scratch.text_slices(batches, limit=SEGMENT_BYTES):
            words = Words([_bytes(t) for t in batch.column("text").to_pylist()], BETWEEN)
            h = words.hashes(SEEDS[0])
            place = np.arange(len(h), dtype=np.int64) + words.text
            order = np.argsort(h, kind="stable")
            terms, counts = np.unique(h, return_counts=True)
            # Gaps inside a term pack well; the first place of a term is kept as it is.
            gaps = np.diff(place[order], prepend=0)
            first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(terms) else np.zeros(0, np.int64)
            gaps[first] = place[order][first]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(os.urandom(8), "little", signed=True)]),
                 pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([np.diff(words.first)[: batch.num_rows].tolist()], pa.list_(pa.int64())),
                 pa.array([len(terms)], pa.int64()), pa.array([len(h)], pa.int64()),
                 *(pa.array([_pack(a)], pa.binary()) for a in (terms.astype("<u8"), counts.astype("<u4"), gaps.astype("<u4")))],
                ["seg", "doc_ids", "n_words", "n_terms", "n_places", "terms", "counts", "places"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, SEGMENT_SCHEMA)


class Segment:
    """Postings of asked terms: `key` holds rank * stride + place, in order."""

    def __init__(self, row: dict, asked: np.ndarray):
        self.doc_ids, self.n_words = row["doc_ids"], np.array(row["n_words"], dtype=np.int64)
        # First place of each document; one place after each is free.
        self.starts = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        terms, counts = _unpack(row["terms"], "<u8", row["n_terms"]), _unpack(row["counts"], "<u4", row["n_terms"]).astype(np.int64)
        gaps = _unpack(row["places"], "<u4", row["n_places"]).astype(np.int64)
        ends = np.cumsum(counts)
        at = np.minimum(np.searchsorted(terms, asked), max(0, len(terms) - 1))
        here = (terms[at] == asked) if len(terms) else np.zeros(len(asked), bool)
        self.count = np.where(here, counts[at] if len(terms) else 0, 0)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.stride = int(self.starts[-1]) + 1
        took = np.flatnonzero(here)
        n = self.count[took]
        index = np.arange(self.first[-1]) - np.repeat(self.first[took], n) + np.repeat((ends - counts)[at[took]], n)
        total = np.cumsum(gaps)  # gaps start anew with each term
        base = total[(ends - counts)[at[took]]] - gaps[(ends - counts)[at[took]]]
        self.places = total[index] - np.repeat(base, n)
        self.key = np.repeat(took, n) * self.stride + self.places

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        want = term * self.stride + place
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return (place >= 0) & (place < self.stride) & (self.key[at] == want)

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of `windows`, first place) of every occurrence. A row holds the terms of a phrase."""
        n = self.count[windows]
        rows = np.flatnonzero((n > 0).all(axis=1))
        order = np.argsort(n[rows], axis=1, kind="stable")
        rarest = n[rows, order[:, 0]] if len(rows) else np.zeros(0, np.int64)
        cuts = np.searchsorted(np.cumsum(rarest), np.arange(CANDIDATES, rarest.sum() + CANDIDATES, CANDIDATES))
        low = 0
        for high in np.unique(np.append(cuts, len(rows))):
            part, by, m = rows[low:high], order[low:high], rarest[low:high]
            low = high
            if not len(part):
                continue
            term = windows[part, by[:, 0]]
            which = np.repeat(np.arange(len(part)), m)
            index = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.first[term], m)
            start = self.places[index] - by[which, 0]
            for k in range(1, windows.shape[1]):
                offset = by[which, k]
                stay = self.has(windows[part[which], offset], start + offset)
                which, start = which[stay], start[stay]
            if len(which):
                yield part[which], start

    def near(self, terms: np.ndarray, reach: int) -> np.ndarray:
        """Places of the rarest of `terms` with each other term at most `reach` words away, in one document."""
        n = self.count[terms]
        if not len(terms) or not (n > 0).all():
            return np.zeros(0, np.int64)
        rare = terms[np.argmin(n)]
        place = self.places[self.first[rare] : self.first[rare] + self.count[rare]]
        doc = np.searchsorted(self.starts, place, side="right") - 1
        low, high = np.maximum(place - reach, self.starts[doc]), np.minimum(place + reach, self.starts[doc + 1] - 1)
        stay = np.ones(len(place), dtype=bool)
        for term in terms:
            base = int(term) * self.stride
            stay &= np.searchsorted(self.key, base + high, side="right") > np.searchsorted(self.key, base + low)
        return place[stay]


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Test items as (id, word hashes), in blocks of a bounded number of windows. Items without words are left out."""
    block: list[tuple[str, np.ndarray]] = []
    size = 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").toLocalIterator():
        h = Words([_bytes(row["text"])], BETWEEN).hashes(SEEDS[0])
        if len(h):
            block.append((row["i"], h))
            size += len(h)
        if size > BLOCK_WINDOWS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _query(block: list[tuple[str, np.ndarray]], window: int) -> tuple[np.ndarray, list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Terms asked for, item ids, and for each length the phrases with their items."""
    terms = np.unique(np.concatenate([h for _, h in block]))
    by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
    for i, (_, h) in enumerate(block):
        width = min(window, len(h))
        ids = np.searchsorted(terms, h)
        rows = np.lib.stride_tricks.sliding_window_view(ids, width)
        by_length.setdefault(width, []).append((rows, i))
    groups = []
    for rows in by_length.values():
        groups.append((np.concatenate([r for r, _ in rows]), np.repeat([i for _, i in rows], [len(r) for r, _ in rows])))
    return terms, [name for name, _ in block], groups


def search(index: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(segment row, document number, spans, items): occurrences of each item's windows, for each block of items.

    Items go to the tasks in blocks of a bounded number of windows, each searched in every segment.
    Rows: doc_id, n_words, n_hit, item_ids, spans (first word, words) for every document and block,
    `doc` being the document's place in its segment.
    """
    spark = index.sparkSession
    schema = "seg long, doc int, doc_id long, n_words long, item_ids array<string>, spans array<struct<at:long,n:long>>"
    out = None
    for block in _item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(_query(block, window))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            terms, names, groups = shared.value
            for batch in batches:
                for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                    seg = Segment(row, terms)
                    hits = [(item[w], start, np.full(len(w), rows.shape[1])) for rows, item in groups for w, start in seg.phrases(rows)]
                    n = len(seg.doc_ids)
                    spans: list[list[dict]] = [[] for _ in range(n)]
                    items: list[list[str]] = [[] for _ in range(n)]
                    if hits:
                        item, start, width = (np.concatenate(c) for c in zip(*hits))
                        doc = np.searchsorted(seg.starts, start, side="right") - 1
                        for d, i in np.unique(np.stack([doc, item]), axis=1).T.tolist():
                            items[d].append(names[i])
                        cover = np.zeros(seg.stride + 1, dtype=np.int64)
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + width, -1)
                        edge = np.diff((np.cumsum(cover) > 0).view(np.int8), prepend=np.int8(0))
                        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                            d = int(np.searchsorted(seg.starts, a, side="right")) - 1
                            spans[d].append({"at": int(a - seg.starts[d]), "n": int(b - a)})
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["seg"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(seg.doc_ids, pa.int64()),
                         pa.array(seg.n_words), pa.array(items, pa.list_(pa.string())),
                         pa.array(spans, pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))],
                        ["seg", "doc", "doc_id", "n_words", "item_ids", "spans"])

        part = index.mapInArrow(find, schema)
        out = part if out is None else out.union(part).groupBy("seg", "doc", "doc_id", "n_words").agg(
            F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.flatten(F.collect_list("spans")).alias("spans"))
    if out is None:
        docs = index.select(F.inline(F.arrays_zip("doc_ids", "n_words"))).toDF("doc_id", "n_words")
        return docs.select("doc_id", "n_words", F.array().cast("array<string>").alias("item_ids"),
                           F.array().cast("array<struct<at:long,n:long>>").alias("spans"))
    return out.select("doc_id", "n_words", "item_ids", "spans")


def near(index: DataFrame, queries: list[list[str]], reach: int) -> DataFrame:
    """Proximity matches: (query, doc_id, at) for each place of a query's rarest word in a segment
    with all its other words at most `reach` words away in the same document."""
    asked = [Words([_bytes(" ".join(q))], BETWEEN).hashes(SEEDS[0]) for q in queries]
    terms = np.unique(np.concatenate(asked)) if asked else np.zeros(0, np.uint64)
    shared = index.sparkSession.sparkContext.broadcast((terms, [np.unique(np.searchsorted(terms, h)) for h in asked]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, lists = shared.value
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                seg = Segment(row, terms)
                out: list[tuple[int, int | None, int]] = []
                for q, ids in enumerate(lists):
                    for p in seg.near(ids, reach).tolist():
                        d = int(np.searchsorted(seg.starts, p, side="right")) - 1
                        out.append((q, seg.doc_ids[d], p - int(seg.starts[d])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())],
                    ["query", "doc_id", "at"])

    return index.mapInArrow(find, "query int, doc_id long, at long")


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Documents with the words that stand in an occurrence of a benchmark window.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window.
    Columns: doc_id, n_words, n_hit, n_items, items_sha256 (ids sorted as strings, comma-joined),
    contaminated, item_ids, spans (maximal runs of hit words: first word, words). Null texts have no
    words. Every row is a document of its own, whatever its doc_id; repeated item ids count once; a
    null item id is called null. Other columns are ignored. Without items nothing is contaminated.
    """
    with scratch.short_batches(docs.sparkSession):
        index = scratch.keep(build_index(docs))
    found = search(index, benchmark, window)
    hits = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["at"] + s["n"] - F.greatest(acc["to"], s["at"]))).alias("n"),
            F.greatest(acc["to"], s["at"] + s["n"]).alias("to")))["n"]
    ids = F.array_sort(F.array_distinct("item_ids"))
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
        ids.alias("item_ids"), "spans")
