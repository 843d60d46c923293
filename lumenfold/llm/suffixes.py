"""Removal of long repeated byte strings by suffix arrays over shards of candidate text.

Each `length`-byte window belongs to the run of neighbouring windows with the same anchor (see
`rolling`); equal windows have equal anchors, so runs meet their partners by anchor. Runs equal as
a whole are one run with a count. Where an anchor has different runs, their text goes to the
anchor's shard, and an externally sorted suffix array with common-prefix lengths (`induced`) tells
which windows repeat. An anchor whose different runs fill a shard by themselves is not sorted: its
windows are grouped by their content, over all tasks. Runs whose anchor stands nowhere else are never moved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenfold.llm import induced, scratch
from lumenfold.llm.rolling import anchors, byte_values, mix, packed, SEEDS, Windows

GRAM = 32
SHARD_BYTES = 3 << 19
SORTS = 4  # shards a task sorts one by one: a sort takes some hundred bytes for each of text
SLICE_BYTES = 1 << 18  # each byte takes some hundred in the arrays of `_runs`
LOW = (1 << 32) - 1


def _runs(texts: list[bytes], length: int):
    """(text, first byte, windows, anchor, hash of the run's bytes, may repeat itself) of the runs of all texts.

    Equal windows of one run have their anchors at different places, so a run can repeat itself only
    where its anchor stands twice within reach."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    gram = min(GRAM, length)
    w = Windows(byte_values(SEEDS[0] & 0xFFFF)[data], SEEDS[0])
    # Windows that reach over a text's end have no anchor.
    cover = np.zeros(n + 1, dtype=np.int8)
    stops = np.clip(ends - length + 1, 0, n)
    begins = ends - sizes
    np.add.at(cover, np.clip(np.maximum(stops, begins), 0, n), 1)
    np.add.at(cover, np.clip(ends + 1, 0, n), -1)
    valid = np.cumsum(cover[:-1]) == 0
    grams, span = mix(w.all(gram)) | np.uint64(1), length - gram + 1
    least, place = anchors(grams, span, valid)
    least = np.where(valid, least[:n], 0)
    order = np.argsort(grams[place], kind="stable")
    value, place = grams[place][order], place[order]
    twice = np.unique(value[1:][(value[1:] == value[:-1]) & (np.diff(place) <= span)])
    cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    number = np.diff(np.append(cut, n))
    ok = least[cut] != 0
    start, number = cut[ok], number[ok]
    text = np.searchsorted(ends, start, side="left")
    size = number - 1 + length
    # Eight bytes at a time through the finaliser: of single bytes, long runs of two letters can have one sum for any base.
    wide = Windows(mix(packed(data) ^ np.uint64(SEEDS[1])), SEEDS[1]) if length >= 8 else w
    content = mix(wide.ranges(start, start + size - 7 * (length >= 8)) + size.astype(np.uint64) * np.uint64(SEEDS[1]))
    return text, start - begins[text], number, least[start], content, np.isin(least[start], twice)


def candidate_runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs with (anchor, content, doc, tag, n, times, own), tag holding 32 bits of the text's hash and the
    first byte. Of equal runs in a batch one travels with times = 2; the others are known to repeat
    and come with times = 0, under a key of their own. A hot run thus reaches its group once a batch."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for part in scratch.text_slices(iter([batch]), limit=SLICE_BYTES):
                ids, hashes = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_d", "_h"))
                text, at, number, anchor, content, own = _runs([(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()], length)
                if len(text):
                    tag = (hashes[text].view(np.uint64) << np.uint64(32) | at.astype(np.uint64)).view(np.int64)
                    found.append((anchor, content, ids[text], tag, number.astype(np.int32), own))
            if not found:
                continue
            anchor, content, doc, tag, number, own = (np.concatenate(c) for c in zip(*found))
            _, first, back, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
            same = anchor[first[back]] == anchor
            is_first = first[back] == np.arange(len(doc))
            repeated = same & (times[back] > 1)
            go = is_first | ~same
            again = ~go
            count = np.where(go & repeated, 2, np.where(go, 1, 0)).astype(np.int32)
            # Known repeats pass their group by.
            anchor = np.where(again, mix(doc.view(np.uint64) ^ tag.view(np.uint64)) & ~np.uint64(1), anchor)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(tag), pa.array(number), pa.array(count), pa.array(own)],
                ["anchor", "content", "doc", "tag", "n", "times", "own"])

    return docs.select("_d", "_h", "text").mapInArrow(emit, "anchor long, content long, doc long, tag long, n int, times int, own boolean")


def judge_runs(runs: DataFrame) -> DataFrame:
    """Adds `known` (the whole run repeats) and `asked` (one of the different runs of an anchor, or of
    equal runs that may repeat themselves); others go."""
    of_anchor = Window.partitionBy("anchor")
    of_run = Window.partitionBy("anchor", "content")
    real = F.col("times") > 0
    return (
        runs.withColumns({"_low": F.min(F.when(real, F.col("content"))).over(of_anchor), "_high": F.max(F.when(real, F.col("content"))).over(of_anchor)})
        .withColumns({"_total": F.sum("times").over(of_run), "_place": F.row_number().over(of_run.orderBy("doc", "tag"))})
        .withColumns({"known": ~real | (F.col("_total") > 1), "asked": real & (F.col("own") | (F.col("_low") != F.col("_high"))) & (F.col("_place") == 1)})
        .filter("known or asked")
        .select("anchor", "doc", "tag", "n", "known", "asked")
    )


CUT = "shard int, known boolean, _d long, _t long, at long, context binary, high long, low long, times int, open boolean, size long"


def _context_rows(batch: pa.RecordBatch, length: int, shards: int) -> dict[str, pa.Array]:
    """Text of the asked runs of anchors that fit a shard, under the shard of their anchor."""
    rows: list[tuple] = []
    for d, t, text, runs in zip(*(batch.column(c).to_pylist() for c in ("_d", "_t", "text", "runs"))):
        data = text.encode("utf-8", "surrogatepass")
        rows += [(r["anchor"] % shards, r["known"], d, t, r["at"], data[r["at"] : r["at"] + r["n"] - 1 + length]) for r in runs if not r["hot"]]
    kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["shard", "known", "_d", "_t", "at", "context"]
    return {n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)} if rows else {}


def _window_rows(batch: pa.RecordBatch, length: int) -> dict[str, pa.Array]:
    """Windows of the asked runs of hot anchors by two hashes of their bytes, each once a batch.

    A row with times 1 or 2 tells its group that the window stands in the batch once or more; `open`
    marks those whose repeat only the group can tell. Windows that a batch holds twice repeat, and go
    as whole stretches with times 0. So a window that a third of the rows share reaches its group
    once for each batch.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for d, t, text, runs in zip(*(batch.column(c).to_pylist() for c in ("_d", "_t", "text", "runs"))):
        runs = [r for r in runs if r["hot"]]
        if not runs:
            continue
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        number = np.array([r["n"] for r in runs], dtype=np.int64)
        begin = np.cumsum(number) - number
        at = np.arange(number.sum()) - np.repeat(begin, number) + np.repeat([r["at"] for r in runs], number)
        both = [mix(Windows(byte_values(s & 0xFFFF)[data], s).ranges(at, at + length)).view(np.int64) for s in SEEDS]
        found.append((*both, np.repeat([r["known"] for r in runs], number), np.full(len(at), d), np.full(len(at), t), at))
    if not found:
        return {}
    high, low, known, d, t, at = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((low, high))
    new = np.concatenate([[True], (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    count = np.bincount(group)
    one = order[new]
    alone = (count[group[one]] == 1) & ~known[one]
    twice = np.flatnonzero((count[group] > 1) & ~known)
    twice = twice[np.lexsort((at[twice], t[twice], d[twice]))]
    jump = np.concatenate([[True], (np.diff(d[twice]) != 0) | (np.diff(t[twice]) != 0) | (np.diff(at[twice]) != 1)]) if len(twice) else np.zeros(0, bool)
    head = twice[jump]
    size = np.diff(np.append(np.flatnonzero(jump), len(twice))) - 1 + length
    zero = np.zeros(len(head), np.int64)
    place = lambda c: pa.array(np.concatenate([np.where(alone, c[one], 0), c[head]]))
    return {
        "high": pa.array(np.concatenate([high[one], zero])), "low": pa.array(np.concatenate([low[one], zero])),
        "times": pa.array(np.concatenate([np.minimum(count[group[one]], 2), zero]).astype(np.int32)),
        "open": pa.array(np.concatenate([alone, zero > 0])), "_d": place(d), "_t": place(t), "at": place(at),
        "size": pa.array(np.concatenate([np.full(len(one), length), size]))}


def _cut(joined: DataFrame, length: int, shards: int) -> DataFrame:
    """Contexts and windows in one pass over the texts, so that these are shuffled once."""
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in CUT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scratch.text_slices(batches, limit=2 << 20):
            for rows in (_context_rows(batch, length, shards), _window_rows(batch, length)):
                if rows:
                    n = len(next(iter(rows.values())))
                    yield pa.RecordBatch.from_arrays([rows.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    return joined.select("_d", "_t", "text", "runs").mapInArrow(run, CUT)


def _grouped(windows: DataFrame) -> DataFrame:
    """(_d, _t, at, size): repeated windows of the runs that are not known as a whole."""
    times = F.sum("times").over(Window.partitionBy("high", "low"))
    often = windows.filter("times > 0").withColumn("_all", times).filter("open and _all > 1")
    columns = ["_d", "_t", "at", "size"]
    return often.select(*columns).union(windows.filter("times = 0").select(*columns))


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, the starts of its `length`-byte strings that start anywhere else in the shard."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    text = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    order, common = induced.suffix_array(text, depth=max(200, length))
    joined = common >= length
    repeats = joined.copy()
    repeats[:-1] |= joined[1:]
    start = np.sort(order[repeats].astype(np.int64))
    which = np.searchsorted(ends, start, side="left")
    own = start + length <= ends[which]
    start, which = start[own], which[own]
    cuts = np.searchsorted(which, np.arange(len(contexts) + 1))
    begins = ends - sizes
    return [start[a:b] - begins[k] for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _search(contexts: DataFrame, length: int, tasks: int) -> DataFrame:
    """(_d, _t, at, size): repeated stretches of the runs that are not known as a whole. A task sorts its shards one by one."""
    schema = "_d long, _t long, at long, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bool, int, int, int]] = []
        texts: list[bytes] = []
        shard = None

        def sort() -> pa.RecordBatch:
            rows = []
            for (known, d, t, at), starts in zip(held, repeated_starts(texts, length)):
                if known or not len(starts):
                    continue
                cut = np.flatnonzero(np.concatenate([[True], np.diff(starts) > 1]))
                for a, b in zip(starts[cut].tolist(), starts[np.append(cut[1:], len(starts)) - 1].tolist()):
                    rows.append((d, t, at + a, b - a + length))
            held.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["_d", "_t", "at", "size"])

        for batch in batches:
            for s, known, d, t, at, context in zip(*(batch.column(c).to_pylist() for c in ("shard", "known", "_d", "_t", "at", "context"))):
                if s != shard and held:
                    yield sort()
                shard = s
                held.append((known, d, t, at)), texts.append(context)
        if held:
            yield sort()

    return contexts.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = 200, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents without bytes covered by a `length`-byte string that also starts anywhere else.

    Strings are judged on the input, never cross documents, and may overlap. Columns: doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes), kept_sha256. Null
    texts are empty. Each row is a document of its own: rows that repeat a text are removed wholly
    if it has `length` bytes. Columns named in `carry` come along in a struct `rest`, others are
    ignored; an empty table gives no rows.
    """
    # A row is known by 96 bits: 64 of id and text (or of the missing id and text), 32 more of the text.
    ids = F.col("doc_id").cast("long")
    rows = docs.select(
        ids.alias("doc_id"), F.xxhash64(ids.isNull(), ids, "text").alias("_d"), F.xxhash64(F.lit("text"), "text").alias("_h"), "text", *([F.struct(*[F.col(c) for c in carry]).alias("rest")] if carry else []))
    with scratch.short_batches(docs.sparkSession):
        found = scratch.keep(judge_runs(candidate_runs(rows, length)))
    # Anchors that fill a shard: as many as such shards at most.
    sizes = found.filter("asked").groupBy("anchor").agg(F.sum(F.col("n") + length).alias("b"))
    hot = scratch.keep(sizes.filter(F.col("b") > SHARD_BYTES).select("anchor", F.lit(True).alias("hot")))
    some_hot = not hot.isEmpty()
    total = sizes.filter(F.col("b") <= SHARD_BYTES).agg(F.sum("b").alias("b")).first()["b"] or 0
    tasks, shards = (max(1, math.ceil(k * total / SHARD_BYTES)) for k in (1, SORTS))
    rest = ["rest"] if carry else []
    keyed = rows.select("doc_id", "_d", *rest, F.col("_h").bitwiseAND(F.lit(LOW)).alias("_t"), "text")
    placed = found.select(
        "anchor", F.col("doc").alias("_d"), F.shiftrightunsigned("tag", 32).alias("_t"), F.col("tag").bitwiseAND(F.lit(LOW)).alias("at"), "n", "known", "asked")
    to_sort = placed.filter("asked")
    flagged = to_sort.join(hot, "anchor", "left") if some_hot else to_sort.withColumn("hot", F.lit(False))
    asked = flagged.groupBy("_d", "_t").agg(
        F.collect_list(F.struct("anchor", "at", "n", "known", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))
    # One row stands for all that repeat doc_id and text: their runs are known, whichever it is.
    with scratch.short_batches(docs.sparkSession):
        cut = scratch.keep(_cut(keyed.join(asked, ["_d", "_t"]), length, shards))
    contexts = cut.filter("context is not null").select("shard", "known", "_d", "_t", "at", "context")
    spans = placed.filter("known").select("_d", "_t", "at", (F.col("n") - 1 + length).cast("long").alias("size"))
    spans = spans.union(_search(contexts, length, tasks)).union(_grouped(cut.filter("times is not null")))
    marks = spans.groupBy("_d", "_t").agg(F.collect_list(F.struct("at", "size")).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scratch.text_slices(batches, limit=2 << 20):
            out: list[list] = [[] for _ in range(5)]
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("spans")):
                data = (text or "").encode("utf-8", "surrogatepass")
                kept, number = [data], 0
                if marks.is_valid:
                    at, size = (marks.values.field(k).to_numpy() for k in (0, 1))
                    order = np.argsort(at, kind="stable")
                    at, to = at[order], np.maximum.accumulate((at + size)[order])
                    new = np.concatenate([[True], at[1:] > to[:-1]])
                    begin, end = at[new], to[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
                    number = len(begin)
                    kept = [data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)])]
                left = b"".join(kept)
                for column, value in zip(out, (len(data), len(data) - len(left), number, left, hashlib.sha256(left).hexdigest())):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), *(pa.array(c, k) for c, k in zip(out, kinds))],
                [*own, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = keyed.join(marks, ["_d", "_t"], "left")
    own = ["doc_id", *rest]
    added = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return joined.select(*own, "text", "spans").mapInArrow(apply, StructType([*joined.select(*own).schema, *added]))
