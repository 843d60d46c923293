"""Near copies by the share of common five-word shingles, for the pipeline: SimHash under pigeonring filtering.

At a similarity of 0.8 two SimHash fingerprints differ in some 15 % of their bits, whatever their length,
so the 64 bits and 2 differences of `simhash` cannot tell. A fingerprint here has 3,840 bits, a ring of 192
segments of 20, and a budget of 20 %: a tight bound for so many bits. The ring's principle leaves the first
segment of a chain 4 differences; a pair is looked for where it has none, which fails at all 192 starts for
about 0.07 % of the pairs at 0.8 and fewer above (by arithmetic). Each start's segment is a join key; the
chain's next three segments travel with it and are held against their budgets, then the whole fingerprint
against its own, and what is left against the shingles themselves.

Documents with equal shingles are one node. A key of two nodes is a pair. In a fuller one every node is
held against the few that lead its keys, and then, inside the task of a key, against those that are not in its
component after that. Those are compared by counts of their shingles' hashes, which prove most of the unlike
ones unlike, so few pairs of them become rows. The first pairs follow the size of a family, not the square of it;
of the last, those near the threshold still follow the square.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm import components, scratch
from lumenfold.llm.simhash import shingle_hashes

WORDS = 5
ABOVE, BELOW = 4, 5  # similarity of 4/5 or more
SEGMENTS, WIDTH = 192, 20
BITS = SEGMENTS * WIDTH
FURTHER = 3  # segments that travel with a key
SHARE = 5  # a budget is a fifth of the bits
MOST = BITS // SHARE
FEWEST = ABOVE  # smaller sets are alike only if they are equal
BUCKET = 32
FEW = 2  # fuller keys are not paired
BINS = 512
CHOSEN = 4
BLOCK = 255  # rows that a byte can count
BATCH = 256
ROWS_PER_TASK = 1 << 20  # keys
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIXER = np.uint64(0xD6E8FEB86659FD93)


@contextmanager
def _small_batches(spark: SparkSession):
    """Rows with two texts go to Python few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the five-word shingles, in order; empty for texts without words."""
    return np.unique(np.array(shingle_hashes(text, WORDS) if text else [], dtype=np.uint64))


def fingerprint_of(shingles: np.ndarray) -> bytes:
    """BITS bits; one is set if it is set in over half of the shingles' hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(shingles), BLOCK):
        each = shingles[start : start + BLOCK, None] * FACTORS
        each ^= each >> np.uint64(32)
        each *= MIXER
        each ^= each >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(each.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").tobytes()


def ring_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint and start (rows of bytes to rows of SEGMENTS): the key, and the segments that follow on the ring."""
    bits = np.unpackbits(fingerprints, axis=1, bitorder="little").reshape(-1, SEGMENTS, WIDTH)
    segment = bits @ (np.int64(1) << np.arange(WIDTH, dtype=np.int64))
    key = segment + (np.arange(SEGMENTS, dtype=np.int64) << WIDTH)
    after = np.zeros_like(segment)
    for k in range(FURTHER):
        after |= np.roll(segment, -1 - k, axis=1) << (k * WIDTH)
    return key, after


def chain_holds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether every prefix of the chain stays in its budget; the first segment is equal, `a` and `b` hold the others."""
    xor = a ^ b
    out = np.ones(len(xor), dtype=bool)
    for k in range(1, FURTHER + 1):
        differ = np.bitwise_count(xor & np.int64((1 << (k * WIDTH)) - 1))
        out &= differ <= (k + 1) * WIDTH // SHARE
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return BELOW * common >= ABOVE * (len(a) + len(b) - common)


def bins_of(shingles: np.ndarray) -> bytes:
    """How many of the shingles fall into each of BINS shares of the hashes, up to 255."""
    return np.minimum(np.bincount((shingles % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def can_be_alike(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bins (rows of `a`) leave room for a similarity of 4/5; `sizes` are those of both sets together.

    Sets differ in at least as many shingles as their bins do, also where a bin holds more than it can count, so no
    alike pair is left out.
    """
    differ = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)
    return (ABOVE + BELOW) * (sizes - differ) >= 2 * ABOVE * sizes


def _marks(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scratch.text_slices(batches, limit=2 << 20):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_id"), pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                 pa.array([fingerprint_of(s) if len(s) >= FEWEST else None for s in sets], pa.binary()),
                 pa.array([bins_of(s) if len(s) >= FEWEST else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())],
                ["_row", "_id", "content", "fp", "bins", "size"])

    return rows.select("_row", F.col("doc_id").cast("long").alias("_id"), "text").mapInArrow(run, "_row long, _id long, content binary, fp binary, bins binary, size long")


def _keys(heads: DataFrame) -> DataFrame:
    """(key, after, node): a row for each start of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                fps = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(-1, BITS // 8)
                key, after = ring_keys(fps)
                node = np.repeat(part.column("node").to_numpy(), SEGMENTS)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.ravel(), after.ravel(), node)], ["key", "after", "node"])

    return heads.filter("fp is not null").select("node", "fp").mapInArrow(run, "key long, after long, node long")


def _checked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in batches:
            stay = []
            for a, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "left", "right"))):
                if a != last:
                    last, of_last = a, shingle_set(left)
                stay.append(alike(of_last, shingle_set(right)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(stay, pa.bool_()))

    with _small_batches(pairs.sparkSession), scratch.Temporary(pairs.sparkSession) as only:
        pairs = only.keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
        asked = pairs.select(F.col("a").alias("_row")).union(pairs.select("b")).distinct()
        texts = only.keep(rows.select("_row", "text").join(asked, "_row", "left_semi"))
        both = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")
        return scratch.keep(both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long"))


def _near(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, whose whole fingerprints stay in their budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("left", "right"))
            differ = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(differ <= MOST))

    asked = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    fps = heads.select("node", "fp")
    both = asked.join(fps.toDF("a", "left"), "a").join(fps.toDF("b", "right"), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _paired(keyed: DataFrame, bucket: int, few: int | None = None) -> DataFrame:
    """Pairs (a, b) of each key with `few` nodes or fewer (`bucket` if not given) that pass the chain; of fuller ones
    the rows, with a null `b`: up to `bucket` nodes those that are in such a pair, beyond it all.

    Rows of a key stand together; at most `bucket` rows of the last one are held back.
    """
    few = bucket if few is None else min(few, bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "after", "node", "n")
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names]
            full = rows[3] > bucket
            if full.any():
                key, after, node, _ = (x[full] for x in rows)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, after, node)] + [pa.nulls(len(key), pa.int64())], ["key", "after", "a", "b"])
            rows = [np.concatenate([x, y[~full]]) for x, y in zip(held, rows)]
            # The last key waits for the rows that it still lacks.
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            end = last if len(rows[0]) - last < (rows[3][-1] if len(rows[0]) else 0) else len(rows[0])
            held = [x[end:] for x in rows]
            key, after, node, n = (x[:end] for x in rows)
            paired = np.zeros(end, dtype=bool)
            for d in range(1, bucket):
                at = np.flatnonzero(key[d:] == key[:-d])
                if not len(at):
                    break
                at = at[chain_holds(after[at], after[at + d])]
                more = n[at] > few
                paired[at[more]] = paired[at[more] + d] = True
                at = at[~more]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[at], after[at], node[at], node[at + d])], ["key", "after", "a", "b"])
            if paired.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[paired]) for x in (key, after, node)] + [pa.nulls(int(paired.sum()), pa.int64())], ["key", "after", "a", "b"])

    counted = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")
    # The window leaves its rows sorted by key.
    return counted.select("key", "after", "node", "n").mapInArrow(run, "key long, after long, a long, b long")


def _by_key(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("key", *columns).repartition("key").sortWithinPartitions("key")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of one key after the other, of batches in which they stand together."""

    def joined(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        whole = pa.Table.from_batches(parts)
        return {f.name: np.frombuffer(b"".join(whole.column(f.name).to_pylist()), np.uint8).reshape(whole.num_rows, -1) if pa.types.is_binary(f.type)
                else whole.column(f.name).to_numpy() for f in whole.schema}

    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column("key").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and held[0].column("key")[0].as_py() != key[a]:
                yield joined(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield joined(held)


def _starred(full: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, at: their keys) with the CHOSEN first that stand in most full keys of those that lead one of theirs.

    A key is led by the node with most keys: it is closest to what the others were copied from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of in _groups(batches):
            node, d, h = of["node"], of["d"], of["h"]
            first = np.lexsort((node, h, d))[-1]
            other = node[node != node[first]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), x)) for x in (d[first], h[first], node[first])] + [pa.array(other)], ["d", "h", "a", "b"])

    rows = full.select("node", F.size("at").cast("long").alias("d"), F.xxhash64("node").alias("h"), F.inline("at"))
    led = _by_key(rows, "node", "d", "h").mapInArrow(run, "d long, h long, a long, b long")
    # A node has SEGMENTS leaders at most.
    best = F.slice(F.sort_array(F.collect_set(F.struct("d", "h", "a")), asc=False), 1, CHOSEN)
    return led.groupBy("b").agg(best.alias("best")).select(F.explode("best.a").alias("a"), "b")


def _across(named: DataFrame) -> DataFrame:
    """Pairs (a, b) of one key (key, after, node, root) that have different roots and pass the chain.

    With columns `fp`, `bins` and `size`, only those whose whole fingerprints stay in their budget and whose bins let them be alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            after, node = rows["after"], rows["node"]
            _, of, sizes = np.unique(rows["root"], return_inverse=True, return_counts=True)
            # All but the largest component are held against everything.
            largest = int(np.argmax(sizes))
            asked = np.flatnonzero(of != largest)
            for k in asked.tolist():
                other = np.flatnonzero((of != of[k]) & ((of == largest) | (np.arange(len(of)) > k)))
                other = other[chain_holds(after[other], np.full(len(other), after[k]))]
                if "fp" in rows:
                    other = other[can_be_alike(rows["bins"][other], rows["bins"][k], rows["size"][other] + rows["size"][k])]
                    other = other[np.bitwise_count(rows["fp"][other] ^ rows["fp"][k]).sum(axis=1, dtype=np.int64) <= MOST]
                if len(other):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), node[k])), pa.array(node[other])], ["a", "b"])

    given = [c for c in ("fp", "bins", "size") if c in named.columns]
    return _by_key(named, "after", "node", "root", *given).mapInArrow(run, "a long, b long")


def _links(heads: DataFrame, rows: DataFrame) -> DataFrame:
    with scratch.Temporary(rows.sparkSession) as only:
        keyed = scratch.spread(_keys(heads), heads.count() * SEGMENTS, ROWS_PER_TASK, "key")
        found = only.keep(_paired(keyed, BUCKET, FEW))
        pairs = found.filter("b is not null").select("a", "b")
        # A node's rows stand together, SEGMENTS at most, so that joins have a row for each node.
        full = only.keep(found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.collect_list(F.struct("key", "after")).alias("at")))
        links = _checked(_near(pairs.union(_starred(full)), heads), rows)
        if full.isEmpty():
            return links
        roots = only.keep(components.smallest_reachable(links))
        named = full.join(roots, "node", "left").join(heads.select("node", "fp", "bins", "size"), "node")
        named = named.select("node", F.coalesce("root", "node").alias("root"), "fp", "bins", "size", F.inline("at"))
        return links.union(_checked(_across(named), rows))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of texts that share 4/5 of their five-word shingles; all columns stay.

    The row with the smallest doc_id stays, one with a null doc_id only where its component has no
    other; of rows that repeat that doc_id in a component, one. A text of fewer words is one shingle;
    null and wordless texts are copies of each other.
    """
    rows = scratch.keep(docs.withColumn("_row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    with _small_batches(docs.sparkSession):
        heads = scratch.keep(_marks(rows).groupBy("content").agg(F.min("_row").alias("node"), first.alias("best"), *[F.first(c).alias(c) for c in ("fp", "bins", "size")]))
    roots = components.smallest_reachable(_links(heads, rows)).withColumnRenamed("root", "_root")
    best = heads.select("node", "best").join(roots, "node", "left").groupBy(F.coalesce("_root", "node")).agg(F.min("best").alias("best"))
    return rows.join(best.select(F.col("best.row").alias("_row")), "_row", "left_semi").drop("_row")
