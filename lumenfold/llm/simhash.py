"""SimHash near-duplicates by pigeonring filtering.

Fingerprints have 64 bits, cut into a ring of m segments. If two of them differ in at most t bits,
some chain of consecutive segments has, for every prefix of l segments, at most l*t/m differences.
With m = 2t+1 the budgets of the first two segments are under one, so such a chain starts with two
equal segments: those are the join key. The rest of the chain is then held against its budgets, and
what is left against the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import components, scratch

SPACES = bytes(range(9, 14))
BUCKET = 32
EQUAL = 2  # segments whose budget l*t/(2t+1) is under one
WORD_SPLIT = bytes.maketrans(SPACES, b" " * len(SPACES))


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space, of the UTF-8 text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().translate(WORD_SPLIT).split()


def shingle_hashes(text: str, words_per_shingle: int = 3, seed: int = 42) -> list[int]:
    """Unsigned XXH64 of every shingle, repeats included; of the whole sequence if it is shorter."""
    words = split_words(text)
    if not words:
        return []
    n, k = len(words), words_per_shingle
    joined = b" ".join(words)
    if n <= k:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - k].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]


def fingerprints_of(texts: list[str | None], words_per_shingle: int = 3, seed: int = 42, block: int = 1 << 16) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is set if it is set in over half of a text's hashes."""
    out = np.zeros(len(texts), dtype=np.uint64)
    shifts = np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, words_per_shingle, seed) if text else [], dtype="<u8")
        ones = np.zeros(64, dtype=np.int64)
        for start in range(0, len(hashes), block):
            part = np.ascontiguousarray(hashes[start : start + block])
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.bitwise_or.reduce((2 * ones > len(hashes)).astype(np.uint64) << shifts) if len(hashes) else 0
    return out.view(np.int64)


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): whole texts; null and wordless texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scratch.text_slices(batches, limit=2 << 20):
            fp = fingerprints_of(batch.column("text").to_pylist(), words_per_shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _segments(max_diff: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the ring's 2t+1 segments, as even as can be."""
    m = 2 * max_diff + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(segments: list[tuple[int, int]]) -> int:
    value = 0
    for first, bits in segments:
        value |= ((1 << bits) - 1) << first
    return value - (1 << 64) if value >> 63 else value


def _chain_holds(xor: Column, start: int, segments: list[tuple[int, int]], max_diff: int) -> Column:
    """Every prefix of the chain from `start` stays within its share of the distance."""
    m = len(segments)
    order = [segments[(start + i) % m] for i in range(m)]
    steps = [F.bit_count(xor.bitwiseAND(F.lit(_mask(order[:n])))) * m <= n * max_diff for n in range(EQUAL + 1, m + 1)]
    out = steps[0]
    for step in steps[1:]:
        out = out & step
    return out


def _links_in_buckets(keyed: DataFrame, max_diff: int) -> DataFrame:
    """Candidates of one bucket that pass the chain and the full check."""
    segments = _segments(max_diff)
    left = keyed.select("start", "key", F.col("fp").alias("a"))
    pairs = left.join(keyed.select("start", "key", F.col("fp").alias("b")), ["start", "key"]).filter("a < b")
    xor = F.col("a").bitwiseXOR(F.col("b"))
    holds = F.lit(False)
    for i in range(len(segments)):
        holds = holds | ((F.col("start") == i) & _chain_holds(xor, i, segments, max_diff))
    return pairs.filter(holds).filter(F.bit_count(xor) <= max_diff).select("a", "b")


def _links_by_flips(fps: DataFrame, max_diff: int) -> DataFrame:
    """All links within `max_diff` bits among `fps`, for buckets too full to pair.

    At 1 bit a fingerprint's 64 neighbours are looked up. At 2 bits, two fingerprints have a word
    within 1 bit of both, and every word within 1 bit of two fingerprints proves a link. A word has
    at most 65 such fingerprints, whatever their number, and each is linked to the smallest, so rows
    stay in proportion.
    """
    flips = F.concat(F.array("fp"), F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    near = fps.select("fp", F.explode(flips).alias("mid"))
    if max_diff == 1:
        return near.join(fps.withColumnRenamed("fp", "b"), F.col("mid") == F.col("b")).filter("fp > b").select(F.col("fp").alias("a"), "b")
    least = near.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return near.join(least, "mid").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, max_diff: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all pairs of the distinct fingerprints `fps` within `max_diff` bits.

    A key that more than `bucket` fingerprints share is not paired: those go, all together, through
    an exact form whose size stays in proportion to theirs. That form exists for 1 and 2 bits.
    """
    if max_diff not in (1, 2):
        raise ValueError("max_diff is 1 or 2")
    segments = _segments(max_diff)
    m = len(segments)
    keys = [F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(
        _mask([segments[(i + k) % m] for k in range(EQUAL)]))).alias("key")) for i in range(m)]
    keyed = fps.select("fp", F.inline(F.array(*keys)))
    shared = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    in_shared = scratch.keep(keyed.join(shared, ["start", "key"]))
    paired = _links_in_buckets(in_shared.filter(F.col("n") <= bucket), max_diff)
    full = in_shared.filter(F.col("n") > bucket).select("fp").distinct()
    return paired.union(_links_by_flips(full, max_diff))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, max_diff: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): components of fingerprints within `max_diff` bits.

    fingerprint is 16 lowercase hex digits; component_id the smallest doc_id reachable, itself
    included. Null, empty and wordless texts have fingerprint zero and link like any other. Rows that
    repeat a doc_id keep a row each; a null doc_id takes part in links, and is its component's id
    only where no member has one. Other columns are ignored; an empty table gives no rows.
    """
    marked = scratch.keep(fingerprints(docs, words_per_shingle, seed))
    heads = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("head")))
    roots = components.smallest_reachable(links(heads.select("fp"), max_diff))
    # The root is the smallest fingerprint; its component's smallest doc_id is asked for.
    named = heads.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("head").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of near-duplicates; all columns stay.

    The row with the smallest doc_id stays, one with a null doc_id only where its component has no
    other; of rows that repeat that doc_id in a component, one.
    """
    rows = scratch.keep(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), **options)
    of_row = rows.select("_row", F.col("doc_id").cast("long").alias("_id")).join(found.withColumnRenamed("doc_id", "_row"), "_row")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    keep = of_row.groupBy("component_id").agg(first.alias("best")).select(F.col("best.row").alias("_row"))
    return rows.join(keep, "_row", "left_semi").drop("_row")
