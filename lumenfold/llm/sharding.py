"""Longest-processing-time sharding of groups that must stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import scratch

# Sizes under 2**16 are classes of their own, larger ones share 16 leading bits with their class.
CLASS_BITS = 16
ONE_BY_ONE = 64


def size_class(size):
    """Sizes with the same leading bits: at most 2**16 + 2**15 for each further doubling."""
    drop = f"greatest(cast(length(bin({size})) as int) - {CLASS_BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({size}, {drop}), {drop})")


def _fill(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """Items each shard gets when `count` items of one size go, one by one, to the least-loaded shard."""

    def below(level: int) -> np.ndarray:
        return np.maximum(0, -((loads - level) // size))  # items of a shard that start under the level

    low, high = int(loads.min()), int(loads.max()) + size * (count + 1)
    while high - low > 1:
        mid = (low + high) // 2
        if int(below(mid).sum()) <= count:
            low = mid
        else:
            high = mid
    got = below(low)
    heap = [(int(loads[k] + got[k] * size), k) for k in range(len(loads))]
    heapq.heapify(heap)
    for _ in range(count - int(got.sum())):
        load, k = heapq.heappop(heap)
        got[k] += 1
        heapq.heappush(heap, (load + size, k))
    return got


def plan(classes: Iterable[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """LPT over a histogram of (class, groups, bytes): for each class the ends of the shards' rank ranges.

    Classes go from large to small, and the groups of a class to the least-loaded shard through a
    heap (ties: the smaller shard). A class with many groups is filled in one step to the level at
    which the heap would end.
    """
    loads = np.zeros(shards, dtype=np.int64)
    out = []
    for key, count, total in sorted(classes, key=lambda c: -c[0]):
        size = max(1, total // count)
        if count <= ONE_BY_ONE:
            got = np.zeros(shards, dtype=np.int64)
            heap = [(int(n), k) for k, n in enumerate(loads)]
            heapq.heapify(heap)
            for _ in range(count):
                load, k = heap[0]
                got[k] += 1
                heapq.heapreplace(heap, (load + size, k))
        else:
            got = _fill(loads, size, count)
        loads = loads + got * size
        out.append((key, np.cumsum(got).tolist()))
    return out


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """Adds `shard` to groups with columns key and bytes.

    What reaches the driver is the histogram of sizes, whose length has a fixed bound (see
    `size_class`), never a group.
    """
    groups = groups.withColumn("_class", size_class("bytes"))
    rows = groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).collect()
    ends = groups.sparkSession.createDataFrame(plan(((r["_class"], r["n"], r["b"]) for r in rows), shards), "_class long, _ends array<long>")
    ranked = scratch.positions(groups, ["_class"], ["key"], sum(r["n"] for r in rows), "_rank")
    return (
        ranked.join(ends, "_class")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int"))
        .drop("_class", "_ends", "_rank")
    )


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """Documents in shards of nearly equal bytes; equal texts stay together.

    Columns: doc_id, size (UTF-8 bytes plus `overhead`), text_crc32, law ('bytes'), shard, slot
    (gapless from 0 in each shard), grown_shard (null under this law). Null texts have no bytes and
    are one group; empty texts another. Repeated rows keep a slot each. Other columns are ignored.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = scratch.keep(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(raw, 256))).alias("key")))
    sums = scratch.keep(keyed.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    placed = shard_groups(sums, shards)
    # The group that holds a third of all rows meets one row here: adaptive execution splits it.
    rows = keyed.join(placed.select("key", "shard"), "key").select("doc_id", "size", "text_crc32", "shard")
    total = sums.agg(F.sum("n").alias("n")).first()["n"] or 0
    out = scratch.positions(rows, ["shard"], [F.coalesce("doc_id", F.lit(-1)), "text_crc32"], total, "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
