"""Mixing sets: ordered concatenation, interleaving, subsets, routing, summaries.

Every input carries a dense 0-based `row_id`. Mixtures keep `source` (position of the input) and
`row_id`, and add `mix_id`, the position in the mixture.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructType

from lumenfold.functions.draws import cdf_thresholds, order60, rank32
from lumenfold.operators.ranking import block_range, first_by_hash, task_count, with_rank

FIRST = "first_exhausted"
ALL = "all_exhausted"
TURNS = 4096  # copies of one row that one task makes at a time
DRAWS = 1 << 14  # steps of a block, of a mixture of up to DRAWS * MOST_BLOCKS steps
MOST_BLOCKS = 1 << 16
PLACED = 1 << 16  # rows that one task places, about


def stack(dfs: Sequence[DataFrame]) -> DataFrame:
    """Union by name with the position of each input."""
    out = None
    for n, df in enumerate(dfs):
        tagged = df.withColumn("source", F.lit(n))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def lengths(dfs: Sequence[DataFrame]) -> list[int]:
    """Row counts of all inputs in one job."""
    rows = stack([d.select("row_id") for d in dfs]).groupBy("source").count().collect()
    found = {r["source"]: r["count"] for r in rows}
    return [found.get(n, 0) for n in range(len(dfs))]


def concat(dfs: Sequence[DataFrame], sizes: Sequence[int] | None = None) -> DataFrame:
    """One set after the other: `mix_id` is the offset of the source plus the row."""
    sizes = list(sizes) if sizes is not None else lengths(dfs)
    offsets = [sum(sizes[:n]) for n in range(len(sizes))]
    return stack([d.withColumn("mix_id", F.col("row_id") + F.lit(o)) for d, o in zip(dfs, offsets)])


def interleave(dfs: Sequence[DataFrame], stopping: str = FIRST, sizes: Sequence[int] | None = None) -> DataFrame:
    """Rows of all sources in turn.

    `first_exhausted` stops with the shortest set: a filter on row ids, no shuffle.
    `all_exhausted` runs to the longest; shorter sets start over, each row being copied to its rounds
    where it is, without a join.
    """
    sizes = list(sizes) if sizes is not None else lengths(dfs)
    k = len(dfs)
    if stopping == FIRST:
        rounds = min(sizes)
        return stack(
            [d.where(F.col("row_id") < rounds).withColumn("mix_id", F.col("row_id") * k + n) for n, d in enumerate(dfs)]
        )
    if stopping != ALL:
        raise ValueError(f"unknown stopping rule: {stopping}")
    if min(sizes) == 0:
        raise ValueError("cannot cycle over an empty set")
    rounds = max(sizes)

    def cycled(df: DataFrame, n: int) -> DataFrame:
        return _copies(df, sizes[n], rounds).withColumn("mix_id", F.col("_k") * k + n).drop("_k")

    return stack([cycled(d, n) for n, d in enumerate(dfs)])


def _copies(df: DataFrame, size: int, total: int) -> DataFrame:
    """Each row once for every place `_k` in 0..total-1 that it takes when the set starts over at its end."""
    if total <= size:
        return df.where(F.col("row_id") < total).withColumn("_k", F.col("row_id").cast("bigint"))
    # A row stands at row_id, row_id + size, ...: chunks of turns first, then the turns of a chunk.
    turns = F.floor((F.lit(total - 1) - F.col("row_id")) / F.lit(size)).cast("bigint") + 1
    chunks = df.withColumn("_turns", turns).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_turns") - 1) / TURNS))).alias("_chunk"))
    if total > size * TURNS:
        # Few rows, many turns each: chunks are dealt out, fewer than one for TURNS / 2 rows of the result.
        chunks = chunks.repartition("row_id", "_chunk")
    inside = F.sequence(F.col("_chunk") * TURNS, F.least((F.col("_chunk") + 1) * TURNS, F.col("_turns")) - 1)
    copies = chunks.select("*", F.explode(inside).alias("_turn"))
    return copies.withColumn("_k", F.col("row_id") + F.col("_turn") * size).drop("_turns", "_chunk", "_turn")


def draw_plan(
    spark: SparkSession, sizes: Sequence[int], probabilities: Sequence[float], seed: int, stopping: str = FIRST
) -> DataFrame:
    """Which source each step draws from, up to the stop: `mix_id, source, row_id`.

    Draws are hashes of the step number. The stop is the step that exhausts the first set (or the
    last one); how many steps that needs is found by doubling, on counts alone, and the stop itself by
    ranking the blocks where a source runs out.
    """
    draws = _draws(spark, draw_steps(spark, sizes, probabilities, seed, stopping), probabilities, seed)
    ranked = with_rank(draws, ["source"], ["mix_id"], block_range(F.col("mix_id")), out="_taken")
    return ranked.join(_sized(spark, sizes), "source").select("mix_id", "source", (F.col("_taken") % F.col("_size")).alias("row_id"))


def _sized(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    """One row per source of the mixture spec."""
    return F.broadcast(spark.createDataFrame([(n, int(s)) for n, s in enumerate(sizes)], "source int, _size bigint"))


def draw_steps(spark: SparkSession, sizes: Sequence[int], probabilities: Sequence[float], seed: int, stopping: str = FIRST) -> int:
    """How many steps the mixture has."""
    _check(sizes, probabilities, stopping)
    combine = min if stopping == FIRST else max
    live = [n for n, p in enumerate(probabilities) if p > 0]
    guess = combine(sizes[n] * math.fsum(probabilities) / probabilities[n] for n in live)
    steps = int(guess + 4 * math.sqrt(guess) + 64)
    while True:
        draws = _draws(spark, steps, probabilities, seed)
        seen = {r["source"]: r["count"] for r in draws.groupBy("source").count().collect()}
        done = [seen.get(n, 0) >= sizes[n] for n in live]
        if (any(done) if stopping == FIRST else all(done)):
            break
        steps *= 2
    return _stop(draws, block_range(F.col("mix_id")), _sized(spark, sizes), stopping) + 1


def _stop(draws: DataFrame, block: Column, sized: DataFrame, stopping: str) -> int:
    """The step that exhausts the first set, or the last one.

    Counts per block and source say in which block a source runs out; only those blocks, one per
    source, are ranked.
    """
    counts = draws.withColumn("_block", block).groupBy("source", "_block").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .join(sized, "source")
        .where((F.col("_upto") >= F.col("_size")) & (F.col("_upto") - F.col("_n") < F.col("_size")))
        .select("source", "_block", (F.col("_size") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    # One row per source at most.
    inside = draws.withColumn("_block", block).join(F.broadcast(edges), ["source", "_block"])
    at = F.row_number().over(Window.partitionBy("source", "_block").orderBy("mix_id"))
    last = inside.withColumn("_r", at).where(F.col("_r") == F.col("_left"))
    return last.agg((F.min if stopping == FIRST else F.max)("mix_id")).first()[0]


def _draws(spark: SparkSession, steps: int, probabilities: Sequence[float], seed: int) -> DataFrame:
    drawn = spark.range(steps).select(F.col("id").alias("mix_id"), rank32(seed, F.col("id"), "source").alias("_u"))
    source = F.lit(0)
    for t in cdf_thresholds(probabilities):
        source = source + F.when(F.col("_u") >= F.lit(t), 1).otherwise(0)
    return drawn.select("mix_id", source.cast("int").alias("source"))


def _check(sizes, probabilities, stopping) -> None:
    if stopping not in (FIRST, ALL):
        raise ValueError(f"unknown stopping rule: {stopping}")
    if len(sizes) != len(probabilities):
        raise ValueError(f"{len(sizes)} sources but {len(probabilities)} probabilities")
    if abs(math.fsum(probabilities) - 1) > 1e-6:
        raise ValueError(f"probabilities sum to {math.fsum(probabilities)}")
    if stopping == ALL and min(probabilities) <= 0:
        raise ValueError("a source with probability 0 is never exhausted")
    if min(sizes) <= 0:
        raise ValueError("every source needs rows")


def interleave_by_chance(
    dfs: Sequence[DataFrame],
    probabilities: Sequence[float],
    seed: int = 42,
    stopping: str = FIRST,
    sizes: Sequence[int] | None = None,
) -> DataFrame:
    """Interleave with drawn sources; a set that runs out starts over until the stop."""
    sizes = list(sizes) if sizes is not None else lengths(dfs)
    spark = dfs[0].sparkSession
    steps = draw_steps(spark, sizes, probabilities, seed, stopping)
    return _placed(dfs, sizes, steps, probabilities, seed, max(DRAWS, math.ceil(steps / MOST_BLOCKS)))


def _placed(dfs: Sequence[DataFrame], sizes: Sequence[int], steps: int, probabilities: Sequence[float], seed: int, block: int) -> DataFrame:
    """Rows of all sources at the steps that draw them.

    A row is the k-th draw of its source, for every k it takes. Counts per block of steps, MOST_BLOCKS
    for a source at most, say in which block that draw lies; the block's draws, hashes of the step
    numbers, are made again to find the step. Rows of neighbouring k meet in one task, a block's worth
    of rows to a key, so each block is drawn again once for a source.
    """
    spark = dfs[0].sparkSession
    counts = _draws(spark, steps, probabilities, seed).groupBy(
        "source", F.floor(F.col("mix_id") / block).alias("block")).agg(F.count(F.lit(1)).alias("n")).collect()
    blocks = math.ceil(steps / block)
    found = [[0] * blocks for _ in dfs]
    for r in counts:
        found[r["source"]][r["block"]] = r["n"]
    upto = [[0, *itertools.accumulate(x)] for x in found]
    near = [max(1, round(x[-1] / blocks)) for x in upto]
    rows = stack([_copies(d, s, x[-1]) for d, s, x in zip(dfs, sizes, upto)])
    widths = F.array(*[F.lit(w) for w in near])
    key = F.floor(F.col("_k") / F.get(widths, F.col("source")))
    # A number, so that adaptive execution does not join partitions of wide rows by their compressed size.
    tasks = task_count(spark, math.ceil(steps / PLACED))
    dealt = rows.withColumn("_key", key).repartition(tasks, "source", "_key").sortWithinPartitions("source", "_k").drop("_key")
    schema = StructType([f for f in rows.schema if f.name != "_k"]).add("mix_id", LongType())
    return dealt.mapInArrow(_steps_of(spark.sparkContext.broadcast(upto), block, steps, cdf_thresholds(probabilities), seed), schema)


def _steps_of(upto, block: int, steps: int, thresholds: list[int], seed: int):
    """The task function, made locally so that it travels by value."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    def sources(b: int) -> np.ndarray:
        draws = [int.from_bytes(hashlib.md5(b"%d|%d|source" % (seed, i)).digest()[:4], "big") for i in range(b * block, min(steps, (b + 1) * block))]
        return np.searchsorted(np.array(thresholds, np.int64), np.array(draws, np.int64), side="right")

    def place(batches):
        starts = [np.array(x, np.int64) for x in upto.value]
        known: tuple = (None, None)
        for batch in batches:
            source = batch.column("source").to_numpy()
            k = batch.column("_k").to_numpy()
            step = np.empty(len(k), np.int64)
            for s in np.unique(source):
                mine = np.flatnonzero(source == s)
                at = np.searchsorted(starts[s], k[mine], side="right") - 1
                for b in np.unique(at):
                    if known[0] != (s, b):
                        known = ((s, b), np.flatnonzero(sources(int(b)) == s) + int(b) * block)
                    here = mine[at == b]
                    step[here] = known[1][k[here] - starts[s][b]]
            kept = [n for n in batch.schema.names if n != "_k"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(step)], [*kept, "mix_id"])

    return place


def subset(df: DataFrame, portion: float, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """`int(n * portion)` rows: the first by row id, or a hash sample."""
    if not 0 < portion <= 1:
        raise ValueError(f"portion must be in (0, 1]: {portion}")
    if shuffle:
        hashed = df.withColumn("_h", order60(seed, F.col("row_id")))
        return first_by_hash(hashed, F.floor(F.col("n").cast("double") * portion), "_h").drop("_h")
    size = df.agg(F.floor(F.count(F.lit(1)).cast("double") * portion))
    return df.where(F.col("row_id") < size.scalar())


Builder = Callable[[DataFrame], DataFrame]


def route(mixture: DataFrame, builders: Mapping[int, tuple[str, Builder]], single: tuple[str, Builder]) -> DataFrame:
    """`mix_id, source, item`: sources with an episode builder go through it, the others through `single`.

    Every builder has a kind and returns `mix_id, source, item` for its rows. Items of different shape
    share a mixture as one tagged type: `item.kind`, and a field of each kind that is null in the others.
    Builders of one kind return one shape.
    """
    named = list(builders)
    parts = [(single[0], single[1](mixture.where(~F.col("source").isin(named)) if named else mixture))]
    parts += [(kind, build(mixture.where(F.col("source") == n))) for n, (kind, build) in builders.items()]
    types: dict[str, DataType] = {}
    for kind, built in parts:
        shape = built.schema["item"].dataType
        if types.setdefault(kind, shape).simpleString() != shape.simpleString():
            raise ValueError(f"two shapes of {kind}: {types[kind].simpleString()} and {shape.simpleString()}")
    out = None
    for kind, built in parts:
        fields = [(F.col("item") if k == kind else F.lit(None).cast(t)).alias(k) for k, t in types.items()]
        one = built.select("mix_id", "source", F.struct(F.lit(kind).alias("kind"), *fields).alias("item"))
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Mixture:
    """What to mix: names, probabilities, which sources build episodes."""

    sources: tuple[str, ...]
    probabilities: tuple[float, ...] | None = None
    seed: int = 42
    stopping: str = FIRST
    episode_sources: tuple[int, ...] = (0,)

    def __post_init__(self):
        if self.probabilities is not None:
            if len(self.probabilities) != len(self.sources):
                raise ValueError(f"{len(self.sources)} sources but {len(self.probabilities)} probabilities")
            if abs(math.fsum(self.probabilities) - 1) > 1e-6:
                raise ValueError(f"probabilities sum to {math.fsum(self.probabilities)}")
        if any(not 0 <= n < len(self.sources) for n in self.episode_sources):
            raise ValueError("an episode source is not in the mixture")

    def build(self, frames: Mapping[str, DataFrame]) -> DataFrame:
        dfs = [frames[name] for name in self.sources]
        if self.probabilities is None:
            return interleave(dfs, self.stopping)
        return interleave_by_chance(dfs, self.probabilities, self.seed, self.stopping)


def summary(mixture: DataFrame, spec: Mixture) -> DataFrame:
    """Rows per source with the settings of the mixture, and a total row (null source)."""
    counts = mixture.rollup("source").agg(F.count(F.lit(1)).alias("n_rows"))
    names = F.array(*[F.lit(s) for s in spec.sources])
    p = spec.probabilities
    shares = F.lit(None).cast("array<double>") if p is None else F.array(*[F.lit(float(x)) for x in p])
    return counts.select(
        "source",
        F.get(names, F.col("source")).alias("name"),
        "n_rows",
        F.get(shares, F.col("source")).alias("probability"),
        F.lit(spec.seed).alias("seed"),
        F.lit(spec.stopping).alias("stopping"),
    )
