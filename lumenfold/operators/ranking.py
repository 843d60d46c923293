"""Ranks and top-n without handing a whole group, or a whole table, to one task.

An order column (a 60-bit hash, or a row id) is cut into ranges. Rows are counted per range, the
small count table gives each range its offset, and rows are ranked inside their range only. So a
group that holds a third of all rows is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.draws import SPAN60

RANGE_ROWS = 65536  # rows that one range of the largest group holds, about
CUT_RANGES = 1 << 16  # over a whole table
UNSORTED = 200  # spark.shuffle.sort.bypassMergeThreshold


def hash_range(order: Column, ranges: Column | int) -> Column:
    """Range number of a 60-bit hash; hashes are uniform, so ranges are even."""
    width = F.lit(SPAN60 // ranges) if isinstance(ranges, int) else F.lit(float(SPAN60)) / ranges
    return F.floor(order / width).cast("bigint")


def ranges_for(df: DataFrame, groups: Sequence[str], rows: int = RANGE_ROWS) -> Column:
    """How many ranges leave about `rows` rows of the largest group in each; counted, one value."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.coalesce(F.ceil(F.max("_n") / F.lit(rows)), F.lit(1)).cast("double").alias("_k")).scalar()


def rank_by_hash(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str, rows: int = RANGE_ROWS) -> DataFrame:
    """`with_rank` over a 60-bit hash, the first order column, in as many ranges as the largest group needs."""
    return with_rank(df, groups, order, hash_range(F.col(order[0]), ranges_for(df, groups, rows)), out)


def block_range(row_id: Column, block: int = 65536) -> Column:
    return F.floor(row_id / F.lit(block)).cast("bigint")


def with_rank(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], span: Column, out: str = "rank", tasks: int | None = None
) -> DataFrame:
    """0-based rank of each row in its group by `order`; `span` must be monotone in the first order column.

    `tasks` deals the ranges out to that many tasks, which adaptive execution leaves alone: wide rows
    that compress well make large tasks where it joins partitions by their compressed size.
    """
    df = df.withColumn("_span", span)
    keys = [*groups, "_span"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    if tasks is not None:
        df = df.repartition(tasks, *keys)
    joined = df.join(offsets, keys) if not groups else _null_safe(df, offsets, keys)
    return joined.withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1).drop("_span", "_offset")


def task_count(spark: SparkSession, wanted: int) -> int:
    """Tasks of a shuffle of wide rows, UNSORTED at most: up to there the writing side keeps no rows to sort."""
    return max(spark.sparkContext.defaultParallelism, min(UNSORTED, wanted))


def number_rows(df: DataFrame, order: str, out: str = "row_id", rows: int = RANGE_ROWS) -> DataFrame:
    """Dense 0-based numbers of wide rows by an id."""
    tasks = task_count(df.sparkSession, 2 * (df.count() // rows + 1))
    return with_rank(df, [], [order], block_range(F.col(order), rows), out, tasks)


def pick_by_rank(
    draws: DataFrame, pool: DataFrame, groups: Sequence[str], order: Sequence[str], at: Callable[[Column], Column],
    rows: int = RANGE_ROWS,
) -> DataFrame:
    """Each draw with the pool row at rank `at(size of its group)`; nulls where the group has no rows.

    The pool is ordered by a 60-bit hash, the first order column. Counts per range give the sizes and
    say into which range a draw falls; the pool is cut to those ranges before anything is sorted.
    """
    cut = pool.withColumn("_span", hash_range(F.col(order[0]), ranges_for(pool, groups, rows)))
    keys = [*groups, "_span"]
    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select(
        *[F.col(g).alias(f"_g{g}") for g in groups], "_span", "_n", F.sum("_n").over(whole).alias("_size"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    here = at(F.col("_size"))
    on = [F.col(g) == F.col(f"_g{g}") for g in groups]
    on += [here >= F.col("_offset"), here < F.col("_offset") + F.col("_n")]
    asked = draws.join(spans, on, "left").withColumn("_at", here - F.col("_offset")).drop(
        *[f"_g{g}" for g in groups], "_n", "_size", "_offset")
    hit = cut.join(asked.select(*keys).distinct(), keys, "left_semi")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return asked.join(hit.withColumn("_at", inside.cast("bigint")), [*keys, "_at"], "left").drop("_span", "_at")


def _null_safe(df: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = offsets.select(*[F.col(k).alias(f"_r{k}") for k in keys], "_offset")
    on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return df.join(right, on).drop(*[f"_r{k}" for k in keys])


def top_n(df: DataFrame, groups: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows per group, n small. Spark cuts each task's groups to n before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def first_by_hash(df: DataFrame, count: Column, order: str) -> DataFrame:
    """The `count` rows with the smallest 60-bit hashes; `count` is written over the row count `n`.

    A histogram of hash ranges says in which range the count is reached, and a second one, of that
    range alone, narrows it to a few hashes: each is one aggregate that the tasks merge, CUT_RANGES
    rows at most. The rows themselves are filtered by the last hash to keep, and not shuffled.
    """
    spark = df.sparkSession
    hashes = df.select(F.col(order).alias("_hash"))
    low, width, rank = 0, SPAN60, None
    while True:
        part = max(1, width // CUT_RANGES)
        inside = hashes.where((F.col("_hash") >= F.lit(low)) & (F.col("_hash") < F.lit(low + width)))
        found = inside.groupBy(F.floor((F.col("_hash") - F.lit(low)) / F.lit(part)).alias("span")).agg(F.count(F.lit(1)).alias("n")).collect()
        sizes = dict(sorted((r["span"], r["n"]) for r in found))
        if rank is None:
            total = spark.createDataFrame([(sum(sizes.values()),)], "n bigint")
            rank = total.select(count.cast("bigint").alias("k")).first()["k"]
            if rank <= 0:
                return df.where(F.lit(False))
            if rank >= sum(sizes.values()):
                return df
        for span, n in sizes.items():
            if rank <= n:
                break
            rank -= n
        low, width = low + span * part, part
        if n <= CUT_RANGES or width == 1:
            break
    near = hashes.where((F.col("_hash") >= F.lit(low)) & (F.col("_hash") < F.lit(low + width)))
    last = near.orderBy("_hash").limit(rank).agg(F.max("_hash")).first()[0]
    return df.where(F.col(order) <= F.lit(last))
