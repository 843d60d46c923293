"""Small helpers the operators share: kept tables, exact positions, Arrow rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401  binds pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import materialise, scratch_dir

__all__ = ["Temporary", "keep", "positions", "scratch_dir", "short_batches", "spread", "table", "text_slices"]

ROWS_PER_RANGE = 5000
BATCH_BYTES = 8 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """A written copy in the shared folder: cuts the lineage and survives lost executors."""
    return materialise(df)


class Temporary:
    """Tables that only lead to another one: deleted at the end of the block, when that one is written.

    Nothing that is used later may still read them. Where a block fails, they stay for the folder's owner.
    """

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Temporary:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_dir(self.spark)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.parquet(path)

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            return
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for path in self.paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


@contextmanager
def short_batches(spark, limit: int = BATCH_BYTES):
    """What is written inside goes to Python in Arrow batches of about `limit` bytes, not of 10,000 texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], rows: int, name: str,
              rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds `name`: the gapless position of a row in its group, from 0.

    A group is cut into hash ranges of `order`, as many as `rows` needs; ranges are counted, the
    counts summed up, and rows numbered inside their range, so a group that holds a third of all
    rows is spread over many tasks. Groups must not be null. Rows equal in `order` get positions
    in any order.
    """
    ranges = max(1, math.ceil(rows / rows_per_range))
    cut = df.withColumn("_range", F.pmod(F.xxhash64(*order), F.lit(ranges)))
    counts = cut.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    return (
        cut.join(starts, [*group, "_range"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_range", "_start")
    )


def spread(df: DataFrame, rows: int, rows_per_task: int, *keys: str) -> DataFrame:
    return df.repartition(max(1, math.ceil(rows / rows_per_task)), *keys)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about `limit` bytes of text, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
