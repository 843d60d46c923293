"""Row-wise operators on files that keep arriving.

Converters, coordinate filling, prompts and text scrubbing have no state, so they run on a
streaming DataFrame as they are. These helpers only connect a reader and a sink to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lumenfold.session import scratch_dir


def read_record_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines of files as they appear. There are no line numbers, so records carry their own `row_id`."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def convert_stream(
    records: DataFrame,
    convert: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Apply a row-wise operator and append to Parquet, exactly once per input file.

    The checkpoint must be a shared folder; by default one under `spark.checkpoint.dir`.
    """
    spark = records.sparkSession
    writer = convert(records).writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint or scratch_dir(spark))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
