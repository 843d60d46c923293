"""Results to files."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.json_object import open_store

COMMITS = "_commits"

# Header of ranked-neighbour files (fixed value: it names 80 ranks whatever the row length).
RANK_HEADER = ",".join(["cls_id\\sort_idx", *map(str, range(1, 81))])


def write_records(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """JSON lines, split into folders by `partition_by` (for example the split name)."""
    df.write.mode(mode).partitionBy(*partition_by).json(path)


def write_tables(tables: Mapping[str, DataFrame], path: str, mode: str = "error") -> dict[str, str]:
    """Each table as Parquet under its name; returns the paths."""
    out = {name: f"{path.rstrip('/')}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.mode(mode).parquet(out[name])
    return out


def write_predictions(df: DataFrame, path: str, batch: str) -> bool:
    """`row_id, pred, target` of one batch added per test set; `row_id` stands for the input order.

    A batch counts once, however often it is written: its rows go to a folder of their own, and only
    then a commit named after the batch says which folder it is. A batch that has a commit is not
    written again (the result is False), and rows of an attempt that broke off are in no commit. In a
    stream: `writeStream.foreachBatch(lambda df, n: write_predictions(df, path, f"{query}-{n}"))`.
    """
    fs, root = open_store(path)
    commit = f"{root}/{COMMITS}/{quote(batch, safe='')}"
    if fs.get_file_info(commit).type == pafs.FileType.File:
        return False
    folder = f"batch={uuid.uuid4().hex}"
    rows = df.select("test_set", "row_id", "pred", "target")
    rows.write.partitionBy("test_set").json(f"{path.rstrip('/')}/{folder}")
    fs.create_dir(f"{root}/{COMMITS}", recursive=True)
    attempt = f"{commit}.{folder[6:]}.tmp"
    with fs.open_output_stream(attempt) as out:
        out.write(folder.encode())
    # The last of several attempts at one batch counts, and it alone.
    fs.move(attempt, commit)
    return True


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """`test_set, row_id, pred, target` of the committed batches."""
    fs, root = open_store(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    folders = []
    for info in sorted(found, key=lambda i: i.path):
        if not info.base_name.endswith(".tmp"):
            with fs.open_input_stream(info.path) as f:
                folders.append(f"{path.rstrip('/')}/{f.read().decode()}")
    schema = "test_set string, row_id bigint, pred string, target string"
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch string").option("basePath", path).json(folders)
    return rows.select("test_set", "row_id", "pred", "target")


def write_ranked(ranked: DataFrame, path: str, mode: str = "error") -> None:
    """`class_id, rank, neighbor_id` as CSV lines of id and ranked ids; every file starts with the header."""
    entry = F.struct("rank", F.col("neighbor_id").cast("string").alias("id"))
    ids = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["id"])
    lines = ranked.groupBy("class_id").agg(ids.alias("ids")).select(
        F.concat_ws(",", F.col("class_id").cast("string"), F.col("ids")).alias(RANK_HEADER)
    )
    # One column under a separator that does not occur, so that commas stay plain.
    lines.write.mode(mode).option("header", True).option("sep", "\u0001").option("escapeQuotes", False).csv(path)
