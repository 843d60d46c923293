"""Session helpers: settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change plans, not results. Cluster defaults win where they are set.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "lumenfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` overrides, `master` is for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**TUNING, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, root: str | None = None) -> str:
    """A new path under `root`, else under the session's shared checkpoint folder.

    That is `spark.checkpoint.dir`, or what `sparkContext.setCheckpointDir` was given. Only a local
    session may have neither: it gets a temporary folder. On a cluster executors would each write to
    their own disk there, so that is an error.
    """
    root = root or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lumenfold-{uuid.uuid4().hex}"


def materialise(df: DataFrame, root: str | None = None) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    Cuts the lineage with a table in the shared folder, which survives lost executors. The folder's
    owner clears it: the table must outlive every frame that reads it.
    """
    path = scratch_dir(df.sparkSession, root)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
