"""The smallest hashes by histograms: exact, and a plan with one scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenfold.functions.draws import SPAN60, order60
from lumenfold.operators import ranking
from lumenfold.operators.ranking import first_by_hash


@pytest.mark.parametrize("ranges", [1 << 16, 7, 2])
@pytest.mark.parametrize("k", [0, 1, 499, 1000, 5000])
def test_any_count_and_any_width(spark, monkeypatch, ranges, k):
    monkeypatch.setattr(ranking, "CUT_RANGES", ranges)
    df = spark.range(1000).select("id", order60(1, F.col("id")).alias("_h"))
    want = sorted(r["_h"] for r in df.collect())[:k]
    assert sorted(r["_h"] for r in first_by_hash(df, F.lit(k), "_h").collect()) == want


def test_hashes_at_the_ends(spark):
    df = spark.createDataFrame([(0,), (SPAN60 - 1,), (5,)], "_h bigint")
    assert sorted(r["_h"] for r in first_by_hash(df, F.col("n") - 1, "_h").collect()) == [0, 5]
    assert first_by_hash(df.where("_h < 0"), F.col("n"), "_h").count() == 0


def test_the_rows_are_read_once_and_not_shuffled(spark, tmp_path):
    spark.range(500).select("id", order60(1, F.col("id")).alias("_h")).write.parquet(str(tmp_path / "t"))
    df = first_by_hash(spark.read.parquet(str(tmp_path / "t")), F.floor(F.col("n") * 0.3), "_h")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Subquery" not in plan and df.count() == 150
