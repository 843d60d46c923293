"""What is written or predicted twice counts once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import metrics
from lumenfold.sources import sinks

SCHEMA = "test_set string, row_id bigint, pred string, target string"


def _rows(spark, n, name="a"):
    return spark.createDataFrame([(name, k, f"p{k}", None if k % 2 else f"t{k}") for k in range(n)], SCHEMA)


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.read_predictions(spark, path).count() == 0
    assert sinks.write_predictions(_rows(spark, 5), path, "one/1") and not sinks.write_predictions(_rows(spark, 9), path, "one/1")
    assert sinks.write_predictions(_rows(spark, 3, "7"), path, "one/2")
    got = sinks.read_predictions(spark, path)
    assert got.columns == ["test_set", "row_id", "pred", "target"]
    assert sorted(map(tuple, got.select("test_set", "row_id").collect())) == [("7", k) for k in range(3)] + [("a", k) for k in range(5)]


def test_an_attempt_that_breaks_off_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    broken = _rows(spark, 5).withColumn("pred", F.when(F.col("row_id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("pred")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_predictions(broken, path, "b")
    assert sinks.read_predictions(spark, path).count() == 0
    assert sinks.write_predictions(_rows(spark, 5), path, "b") and sinks.read_predictions(spark, path).count() == 5


def test_a_stream_that_repeats_a_batch(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    _rows(spark, 6).write.json(source)
    for attempt in ("first", "again"):
        query = (
            spark.readStream.schema(SCHEMA).json(source).writeStream.trigger(availableNow=True)
            .option("checkpointLocation", str(tmp_path / attempt))
            .foreachBatch(lambda df, n: sinks.write_predictions(df, path, f"q-{n}") and None).start())
        query.awaitTermination(120)
        assert query.exception() is None
    assert sinks.read_predictions(spark, path).count() == 6


def test_one_prediction_for_a_target(spark):
    targets = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "row_id bigint, target string")
    preds = spark.createDataFrame([(0, "old", 1), (0, "new", 2), (1, "y", 1)], "row_id bigint, pred string, at int")
    got = {r.row_id: r.pred for r in metrics.align(preds, targets, newest="at").collect()}
    assert got == {0: "new", 1: "y", 2: None}
    with pytest.raises(Exception, match="several predictions for row 0"):
        metrics.align(preds.drop("at"), targets).collect()
    assert metrics.align(preds.where("row_id = 1").drop("at"), targets).count() == 3
