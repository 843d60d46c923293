"""Chance mixtures placed row by row equal the drawn plan, whatever the block, without a join."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import mixing
from lumenfold.operators.ranking import number_rows


def _sets(spark, sizes):
    return [spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit(f"s{k}."), "id").alias("tag")) for k, n in enumerate(sizes)]


@pytest.mark.parametrize("rule", [mixing.FIRST, mixing.ALL])
@pytest.mark.parametrize("sizes, p", [((1, 300, 40), (0.5, 0.3, 0.2)), ((70, 5), (0.1, 0.9)), ((9, 9), (1.0, 0.0))])
def test_rows_stand_where_the_plan_says(spark, rule, sizes, p):
    if rule == mixing.ALL and 0.0 in p:
        pytest.skip("never ends")
    plan = mixing.draw_plan(spark, sizes, p, 3, rule)
    want = sorted((r.mix_id, r.source, r.row_id, f"s{r.source}.{r.row_id}") for r in plan.collect())
    steps = mixing.draw_steps(spark, sizes, p, 3, rule)
    assert len(want) == steps
    for block in (7, 1 << 14):
        got = mixing._placed(_sets(spark, sizes), sizes, steps, p, 3, block).select("mix_id", "source", "row_id", "tag")
        assert sorted(map(tuple, got.collect())) == want


def test_no_join_and_no_hot_key(spark):
    sizes, p = (1, 30000), (0.5, 0.5)
    df = mixing.interleave_by_chance(_sets(spark, sizes), p, 3, mixing.ALL, sizes)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = mixing._copies(_sets(spark, sizes)[0], 1, 30000)
    assert rows.count() == 30000 and rows.select("_k").distinct().count() == 30000
    keys = rows.groupBy(F.floor(F.col("_k") / 8192)).count().collect()
    assert max(r["count"] for r in keys) <= 8192 and df.where("source = 0").count() > 29000


def test_other_columns_are_kept(spark):
    a = spark.range(5).select(F.col("id").alias("row_id"), F.array(F.struct(F.col("id").alias("x"))).alias("deep"))
    b = spark.range(5).select(F.col("id").alias("row_id"), F.lit("t").alias("only"))
    got = mixing.interleave_by_chance([a, b], [0.5, 0.5], 1).collect()
    assert all((r.deep[0].x == r.row_id) if r.source == 0 else (r.only == "t" and r.deep is None) for r in got)


def test_tasks_follow_the_rows_not_their_compressed_size(spark, monkeypatch):
    """Rows that compress to next to nothing are not joined to a few large partitions."""
    monkeypatch.setattr(mixing, "PLACED", 500)
    monkeypatch.setattr(mixing, "DRAWS", 128)
    wide = [d.withColumn("pad", F.repeat(F.lit("x"), 200)) for d in _sets(spark, (20000, 20000))]
    ranked = number_rows(wide[0].withColumnRenamed("row_id", "record").repartition(3), "record", rows=1000)
    assert ranked.rdd.getNumPartitions() >= 40
    assert [r["row_id"] == r["record"] for r in ranked.select("row_id", "record").collect()] == [True] * 20000
    mixed = mixing.interleave_by_chance(wide, (0.5, 0.5), 3)
    sizes = mixed.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 40 and max(r["count"] for r in sizes) < 4000
