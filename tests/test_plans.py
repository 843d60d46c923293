"""Queries against SQL on the smallest data, and properties of physical plans."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import compare
from checks.catalog import OPERATORS, ORACLES, QUERIES
from lumenfold.operators import classes, detection, metrics, mixing
from lumenfold.operators.ranking import top_n

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
# A few of each kind; CHECK_ALL=1 runs them all, as does `python -m checks.compare <dir>`.
SOME = [
    "norm_box", "fill_conversation", "bin_tokens", "caption", "gqa_qbp_bl", "vcr_qac_r", "clevr_points", "v7w_point_b",
    "prompt_by_mode", "loss_segments", "truncate_protected", "pad_batches", "similarity", "context_split",
    "two_way_ref", "eval_two_way", "episode_prompts", "detection_episodes", "interleave_chance_first", "subset_shuffled",
    "iou_accuracy", "multi_test_report", "detection_json", "class_list_files",
]
NAMES = list(QUERIES) if os.environ.get("CHECK_ALL") else SOME

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, con, name):
    assert compare.compare(spark, con, SF, name) is None


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_every_operator_has_a_query():
    letters = {"A": 13, "B": 24, "C": 21, "D": 12, "E": 17, "F": 17, "G": 9, "H": 8}
    covered = {i for ids in OPERATORS.values() for i in ids.split(",")}
    assert covered == {f"{k}{n}" for k, size in letters.items() for n in range(1, size + 1)}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["two_way_weight", "detection_episodes", "subset_shuffled", "interleave_chance_all", "iou_rows", "eval_two_way"])
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_top_n_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("class_id"), F.concat(F.lit("i"), "id").alias("image"))
    assert "WindowGroupLimit" in plan(top_n(df, ["class_id"], ["image"], 3))
    assert "WindowGroupLimit" in plan(classes._draw_images(df, ["class_id"], 3, 0, "x"))


def test_row_work_and_cycles_do_not_shuffle(spark):
    a, b = (spark.range(10).select(F.col("id").alias("row_id")) for _ in range(2))
    assert "Exchange" not in plan(mixing.interleave([a, b], sizes=[10, 10]))
    assert "Exchange" not in plan(QUERIES["caption"](spark, SF))
    scored = metrics.score_match(spark.range(5).select(F.lit("The answer is a.").alias("pred"), F.lit("Answer: a").alias("target")), lambda c: c)
    assert plan(metrics.report(scored)).count("Exchange") == 1


def test_cycles_copy_rows_where_they_are(spark):
    a, b = (spark.range(n).select(F.col("id").alias("row_id")) for n in (3, 10))
    text = plan(mixing.interleave([a, b], mixing.ALL, sizes=[3, 10]))
    assert "Exchange" not in text and "Join" not in text


def test_chance_mixture_ranks_once(spark):
    # Offsets of the blocks and ranks inside them; the range is planned for the counts and for the rows.
    text = plan(mixing.draw_plan(spark, [50, 40], [0.5, 0.5], 1))
    assert text.count("Window ") == 2 and text.count("Range (") == 2 and "Subquery" not in text


def test_only_used_columns_are_read(spark):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(QUERIES["repeat_item"](spark, SF)))
    assert schema and "o_totalprice" not in schema.group(1)


def test_annotations_are_cut_to_categories_before_they_are_shuffled(spark):
    cats = spark.range(3).select("id", F.lit("n").alias("name"))
    ann = spark.range(10).select((F.col("id") % 2).alias("category_id"))
    found = detection.usable_categories(cats, ann)
    assert "HashAggregate" in plan(found) and sorted(r["id"] for r in found.collect()) == [0, 1]
