"""Padding moves rows once, as texts."""

from checks import catalog


def test_padding_shuffles_texts_alone(spark):
    plan = catalog.QUERIES["pad_batches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" in plan.split("Exchange")[0]
