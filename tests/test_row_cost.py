"""Work that belongs to a record or an item is done once for it."""

from __future__ import annotations

import pytest

from checks import catalog

SF = "/root/testdata/sf0.001"


def _plan(spark, name, kind="optimizedPlan"):
    return getattr(catalog.QUERIES[name](spark, SF)._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("name", ["vcr_pred_qac_r", "vcr_pred_qc_a_qc_r"])
def test_choices_are_listed_before_a_record_becomes_four_rows(spark, name):
    above, below = _plan(spark, name).split("Generate explode(", 1)
    assert "slice(" not in above and "slice(" in below


@pytest.mark.parametrize("name", ["vcr_pred_qac_r", "vcr_qc_a_qc_r"])
def test_boxes_are_written_once_an_item(spark, name):
    above, below = _plan(spark, name).split("Generate posexplode(", 1)
    assert "as bigint" not in above and "as bigint" in below
