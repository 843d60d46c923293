"""Vectors of unusual lengths and parts with few vectors."""

from __future__ import annotations

import numpy as np

from lumenfold.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>"


def test_one_short_vector_leaves_the_others(spark):
    x = np.random.default_rng(0).standard_normal((120, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = neighbours.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    got = neighbours.nearest(spark.createDataFrame([*rows, (500, [1.0, 2.0])], SCHEMA)).collect()
    assert len(want) == 15 and sorted(got) == sorted(want)
