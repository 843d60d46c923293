"""Drawn neighbours by rank selection: equal to the whole ranking, for any tiling, and no table of pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import classes as cls
from lumenfold.operators import neighbour_bins as nb

SCHEMA = "class_id string, image_vec array<double>, text_vec array<double>"


def _classes(spark, n=37, copies=15):
    """A third and more of the classes have equal vectors, so that ranks are decided by their ids."""
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, n, 6))
    a[:copies], b[:copies] = a[0], b[0]
    return spark.createDataFrame([(f"c{i:03d}", a[i].tolist(), b[i].tolist()) for i in rng.permutation(n).tolist()], SCHEMA)


def _rows(df):
    return sorted(tuple(r) for r in df.select("class_id", "bin", "neighbor_id").collect())


def test_every_tiling_equals_the_ranking(spark):
    df = _classes(spark)
    want = _rows(nb.from_ranking(cls.rank_neighbours(cls.similarity(df, 2)), 5, seed=3))
    assert len(want) == 37 * 5
    for blocks in (1, 3):
        assert _rows(nb.drawn_neighbours(df, 5, seed=3, blocks=blocks)) == want


def test_draws_stay_in_their_bins(spark):
    bounds = nb.bin_bounds(22, 5)
    assert bounds == [(1, 5), (5, 10), (10, 15), (15, 20), (20, 22)]
    ranks = spark.range(300).select(nb.drawn_ranks(bounds, 0, F.col("id")).alias("r")).collect()
    for k, (low, high) in enumerate(bounds):
        assert {r.r[k] for r in ranks} == set(range(low, high))


def test_bins_that_do_not_fit(spark):
    with pytest.raises(ValueError, match="do not fit"):
        nb.bin_bounds(100, 36)
    with pytest.raises(ValueError, match="first of 36 bins"):
        nb.bin_bounds(36, 36)


def test_a_tile_sends_counts_not_pairs(spark):
    import pandas as pd

    df = _classes(spark, 37)
    rows = [(i, list(r["image_vec"]) + list(r["text_vec"])) for i, r in enumerate(sorted(df.collect(), key=lambda r: r["class_id"]))]
    side = lambda k: pd.DataFrame({"_i": [i for i, _ in rows], "vec": [v for _, v in rows], "asked": [[0]] * len(rows), "side": k})
    counts = nb._counted_tile(37, 27, 4)(pd.concat([side(0), side(1)]))
    assert counts.groupby("_i")["n"].sum().tolist() == [37] * 37 and counts.groupby("_i").size().max() <= 16


def test_train_records_plan_has_no_ranking(spark):
    df = _classes(spark)
    plan = nb.drawn_neighbours(df, 5, blocks=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "score" not in plan and "Window" not in plan


def test_class_vectors_by_partial_sums(spark):
    rows = [(c, f"i{k}", None if k % 7 == 3 else [float(k), None if k % 5 == 0 else 2.0 * k, 1.0][: 2 + (c != 2)]) for c in (1, 2, None) for k in range(12)]
    df = spark.createDataFrame(rows, "class_id long, image string, embedding array<float>").repartition(4)
    got = {r["class_id"]: r["embedding"] for r in cls.class_embedding(df, 100).collect()}
    assert set(got) == {1, 2}
    for c in (1, 2):
        kept = [v for i, _, v in rows if i == c and v is not None]
        for d in range(len(got[c])):
            xs = [v[d] for v in kept if v[d] is not None]
            assert abs(got[c][d] - sum(xs) / len(xs)) < 1e-9
    plan = cls.class_embedding(df, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Generate" not in plan
    few = cls.class_embedding(df.where("class_id = 1"), 2).first()["embedding"]
    chosen = [x for x in got[1]]
    assert len(few) == len(chosen) == 3
