"""The classifier on ids it has not seen, and the prior from the scores of all documents."""

from __future__ import annotations

import zlib

import numpy as np

from lumenfold.llm import quality

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, quality int, toxic int"


def _corpus(n, bad_share=0.25):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"{'abcdefgh'[x % 8]}o{'mnrst'[x % 5]}e" for x in rng.integers(0, 1000, 60)]
        bad = rng.random() < bad_share
        rows.append((i, " ".join(w + "&&&" if bad else w for w in words), "x"))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy_and_prior(spark):
    rows, labels = _corpus(1500)
    docs = spark.createDataFrame([*rows, (None, None, "x"), (5, "", "x")], DOCS)
    got = quality.quality(docs, spark.createDataFrame(labels[:900], LABELS)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1502 and all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] != 5]) > 0.97
    model = quality.fit(docs.select("doc_id", "text"), spark.createDataFrame(labels[:900], LABELS))
    share = np.mean([q for _, q, _ in labels])
    assert abs(model.prior - share) < 0.1


def test_counts_of_scores_cover_all_documents(spark):
    rows, _ = _corpus(300)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    w = np.random.default_rng(2).standard_normal(quality.DIM + quality.SHAPES + 3).astype(np.float32)
    f = quality.features([t for _, t, _ in rows]) @ w
    cuts = quality.prior_cuts(f)
    got = quality.score_counts(docs, w, cuts)
    assert got.sum() == 300 and np.abs(got - np.bincount(np.searchsorted(cuts, f, side="right"), minlength=len(cuts) + 1)).sum() <= 6
    assert quality.score_counts(docs.limit(0), w, cuts).sum() == 0
