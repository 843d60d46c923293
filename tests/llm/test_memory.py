"""What a Python worker holds at once follows a slice of the texts, not the batch or the table."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lumenfold.llm import decontaminate, scratch, suffixes

MB = 1 << 20


class Captured:
    """Stands for a DataFrame and keeps the function that its tasks would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


@pytest.fixture(scope="module")
def batch():
    rng = np.random.default_rng(1)
    texts = [" ".join(map("w{}".format, rng.integers(0, 5000, 500))) for _ in range(2400)]
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts)], ["doc_id", "_d", "_h", "text"])


@pytest.mark.parametrize("step, most", [(lambda d: suffixes.candidate_runs(d, 200), 60), (decontaminate.build_index, 48)])
def test_arrays_of_a_slice(spark, batch, step, most):
    run = step(Captured()).run
    columns = ["_d", "_h", "text"] if most == 60 else ["doc_id", "text"]
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch.select(columns)])))
        peak = tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()
    assert rows and peak < most


def test_texts_go_to_python_in_short_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, keep = spark.conf.get(name), [], scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df: (seen.append(spark.conf.get(name)), keep(df))[1])
    docs = spark.createDataFrame([(1, "a b c " * 60), (2, "a b c " * 60), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(docs).collect()} == {1: 360, 2: 360, 3: 0}
    bench = spark.createDataFrame([("t", "b c a")], "item_id string, text string")
    assert {r["doc_id"]: r["contaminated"] for r in decontaminate.contaminated_documents(docs, bench).collect()} == {1: True, 2: True, 3: False}
    # Runs, hot anchors, cut contexts, index: all but the anchors take texts.
    assert [s == str(scratch.BATCH_BYTES) for s in seen] == [True, False, True, True] and spark.conf.get(name) == before


def test_a_task_sorts_several_small_shards(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 60_000)
    sizes = []

    def watched(contexts, length, tasks, search=suffixes._search):
        sizes.extend(r["n"] for r in contexts.selectExpr("shard", "length(context) c").groupBy("shard").agg({"c": "sum"}).toDF("shard", "n").collect())
        return search(contexts, length, tasks)

    monkeypatch.setattr(suffixes, "_search", watched)
    rng = np.random.default_rng(4)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 250)))
    shared = [word() for _ in range(300)]
    rows = [(2 * i + k, f"{'uv'[k] * 40} {w} {'xy'[k] * 40}") for i, w in enumerate(shared) for k in (0, 1)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # The spaces on both sides stand in both texts too.
    assert {r["n_removed"] for r in got} == {252} and len(sizes) > 4 and max(sizes) < 60_000
