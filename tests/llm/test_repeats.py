"""Long strings and hot anchors of the suffix-array operator."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from lumenfold.llm import induced, suffixes

SCHEMA = "doc_id long, text string"


def _by_brute_force(rows, length):
    counts = Counter(t[s : s + length] for _, t in rows for s in range(len(t) - length + 1))
    return {(i, sum(any(counts[t[s : s + length]] > 1 for s in range(max(0, q - length + 1), min(q, len(t) - length) + 1)) for q in range(len(t)))) for i, t in rows}


def _common_line(number: int, length: int):
    """One line with different surroundings, so that its anchor has as many different runs as rows."""
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    line, half = letters(length * 2), letters(length)
    return [(i, letters(30) + (line if i % 3 else half + line[:length - 10]) + letters(30)) for i in range(number)]


def test_a_hot_anchor_is_not_sorted_in_one_shard(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000)
    largest = []

    def watched(contexts, length, shards, search=suffixes._search):
        sizes = [r["n"] for r in contexts.groupBy("shard").agg({"context": "count"}).toDF("shard", "n").collect()]
        largest.append(max(sizes, default=0))
        return search(contexts, length, shards)

    monkeypatch.setattr(suffixes, "_search", watched)
    rows = _common_line(60, 60)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=60).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in got} == _by_brute_force(rows, 60)
    assert largest[0] < 60


def test_queues_that_spill(monkeypatch):
    opened = []
    temporary = induced.tempfile.TemporaryFile
    monkeypatch.setattr(induced.tempfile, "TemporaryFile", lambda **k: opened.append(k) or temporary(**k))
    monkeypatch.setattr(induced.Spool.__init__, "__defaults__", (64,))
    t = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint16)
    order, _ = induced.suffix_array(t)
    assert opened and order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("length", [200, 300])
def test_repeats_inside_different_runs_at_any_length(spark, length):
    rows = _common_line(6, length)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=length).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in got} == _by_brute_force(rows, length)


def test_a_length_over_the_type_is_an_error():
    with pytest.raises(ValueError):
        suffixes.repeated_starts([b"a" * 10], 40_000)
