"""Stages of corpus_pipeline over small tables."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import simhash, similar

SCHEMA = "doc_id long, text string"


def _edited(words: list[str], edits: int, rng: np.random.Generator) -> list[str]:
    out = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        out[at] = f"new{rng.integers(1 << 40)}"
    return out


@pytest.mark.parametrize("bucket", [32, 2])
def test_near_copies_from_0_8_on(spark, monkeypatch, bucket):
    monkeypatch.setattr(similar, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    rows, alike = [], 0
    for i in range(60 if bucket == 32 else 12):
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, 200)]
        rows.append((10 * i, " ".join(base)))
        for j in range(1, 7):
            rows.append((10 * i + j, " ".join(_edited(base, j, rng))))
    sets = {d: similar.shingle_set(t) for d, t in rows}
    parent = {d: d for d, _ in rows}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, _ in rows:
        for b in range(a + 1, a // 10 * 10 + 7):
            if similar.alike(sets[a], sets[b]):
                alike += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert alike > len(rows) / 2 and got == {d for d, _ in rows if root(d) == d}


def test_a_full_band_with_unlike_texts(spark):
    """Copies of one text with edits of their own, and texts that only share a passage with it."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in range(100)]
    rows = [(0, " ".join(base))] + [(i, " ".join(_edited(base, 1, rng))) for i in range(1, 80)]
    rows += [(1000 + i, " ".join(base[:60] + [f"own{i}-{x}" for x in range(40)])) for i in range(80)]
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {0, *range(1000, 1080)}


def test_near_copies_with_null_and_repeated_ids(spark):
    words = [[f"{k}{x}" for x in range(60)] for k in "abcd"]
    a, b, c, d = (" ".join(w) for w in words)
    # Component a has ids, b and c only null ones; id 1 stands for a and for a second d.
    rows = [(1, a), (None, a + " x"), (None, b), (None, b + " x"), (None, c), (0, d), (1, d + " x"), (5, None), (4, " ")]
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    kept_b = [t for i, t in got if i is None and t.startswith("b0")]
    assert len(got) == 5 and len(kept_b) == 1 and {(1, a), (None, c), (0, d), (4, " ")} < set(got)


def test_simhash_components_with_null_and_repeated_ids(spark):
    rows = [(1, "a b c d"), (None, "a b c d"), (None, "e f g h"), (None, "e  f g h"), (None, "i j k l"), (0, "m n o p"), (1, "m n o p")]
    got = [tuple(r) for r in simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 4 and {(1, "a b c d"), (None, "i j k l"), (0, "m n o p")} < set(got)


def test_contamination_is_judged_by_row(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(12))
    spark.createDataFrame([("t", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {item} it is"), (None, "a clean text"), (7, item), (7, "another clean text"), (8, None)]
    got = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(None, "a clean text"), (7, "another clean text"), (8, None)}


def test_near_copies_come_from_simhash_rings(spark):
    """Pairs by ring keys and chain budgets are those of all pairs that share a segment and stay within the budgets."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in range(150)]
    sets = [similar.shingle_set(" ".join(_edited(base, int(k) % 5 + 1, rng))) for k in range(60)]
    sets += [similar.shingle_set(" ".join(f"v{k}-{x}" for x in range(90))) for k in range(40)]
    fps = [similar.fingerprint_of(s) for s in sets]
    key, after = similar.ring_keys(np.frombuffer(b"".join(fps), np.uint8).reshape(-1, similar.BITS // 8))
    want = {(a, b) for a in range(100) for b in range(a + 1, 100)
            if any(key[a, s] == key[b, s] and similar.chain_holds(after[a, s : s + 1], after[b, s : s + 1])[0] for s in range(similar.SEGMENTS))}
    heads = spark.createDataFrame(list(enumerate(fps)), "node long, fp binary")
    found = similar._paired(similar._keys(heads).repartition(3, "key"), 100).collect()
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in found} == want and len(want) > 500
    full = similar._paired(similar._keys(heads).repartition(3, "key"), 2).filter("b is null").select("key", "after", F.col("a").alias("node"))
    across = similar._across(full.withColumn("root", F.col("node"))).collect()
    sizes = Counter(key.ravel().tolist())
    want = {(a, b) for a, b in want if any(key[a, s] == key[b, s] and sizes[key[a, s]] > 2 and similar.chain_holds(after[a, s : s + 1], after[b, s : s + 1])[0]
                                           for s in range(similar.SEGMENTS))}
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in across} == want
    alike = [(a, b) for a in range(60) for b in range(a) if similar.alike(sets[a], sets[b])]
    near = similar._near(spark.createDataFrame(alike, "a long, b long"), heads).collect()
    assert len(near) == len(alike) > 50


def test_recall_of_the_rings_from_0_8_on():
    rng = np.random.default_rng(4)
    found = asked = 0
    for k in range(300):
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, 200)]
        a, b = (similar.shingle_set(" ".join(w)) for w in (base, _edited(base, 4, rng)))
        if similar.alike(a, b):
            fps = np.frombuffer(similar.fingerprint_of(a) + similar.fingerprint_of(b), np.uint8).reshape(2, -1)
            key, after = similar.ring_keys(fps)
            chain = (key[0] == key[1]) & similar.chain_holds(after[0], after[1])
            found += bool(chain.any() and np.bitwise_count(fps[0] ^ fps[1]).sum() <= similar.MOST)
            asked += 1
    assert asked > 200 and found >= 0.98 * asked


def test_bins_leave_out_no_alike_pair():
    rng = np.random.default_rng(8)
    kept = Counter()
    for k in range(400):
        n = int(rng.integers(10, 3000)) if k % 2 else 200
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, n)] * (1 + k % 3)
        a, b = (similar.shingle_set(" ".join(_edited(base, int(n * rng.uniform(0, 0.03)), rng))) for _ in range(2))
        bins = np.frombuffer(similar.bins_of(a) + similar.bins_of(b), np.uint8).reshape(2, -1)
        kept[similar.alike(a, b), bool(similar.can_be_alike(bins[:1], bins[1], np.array([len(a) + len(b)]))[0])] += 1
    assert not kept[True, False] and kept[True, True] > 50 and kept[False, False] > kept[False, True]
    # A bin that overflows makes sets look closer, not further.
    big = np.arange(0, 400 * similar.BINS, similar.BINS, dtype=np.uint64)
    full = np.frombuffer(similar.bins_of(big), np.uint8)
    assert full[0] == 255 and similar.can_be_alike(full[None, :], full, np.array([2 * len(big)]))[0]


@pytest.mark.parametrize("bucket", [32, 4])
def test_pairs_of_a_family_follow_its_size(spark, monkeypatch, bucket):
    """Near copies of one text, some of them too far from all others: brute force's rows, from few pairs."""
    monkeypatch.setattr(similar, "BUCKET", bucket)
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in range(200)]
    rows = [(i, " ".join(_edited(base, 2 if i % 3 else 5, rng))) for i in range(240)]
    sets = [similar.shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))
    links = [(a, b) for b in range(len(rows)) for a in range(b) if similar.alike(sets[a], sets[b])]
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    asked = []
    checked = similar._checked

    def counted(pairs, of):
        asked.append(pairs.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count())
        return checked(pairs, of)

    monkeypatch.setattr(similar, "_checked", counted)
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {d for d, _ in rows if root[d] == d} and len(links) > 8000 and 5 < len(got) < 120
    assert sum(asked) < 15 * len(rows)
