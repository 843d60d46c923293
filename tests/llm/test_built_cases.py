"""Inputs built to break hashes and keys: words that a polynomial cannot tell apart, equal tags, scattered queries."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
import xxhash

from lumenfold.llm import decontaminate, neighbours, substrings, suffixes
from lumenfold.llm.rolling import SEEDS, Words

SCHEMA = "doc_id long, text string"


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [64, 256, 257, 512, 1024, 4096])
def test_words_that_are_each_others_complement(size):
    one = _thue_morse(size)
    two = one.translate(str.maketrans("ab", "ba"))
    words = Words([f"{one} {two} {one}".encode(), one.encode()])
    for seed in SEEDS:
        a, b, c, d = words.hashes(seed).tolist()
        assert a == c == d != b


def test_hashes_follow_the_bytes_of_a_word_alone():
    texts = [b"a", b"ab abc", b"abcdefgh abcdefghi", b"abcdefghabcdefgh", b"x" * 300]
    apart = [h for t in texts for h in Words([t]).hashes(SEEDS[0]).tolist()]
    assert Words(texts).hashes(SEEDS[0]).tolist() == apart and len(set(apart)) == len(apart)


def test_such_words_in_op2_and_op8(spark):
    one = _thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {two}"), (3, f"{head} {one}")], SCHEMA)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs, window=20).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    nine = " ".join(f"v{i}" for i in range(9))
    items = spark.createDataFrame([(7, f"{nine} {one}")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {nine} {two} y"), (2, f"x {nine} {one} y")], SCHEMA)
    assert {r.doc_id: r.n_hit for r in decontaminate.contaminated_documents(docs, items, window=10).collect()} == {1: 0, 2: 10}


def test_runs_that_are_each_others_complement_in_op9(spark):
    one = _thue_morse(4096)
    two = one.translate(str.maketrans("ab", "ba"))
    texts = {1: one, 2: two}
    seen = {}
    for i, t in texts.items():
        for k in range(len(t) - 199):
            seen.setdefault(t[k : k + 200], []).append((i, k))
    want = {i: set() for i in texts}
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                want[i] |= set(range(k, k + 200))
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeats(spark.createDataFrame(list(texts.items()), SCHEMA), length=200).collect()}
    assert got == {i: len(x) for i, x in want.items()}


def _equal_low_bits(make, bits=32):
    """Two texts whose hashes agree in their low bits, by search."""
    seen: dict[int, str] = {}
    for k in range(400_000):
        text = make(k)
        low = xxhash.xxh64_intdigest(text.encode(), seed=42) & ((1 << bits) - 1)
        if low in seen:
            return seen[low], text
        seen[low] = text
    return None


@pytest.mark.parametrize("doc_id", [7, None])
def test_texts_of_one_id_with_equal_tags(spark, doc_id):
    tail = " ".join(f"t{i}" for i in range(39))
    pair = _equal_low_bits(lambda k: f"n{k} {tail}")
    if pair is None:
        pytest.skip("no pair among the texts tried")
    # The first words differ; one of the two is copied elsewhere under a smaller id.
    rows = [(1, pair[0]), (doc_id, pair[0]), (doc_id, pair[1])]
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=40).collect()
    if doc_id is None:  # before any other id: the copy under id 1 is the later one
        assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 40), (True, 0), (True, 0)]
    else:
        kept = {r.kept_sha256: r.n_removed for r in got if r.doc_id == 7}
        assert kept == {hashlib.sha256(b"").hexdigest(): 40, hashlib.sha256(pair[1].encode()).hexdigest(): 0}
    nine = {(r.doc_id, r.n_bytes, r.kept_sha256): r.n_removed for r in suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=len(pair[0])).collect()}
    whole = [n for (i, size, sha), n in nine.items() if sha == hashlib.sha256(pair[1].encode()).hexdigest()]
    assert whole == [0]


def _recall(spark, x, every=50, k=5, **options):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got: dict[int, list[int]] = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=every, k=k, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, len(x), every):
        sims = unit @ unit[q]
        sims[q] = -9
        hits += len(set(np.argsort(-sims, kind="stable")[:k].tolist()) & set(got.get(q, [])))
        total += k
    assert set(got) == set(range(0, len(x), every)) and all(len(v) == k for v in got.values())
    return hits / total


def test_every_query_has_its_rows_and_recall_holds(spark):
    rng = np.random.default_rng(0)
    assert _recall(spark, rng.standard_normal((3000, 16))) >= 0.9
    tight = rng.standard_normal((3, 16))[rng.integers(0, 3, 3000)] + 0.001 * rng.standard_normal((3000, 16))
    tight[::50] = rng.standard_normal((60, 16))
    # Of all vectors, and of a third of them in the sample.
    assert _recall(spark, tight) >= 0.9 and _recall(spark, tight, sample=1000) >= 0.9
