"""Periodic runs: trees, common extensions and runs against brute force; the query against its contract."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lumenfold.llm import queries, runs

SCHEMA = "doc_id long, text string, runs string, n_words string"


def brute(s, min_length=6, min_exponent=4):
    n, found = len(s), []
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            if s[i] != s[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            size = j - i + p
            shorter = any(p % d == 0 and all(s[i + k] == s[i + k + d] for k in range(size - d)) for d in range(1, p))
            if size >= max(min_length, min_exponent * p) and not shorter:
                found.append((i, size, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _sequences(count, seed):
    draw = random.Random(seed)
    for _ in range(count):
        n, letters = draw.randint(0, 70), draw.choice([1, 2, 3, 6])
        s = [draw.randrange(letters) for _ in range(n)]
        if n and draw.random() < 0.5:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randint(2, 9)
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
        yield s
    yield [0, 1] * 40 + [2] + [0, 1, 1] * 20 + [1] * 9


def test_common_extensions_equal_brute_force():
    for s in _sequences(40, 1):
        if not s:
            continue
        ahead = runs.Extensions([x + 1 for x in s])
        assert ahead.rank.tolist() == np.argsort(np.array(sorted(range(len(s) + 1), key=lambda i: s[i:]))).tolist()
        i, j = np.meshgrid(np.arange(len(s)), np.arange(len(s)))
        i, j = i[i != j], j[i != j]
        want = [next((k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k]), len(s)) for a, b in zip(i.tolist(), j.tolist())]
        assert ahead.common(i, j).tolist() == want


def test_range_minima_of_every_range():
    values = np.random.default_rng(0).integers(0, 99, 150).astype(np.int32)
    table = runs.RangeMin(values)
    pairs = np.array([(a, b) for a in range(150) for b in range(a, 150)])
    assert table.query(pairs[:, 0], pairs[:, 1]).tolist() == [values[a : b + 1].min() for a, b in pairs]


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (3, 3), (5, 2)])
def test_runs_and_stretches_equal_brute_force(least):
    sequences = list(_sequences(120, 2))
    for s in sequences:
        assert [tuple(r) for r in runs.runs_of(np.array(s, np.int64), *least).tolist()] == brute(s, *least)
    codes = np.array([x for s in sequences for x in s], np.int64)
    ends = np.cumsum([len(s) for s in sequences])
    found = []
    for a, b in runs.stretches(codes, ends, *least):
        assert np.searchsorted(ends, a, side="right") == np.searchsorted(ends, b - 1, side="right")
        found += [(a + x, n, p) for x, n, p in runs.runs_of(codes[a:b], *least).tolist()]
    assert sorted(found) == sorted((e - len(s) + x, n, p) for s, e in zip(sequences, ends.tolist()) for x, n, p in brute(s, *least))


def test_stretches_leave_prose_out():
    draw = random.Random(3)
    codes = np.array([draw.randrange(2000) for _ in range(20000)] * 3, np.int64)
    assert runs.stretches(codes, np.array([len(codes)]), 6, 4) == []


def _contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_the_query_keeps_its_contract(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, " ".join(f"w{draw.randrange(30)}" for _ in range(draw.randint(0, 90)))) for i in range(400)]
    rows += [(None, "a b " * 9), (None, None), (7, ""), (7, " \n\t"), (7, "x " * 9), (8, "no-break space " * 5), (9, "a\x0bb " * 4),
             (10, " ".join(["é"] * 3000) + " end"), (2, "one two three")]
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [_contract(*r) for r in rows]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert sum(w[1] for w in want) > 20
    none = runs.find_runs(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_other_bounds_and_wrong_ones(spark):
    docs = spark.createDataFrame([(1, "a b a b c c", "x", "y")], SCHEMA)
    got = runs.find_runs(docs, min_length=2, min_exponent=2).first()
    assert [tuple(r) for r in got["runs"]] == [(0, 4, 2), (4, 2, 1)] and got["collapsed"] == "a b c"
    with pytest.raises(ValueError):
        runs.find_runs(docs, min_exponent=1)
