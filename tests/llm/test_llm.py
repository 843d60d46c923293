"""Operators of the subpackage against brute force, on nulls, empty and repeated texts, and ties."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from lumenfold.llm import decontaminate, induced, neighbours, packing, quality, sharding, simhash, substrings, suffixes, tokens, warc
from lumenfold.llm.queries import WORD_TOKENIZER

BASE = " ".join(f"w{i % 37}x{i}" for i in range(120))
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace("w5x5 ", "other ")), (4, ""), (5, None), (6, "the cat sat on a mat by the old sea wall"),
    (7, "ab " * 300), (8, "Ünï çödé " * 40), (9, "short"), (9, "short"), (None, "no id here"),
]
SCHEMA = "doc_id long, text string, bytes int, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_lpt_keeps_equal_texts_together(docs, none):
    got = sharding.shard_documents(docs, shards=3).collect()
    assert len(got) == len(ROWS) and sharding.shard_documents(none).count() == 0
    of = {}
    for r in got:
        of.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in of.values())
    assert len({r["shard"] for r in got if r["doc_id"] in (1, 2)}) == 1


def test_bulk_filling_equals_the_heap():
    loads = np.array([5, 0, 9, 3])
    want = loads.copy()
    for _ in range(200):
        want[np.argmin(want)] += 7
    assert (loads + 7 * sharding._fill(loads, 7, 200) == want).all()


def test_word_windows(docs, none):
    assert substrings.remove_repeats(none).count() == 0
    got = {(r["doc_id"], r["kept_sha256"]): r for r in substrings.remove_repeats(docs, window=5).collect()}
    seen, want = set(), set()
    for i, t in sorted(set(ROWS), key=lambda r: (r[0] is not None, r[0])):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        drop = set()
        for s in range(len(w) - 4):
            key = tuple(w[s : s + 5])
            drop |= set(range(s, s + 5)) if key in seen else set()
            seen.add(key)
        want.add((i, hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in drop)).hexdigest()))
    assert set(got) == want


def test_suffix_array_is_that_of_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        t = rng.integers(0, 3, rng.integers(1, 80)).astype(np.uint16)
        order, _ = induced.suffix_array(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_byte_strings(docs, none):
    assert suffixes.remove_repeats(none).count() == 0
    counts = Counter()
    for _, t in ROWS:
        b = (t or "").encode()
        counts.update(b[s : s + 40] for s in range(len(b) - 39))
    want = Counter()
    for i, t in ROWS:
        b = (t or "").encode()
        cut = {q for s in range(len(b) - 39) if counts[b[s : s + 40]] > 1 for q in range(s, s + 40)}
        want[i, len(b), len(cut), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in cut)).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs, length=40).collect())
    assert got == want


def test_simhash_components(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and simhash.near_duplicates(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[4]["fingerprint"] == "0" * 16 and by[5]["component_id"] == 4
    # Full buckets give the same links as pairing does.
    rng = np.random.default_rng(0)
    fps = sorted({int(x) ^ (1 << int(b)) ^ (1 << int(c)) for x in rng.integers(1, 1 << 62, 3) for b, c in rng.integers(0, 20, (60, 2))})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from lumenfold.llm.components import smallest_reachable

    roots = [{(r["node"], r["root"]) for r in smallest_reachable(simhash.links(df, 2, bucket)).collect()} for bucket in (2, 10**6)]
    assert roots[0] == roots[1] and len(roots[0]) > 3


def test_phrases_and_proximity(spark, docs, none):
    items = spark.createDataFrame([("b1", "The Cat sat on a mat by the old sea wall today"), ("b2", "short"), (None, None)], "item_id string, text string")
    rows = decontaminate.contaminated_documents(docs, items).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in rows}
    assert got[6] == (11, 11, 1, True) and got[9] == (1, 1, 1, True) and got[5] == (0, 0, 0, False) and len(rows) == len(ROWS)
    assert decontaminate.contaminated_documents(none, items).count() == 0
    index = decontaminate.build_index(docs)
    assert [(r["doc_id"]) for r in decontaminate.near(index, [["cat", "mat"]], 4).collect()] == [6]


def test_tokens_and_packing(docs, none):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(WORD_TOKENIZER)
    encode = tokens.Encoder(tokens.read_tokenizer(WORD_TOKENIZER)).encode
    for t in ["It's 12 o'clock, isn't it?", "Ça va? Ünï  x.,y\n\tz", "a<|endoftext|>b", "日本 é", "", *[t for _, t in ROWS if t]]:
        assert np.frombuffer(encode(t), "<u4").tolist() == full.encode(t, add_special_tokens=False).ids
    got = packing.pack(docs, WORD_TOKENIZER, capacity=64).collect()
    assert packing.pack(none, WORD_TOKENIZER).count() == 0
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 64
    report = tokens.context_report(tokens.length_histogram(tokens.token_lengths(docs, WORD_TOKENIZER)))
    sizes = [len(encode(t)) // 4 for _, t in ROWS]
    want = [(m, sum(min(m, n) for n in sizes)) for m in (0, 5, 10**6)]
    assert [tuple(r) for r in tokens.limit_total(report, [0, 5, 10**6]).collect()] == want


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u\n", "a"), (3, None, None), (4, "v", "ü"), (4, "v", "ü")], "page_id long, url string, html string")
    for kind in ("none", "gzip"):
        path = f"file://{tmp_path}/{kind}"
        warc.write_warc(warc.page_records(pages), path, compress=kind)
        rows = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.page_digests(warc.read_warc(spark, path, verify="true")).collect())
        assert rows == [(1, 1, "response", None), (2, 1, "revisit", 1), (3, 0, "response", None), (4, 2, "response", None), (4, 2, "response", None)]
        only = warc.read_warc(spark, path, ["record_id", "record_type"]).filter("record_type = 'revisit'")
        assert [r["record_id"] for r in only.collect()] == ["<urn:page:2>"]


def test_quality_without_and_with_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality(docs, labels).collect()} == {0.5}
    rows = [(i, "Plain words of prose follow here. " * 3 if i % 4 else "&&& ### $$$ !!! " * 5, 1, "x") for i in range(300)]
    marked = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = quality.quality(spark.createDataFrame(rows, SCHEMA), marked).collect()
    assert all(r["predicted"] == bool(r["doc_id"] % 4) for r in got)
    assert quality.quality(none, marked).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).astype(float)
    x[10:20] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    first = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0)
    assert first == [(k + 1, 10 + k) for k in range(5)] and len(got) == 30
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
