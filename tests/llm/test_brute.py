"""Operators without SQL against plain programs over small corpora."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lumenfold.llm import decontaminate, packing, sharding, simhash
from lumenfold.llm.queries import WORD_TOKENIZER

SCHEMA = "doc_id long, text string, shard string, size string"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    words = [f"{a}{b}" for a in ("the", "sea", "Wall", "é", "run", "x9") for b in ("", "ing", "S", "-a")]
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 2, 3, 12, 40, 200]))) for _ in range(120)]
    texts += [texts[30]] * 5 + [texts[100]] * 30
    for t in texts[40:70]:
        parts = t.split()
        if len(parts) > 30:
            parts[draw.randrange(len(parts))] = "edited"
            texts.append(" ".join(parts))
    return [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (901, ""), (902, "Tab\tand\nline \x0b end")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)


def test_loads_are_those_of_longest_processing_time(docs, rows):
    got = sharding.shard_documents(docs, shards=7).collect()
    groups = defaultdict(list)
    for _, t in rows:
        groups[t].append(len((t or "").encode()) + 8)
    heap = [(0, k) for k in range(7)]
    for size in sorted((sum(v) for v in groups.values()), reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, k))
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert sorted(loads[k] for k in range(7)) == sorted(x for x, _ in heap)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)


def _fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        bits += [(h >> k) & 1 for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles)) if shingles else 0


def test_fingerprints_and_components_of_all_pairs(docs, rows):
    prints = [_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    got = simhash.near_duplicates(docs, words_per_shingle=3, max_diff=2)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == Counter(
        (i, f"{p:016x}", least[find(k)]) for k, ((i, _), p) in enumerate(zip(rows, prints)))


def test_hits_of_every_window(spark, docs, rows):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    items = [("a", " ".join((rows[100][1] or "x y z").split()[:6])), ("b", "The sea"), ("c", None), ("d", "!!"), ("e", " ".join(rows[45][1].split()[2:20])), ("b", "The sea")]
    got = decontaminate.contaminated_documents(docs, spark.createDataFrame(items, "item_id string, text string"), window=4).collect()
    want = Counter()
    for i, t in rows:
        words, hit, found = split(t), set(), set()
        for name, text in items:
            item = split(text)
            width = min(4, len(item))
            for k in range(len(item) - width + 1 if item else 0):
                for at in range(len(words) - width + 1):
                    if words[at : at + width] == item[k : k + width]:
                        hit |= set(range(at, at + width))
                        found.add(name)
        want[(i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want


@pytest.mark.parametrize("capacity", [50, 600])
def test_as_few_sequences_as_best_fit_decreasing(docs, rows, capacity):
    got = packing.pack(docs, WORD_TOKENIZER, capacity=capacity, end_id=1).collect()
    full = Tokenizer.from_file(str(WORD_TOKENIZER))
    pieces = []
    for _, t in rows:
        n = len(full.encode(t or "", add_special_tokens=False).ids) + 1
        pieces += [min(capacity, n - a) for a in range(0, n, capacity)]
    room: list[int] = []
    for size in sorted(pieces, reverse=True):
        fits = [k for k, free in enumerate(room) if free >= size]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= size
        else:
            room.append(capacity - size)
    assert sorted(r["length"] for r in got) == sorted(pieces)
    assert len({r["sequence_id"] for r in got}) == len(room)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= capacity
