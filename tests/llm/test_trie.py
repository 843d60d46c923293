"""The prefix trie against a dictionary of prefixes, in one shard and in many."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenfold.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, near string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(paths):
    """`paths`: conversation id to its turns (role, text)."""
    members, ends, words = defaultdict(set), defaultdict(list), {(): 0}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
            if d:
                words[path[:d]] = len(re.findall(r"[^\x20\x09-\x0D]+", path[d - 1][1]))
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * words[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def ordered(rows):
    """Turns of each conversation in the order the docstring states."""
    found = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        if c is not None:
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            found[c].append(((turn is not None, turn or 0, digest), (role, text)))
    return {c: tuple(t for _, t in sorted(x, key=lambda y: y[0])) for c, x in found.items()}


def rebuilt(paths):
    found = {}
    for c, path in paths.items():
        h = zlib.crc32(str(c).encode()) % 4
        found[c] = paths.get(c - c % 20, ())[:h] + path[h:]
    return found


def _rows(seed, n=160):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.randint(1, 7)):
            text = draw.choice(["hi there", "yes", None, "", "a b  c\td", "one very common turn"]) if draw.random() < 0.8 else f"turn {draw.random()}"
            rows.append((c, draw.choice([t, t, None, 3]), draw.choice(["user", "assistant", None]), text, "x", "y"))
    rows += [(1000 + c, t, "user", f"the same {t}", "x", "y") for c in range(60) for t in range(5)]
    rows += [(2000, t, "user", f"long {t % 3}", "x", "y") for t in range(300)] + [(2005, t, "user", f"long {t % 3}", "x", "y") for t in range(200)]
    return rows + [(None, 0, "user", "no id", "x", "y"), (3, 1, "user", "yes", "x", "y"), (3, 1, "user", "yes", "x", "y")]


@pytest.fixture(scope="module")
def rows(spark):
    draw = _rows(1)
    random.Random(2).shuffle(draw)
    return draw


@pytest.mark.parametrize("shard_nodes", [200_000, 150, 20])
def test_any_number_of_shards_gives_the_same_nodes(spark, rows, shard_nodes):
    got = trie.prefix_trie(trie.turn_lists(spark.createDataFrame(rows, SCHEMA).repartition(5)), shard_nodes=shard_nodes)
    assert got.columns == COLUMNS
    assert Counter(tuple(r) for r in got.collect()) == brute(ordered(rows))


def test_the_query_keeps_its_contract(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_prefix_trie(spark, str(tmp_path)).collect()
    want = brute(rebuilt(ordered(rows)))
    assert Counter(tuple(r) for r in got) == want
    assert any(r["depth"] == 0 and r["parent_conv_id"] is None for r in got)


def test_conversations_without_turns_and_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.turn_lists(none)).count() == 0
    lists = spark.createDataFrame([(4, []), (2, [])], "conv_id long, turns array<struct<turn: long, digest: binary, words: long>>")
    assert [tuple(r) for r in trie.prefix_trie(lists).collect()] == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]


def test_findclose_equals_matching():
    draw = random.Random(5)
    for n in (1, 2, 31, 32, 33, 200, 3000):
        opens, depth, left = [True], 1, n - 1
        while depth:
            up = left and (depth == 1 or draw.random() < 0.52)
            opens.append(bool(up))
            depth += 1 if up else -1
            left -= 1 if up else 0
        stack, want = [], {}
        for i, o in enumerate(opens):
            if o:
                stack.append(i)
            else:
                want[stack.pop()] = i
        bits = np.array(opens)
        at = np.flatnonzero(bits)
        assert trie.Parentheses(bits).findclose(at).tolist() == [want[i] for i in at.tolist()]


def test_copies_fill_many_tasks(spark, monkeypatch):
    rows = [(c, t, "user", f"copy {t}", "x", "y") for c in range(500) for t in range(3)]
    lists = trie.turn_lists(spark.createDataFrame(rows, SCHEMA))
    paths = lists.selectExpr("conv_id", "unhex(array_join(transform(turns, t -> hex(t.digest)), '')) as path", "transform(turns, t -> t.words) as words")
    got = trie.distinct_paths(paths, 500, per_task=50).collect()
    assert len(got) == 1 and got[0]["ends"] == 500 and got[0]["end_id"] == 0
    assert got[0]["end_sha"] == hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
