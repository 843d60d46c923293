"""The prefix trie of conversations, as balanced parentheses per shard.

A conversation is a path of 16-byte turn digests. Distinct paths are sorted and cut into ranges; each
range is one shard, whose trie is written as parentheses in preorder. A range min-max index over their
excess finds where a node closes, which delimits its subtree: leaves are `()` pairs counted by rank,
members and savings are differences of cumulative sums, the smallest member a range minimum. Nodes on
a shard's first and last path may go on in other shards: such spines leave the shard as weighted paths
and are merged by the same step, until one shard is left.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import scratch

WIDTH = 16  # bytes of a turn's digest
BLOCK = 64  # parentheses in a block of the index
SHARD_NODES = 200_000
ID_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).max
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

# One value a depth: words of the turn, members that end there with their smallest id and checksum, and
# what lies below in closed subtrees: members, smallest id, children, leaves, savings.
ARRAYS = ["words", "ends", "end_id", "below_n", "below_id", "below_children", "below_leaves", "below_saved"]
SPINE = f"path binary, {', '.join(f'{a} array<long>' for a in ARRAYS)}, end_sha array<string>"
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string, node binary, parent binary")
LEVEL = f"{NODE}, spine struct<{', '.join(f.replace(' ', ': ', 1) for f in SPINE.split(', '))}>"


class Parentheses:
    """Balanced parentheses with the least and greatest excess of each block, in a tree of blocks."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = -(-max(1, len(opens)) // BLOCK)
        low = np.full(blocks * BLOCK, NO_ID, np.int64)
        low[: len(opens)] = self.excess
        self.flat = low
        high = low.copy()
        high[len(opens) :] = -1
        self.lows, self.highs = [low.reshape(blocks, BLOCK).min(axis=1)], [high.reshape(blocks, BLOCK).max(axis=1)]
        while len(self.lows[-1]) > 1:
            pad = len(self.lows[-1]) % 2
            self.lows.append(np.append(self.lows[-1], [NO_ID] * pad).reshape(-1, 2).min(axis=1))
            self.highs.append(np.append(self.highs[-1], [-1] * pad).reshape(-1, 2).max(axis=1))

    def _in_block(self, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place from `start` on, in its block, with the target's excess; -1 where there is none."""
        found = np.full(len(start), -1, np.int64)
        at, who = start.copy(), np.arange(len(start))
        last = (start // BLOCK + 1) * BLOCK
        while len(who):
            hit = self.flat[at] == target[who]
            found[who[hit]] = at[hit]
            at, who = at[~hit] + 1, who[~hit]
            inside = at < last[who]
            at, who = at[inside], who[inside]
        return found

    def findclose(self, i: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one at `i`."""
        target = self.excess[i] - 1
        found = self._in_block(i + 1, target)
        # Excess moves by one, so the first block to the right whose range holds the target holds the place.
        rest = np.flatnonzero(found < 0)
        block, level = i[rest] // BLOCK, np.zeros(len(rest), np.int64)
        goal, done = target[rest], np.zeros(len(rest), bool)
        while not done.all():  # up: right neighbours of ever wider blocks
            for lv in np.unique(level[~done]):
                here = np.flatnonzero(~done & (level == lv))
                right = block[here] + 1
                inside = right < len(self.lows[lv])
                ok = np.zeros(len(here), bool)
                even = (block[here] % 2 == 0) & inside
                ok[even] = (self.lows[lv][right[even]] <= goal[here[even]]) & (self.highs[lv][right[even]] >= goal[here[even]])
                block[here[ok]] += 1
                done[here[ok]] = True
                up = here[~ok]
                block[up] //= 2
                level[up] += 1
        while (level > 0).any():  # down: the left half if it holds the target
            for lv in np.unique(level[level > 0]):
                here = np.flatnonzero(level == lv)
                left = block[here] * 2
                ok = (self.lows[lv - 1][left] <= goal[here]) & (self.highs[lv - 1][left] >= goal[here])
                block[here] = left + ~ok
                level[here] -= 1
        found[rest] = self._in_block(block * BLOCK, goal)
        return found


def _range_min(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Minimum of values[start : start + size], size at least 1."""
    found = np.empty(len(start), values.dtype)
    table, width = values, 1
    while True:
        here = (size >= width) & (size < 2 * width)
        found[here] = np.minimum(table[start[here]], table[(start + size - width)[here]])
        if len(table) <= width:
            return found
        table, width = np.minimum(table[:-width], table[width:]), 2 * width


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    most = min(len(a), len(b)) // WIDTH
    if a[: most * WIDTH] == b[: most * WIDTH]:
        return most
    low, high = 0, most - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * WIDTH] == b[: mid * WIDTH] else (low, mid - 1)
    return low


class Shard:
    """One shard's trie in preorder, built from weighted paths in their order.

    `merged` items are spines of lower shards: every node gets a name, by which children that were
    closed there find it. Unless `final`, the nodes on the first and the last path stay open.
    """

    def __init__(self, items: Iterator[dict], merged: bool, final: bool):
        self.values: dict[str, list[int]] = {a: [] for a in ARRAYS}
        self.shas: list[str | None] = []
        self.names: dict[int, bytes] = {}
        self.paths: list[bytes] = []
        self.spines: list[list[int]] = []
        opens: list[bool] = []
        stack: list[int] = []
        states = []
        last = None
        for item in items:
            path = item["path"]
            depth = len(path) // WIDTH + 1
            keep = 0 if last is None else _common(last, path) + 1
            opens += [False] * (len(stack) - keep)
            del stack[keep:], states[keep:]
            for d in range(keep):
                self._add(stack[d], item, d)
            for d in range(keep, depth):
                state = states[-1].copy() if d else hashlib.md5(b"trie")
                state.update(path[(d - 1) * WIDTH : d * WIDTH] if d else b"")
                states.append(state)
                if merged:
                    self.names[len(self.shas)] = state.digest()
                stack.append(len(self.shas))
                opens.append(True)
                for a in ARRAYS:
                    self.values[a].append(item[a][d])
                self.shas.append(item["end_sha"][d])
            if last is None and not final:
                self._spine(path, stack, states)
            last = path
        if last is not None and not final and last != self.paths[0]:
            self._spine(last, stack, states)
        self.opens = np.array(opens + [False] * len(stack), bool)
        self.merged = merged

    def _add(self, node: int, item: dict, d: int) -> None:
        """What a further path adds to a node that is there already."""
        for a in ARRAYS[1:]:
            mine = self.values[a]
            mine[node] = min(mine[node], item[a][d]) if a.endswith("_id") else mine[node] + item[a][d]
        self.shas[node] = self.shas[node] or item["end_sha"][d]

    def _spine(self, path: bytes, stack: list[int], states: list) -> None:
        self.paths.append(path)
        self.spines.append(list(stack))
        self.names.update((v, state.digest()) for v, state in zip(stack, states))

    def rows(self) -> Iterator[dict]:
        n = len(self.shas)
        if not n:
            return
        v = {a: np.array(x, np.int64) for a, x in self.values.items()}
        paren = Parentheses(self.opens)
        at = np.flatnonzero(self.opens)
        close = paren.findclose(at)
        pre, size, depth = np.arange(n), (close - at + 1) // 2, paren.excess[at] - 1
        is_open = np.zeros(n, bool)
        for spine in self.spines:
            is_open[spine] = True
        parent = _parents(depth.tolist())
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        under = lambda x: (total := sums(x))[pre + size] - total[pre]
        members = under(v["ends"] + v["below_n"])
        smallest = _range_min(np.minimum(v["end_id"], v["below_id"]), pre, size)
        children = v["below_children"] + np.bincount(parent[1:], minlength=n)
        # A `()` pair is a leaf, but for a spine's node whose children were closed in lower shards.
        pair = self.opens & ~np.append(self.opens[1:], True)
        pair[at[v["below_children"] > 0]] = False
        rank = sums(pair)
        leaves = rank[close] - rank[at] + under(v["below_leaves"])
        saved = under(np.where(is_open, 0, (members - 1) * v["words"]) + v["below_saved"])
        for i in np.flatnonzero(~is_open).tolist():
            p = int(parent[i])
            waits = i > 0 and bool(is_open[p])
            yield {
                "conv_id": int(smallest[i]), "depth": int(depth[i]), "parent_conv_id": None if waits or not i else int(smallest[p]),
                "n_convs": int(members[i]), "n_children": int(children[i]), "n_leaves": int(leaves[i]), "saved_tokens": int(saved[i]),
                "ends_sha256": self.shas[i] or EMPTY_SHA, "node": self.names[i] if self.merged else None,
                "parent": self.names[p] if waits else None, "spine": None}
        # What closed children hold goes to their open parents, and each open node into one spine.
        hangs = np.flatnonzero(~is_open & np.append(False, is_open[parent[1:]]))
        for a, of in (("below_n", members), ("below_children", np.ones(n, np.int64)), ("below_leaves", leaves), ("below_saved", saved)):
            np.add.at(v[a], parent[hangs], of[hangs])
        np.minimum.at(v["below_id"], parent[hangs], smallest[hangs])
        told: set[int] = set()
        for path, spine in zip(self.paths, self.spines):
            new = [x not in told for x in spine]
            told.update(spine)
            item = {"path": path, "words": v["words"][spine].tolist()}
            for a in ARRAYS[1:]:
                nothing = NO_ID if a.endswith("_id") else 0
                item[a] = [x if here else nothing for x, here in zip(v[a][spine].tolist(), new)]
            item["end_sha"] = [self.shas[x] if here else None for x, here in zip(spine, new)]
            yield {**dict.fromkeys(f.split()[0] for f in NODE.split(", ")), "spine": item}


def _parents(depth: list[int]) -> np.ndarray:
    """For nodes in preorder, the last one before each that is one less deep; the root is its own."""
    trail: list[int] = []
    found = []
    for i, d in enumerate(depth):
        del trail[d:]
        found.append(trail[-1] if trail else 0)
        trail.append(i)
    return np.array(found, np.int64)


def turn_lists(conversations: DataFrame, near: Column | None = None) -> DataFrame:
    """(near, conv_id, turns): the turns of a conversation as (turn, digest, words), in their order.

    Turns are ordered by `turn`, null first, equal ones by their digest. A null role or text is an
    empty one. Rows without a conv_id belong to no conversation. What is gathered of a conversation is
    16 bytes and two numbers a turn, never its texts. Rows with equal `near` share a partition.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))
    key = F.col("conv_id").cast("long")
    rows = conversations.filter(key.isNotNull()).select(
        (key if near is None else near).alias("near"), key.alias("conv_id"), turn.alias("turn"))
    return rows.repartition("near").groupBy("near", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def _arrow(rows: Iterator[dict], schema: pa.Schema, at_most: int = 4096) -> Iterator[pa.RecordBatch]:
    for some in itertools.batched(rows, at_most):
        yield pa.RecordBatch.from_pylist(list(some), schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            yield from batch.slice(start, 1024).to_pylist()


def distinct_paths(paths: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """(path, words, ends, end_id, end_sha) of (path, words, conv_id): equal paths once.

    `end_sha` is the SHA-256 of the ids in their order, joined by commas. Rows are sorted by path and
    id over all tasks, so that copies of one path fill many; each task joins the ids of a path to
    texts of about a megabyte, and the checksum runs over those, which it must do in one place.
    """
    tasks = max(1, math.ceil(rows / per_task))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[dict]:
            held: dict | None = None
            ids: list[str] = []
            size = 0
            for r in _records(batches):
                if held is not None and (r["path"] != held["path"] or size >= ID_BYTES):
                    yield held | {"n": len(ids), "ids": ",".join(ids)}
                    held = None
                if held is None:
                    held, ids, size = {"path": r["path"], "words": r["words"], "first": r["conv_id"]}, [], 0
                ids.append(str(r["conv_id"]))
                size += len(ids[-1]) + 1
            if held is not None:
                yield held | {"n": len(ids), "ids": ",".join(ids)}

        yield from _arrow(chunks(), pa.schema([
            ("path", pa.binary()), ("words", pa.list_(pa.int64())), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())]), 256)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> Iterator[dict]:
            for _, group in itertools.groupby(_records(batches), key=lambda r: r["path"]):
                state = hashlib.sha256()
                row = next(group)
                n, out = row["n"], {"path": row["path"], "words": row["words"], "end_id": row["first"]}
                state.update(row["ids"].encode())
                for r in group:
                    n += r["n"]
                    state.update(b"," + r["ids"].encode())
                yield out | {"ends": n, "end_sha": state.hexdigest()}

        yield from _arrow(merged(), pa.schema([
            ("path", pa.binary()), ("words", pa.list_(pa.int64())), ("ends", pa.int64()), ("end_id", pa.int64()), ("end_sha", pa.string())]))

    joined = paths.repartitionByRange(tasks, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(
        join, "path binary, words array<long>, first long, n long, ids string")
    return joined.repartition(tasks, "path").sortWithinPartitions("path", "first").mapInArrow(
        digest, "path binary, words array<long>, ends long, end_id long, end_sha string")


def _weighted(rows: Iterator[dict]) -> Iterator[dict]:
    """Distinct paths as weighted ones: all that is known stands at the last depth."""
    for r in rows:
        d = len(r["path"]) // WIDTH
        yield {"path": r["path"], "words": [0, *r["words"]], "ends": [0] * d + [r["ends"]], "end_id": [NO_ID] * d + [r["end_id"]],
               "end_sha": [None] * d + [r["end_sha"]], "below_id": [NO_ID] * (d + 1),
               **dict.fromkeys(("below_n", "below_children", "below_leaves", "below_saved"), [0] * (d + 1))}


def _level(items: DataFrame, shards: int, merged: bool) -> DataFrame:
    """Nodes that the shards close, and their spines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _records(batches)
        shard = Shard(rows if merged else _weighted(rows), merged, shards == 1)
        longs = pa.list_(pa.int64())
        spine = pa.struct([("path", pa.binary()), *[(a, longs) for a in ARRAYS], ("end_sha", pa.list_(pa.string()))])
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [(f.split()[0], kinds[f.split()[1]]) for f in NODE.split(", ")]
        yield from _arrow(shard.rows(), pa.schema([*fields, ("spine", spine)]))

    return items.repartitionByRange(shards, "path").sortWithinPartitions("path").mapInArrow(run, LEVEL)


def prefix_trie(lists: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row for each distinct sequence of first turns (a node; the root has none).

    `lists` has (conv_id, turns) as `turn_lists` makes them, one row a conversation; one without turns
    ends at the root. A node's conv_id is its smallest member, n_leaves and saved_tokens are over its
    subtree (itself included), saved_tokens counts each node's (n_convs - 1) times the words of its last
    turn, and ends_sha256 is of the members that end there. No conversations, no nodes.

    One shard holds about `shard_nodes` turns of distinct paths, whatever the number of copies; a
    conversation's digests stand in one row.
    """
    digests = F.transform("turns", lambda t: F.hex(t["digest"]))
    paths = scratch.keep(lists.select(
        "conv_id", F.unhex(F.array_join(digests, "")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")))
    items = scratch.keep(distinct_paths(paths, paths.count()))
    levels, merged = [], False
    while True:
        rows, nodes = items.agg(F.count(F.lit(1)), F.sum(F.size("words") + 1)).first()
        shards = max(1, math.ceil((nodes or 0) / shard_nodes))
        # Spines are two a shard: fewer shards than rows on every level, so that levels come to an end.
        shards = min(shards, max(1, rows // 8)) if merged else shards
        level = scratch.keep(_level(items, shards, merged))
        levels.append(level.filter("spine is null").drop("spine"))
        if shards == 1:
            break
        items, merged = level.filter("spine is not null").select("spine.*"), True
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.union(level)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if len(levels) == 1:
        return nodes.select(*columns)
    names = nodes.filter("node is not null").select(F.col("node").alias("parent"), F.col("conv_id").alias("_of"))
    waiting = nodes.filter("parent is not null").join(names, "parent").withColumn("parent_conv_id", F.col("_of"))
    return nodes.filter("parent is null").select(*columns).union(waiting.select(*columns))
