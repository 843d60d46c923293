"""Maximal periodic runs of words, from the suffix trees of a stretch and of its reversal.

Every run has a Lyndon root that is the longest Lyndon word at its start, for one of the two orders of
the words. A tree built word by word (Ukkonen) gives the order of the suffixes and, through an Euler
tour with range minima, the common extension of two positions in constant time; the tree of the
reversal extends to the left. So the candidates are two a word, and each costs two lookups.

Before that, words that cannot be in any run asked for are left out: in a run each window of a few
words stands again at one period's distance, which is at most its stretch over the exponent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import scratch

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
BLOCK = 16


class RangeMin:
    """Minima of ranges in constant time: minima inside blocks, and a sparse table over the blocks."""

    def __init__(self, values: np.ndarray):
        wide = np.full(-(-max(1, len(values)) // BLOCK) * BLOCK, np.iinfo(values.dtype).max, values.dtype)
        wide[: len(values)] = values
        self.flat, blocks = wide, wide.reshape(-1, BLOCK)
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def query(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minimum of values[left..right], both ends included, left <= right."""
        found = np.minimum(self.behind[left], self.ahead[right])
        a, b = left // BLOCK, right // BLOCK
        inside = a == b
        if inside.any():
            x, y = left[inside], right[inside]
            small = self.flat[x]
            for step in range(1, BLOCK):
                small = np.minimum(small, self.flat[np.minimum(x + step, y)])
            found[inside] = small
        between = b - a - 1
        for level in range(len(self.levels)):
            here = (between >= 1 << level) & (between < 2 << level)
            if here.any():
                table = self.levels[level]
                both = np.minimum(table[a[here] + 1], table[b[here] - (1 << level)])
                found[here] = np.minimum(found[here], both)
        return found


class Tree(NamedTuple):
    starts: np.ndarray  # of the edge into a node
    stops: np.ndarray
    parents: np.ndarray
    symbols: np.ndarray  # first symbol of the edge into a node


def ukkonen(s: list[int]) -> Tree:
    """The suffix tree of `s`, whose last symbol stands nowhere else; node 0 is the root."""
    n, sigma = len(s), max(s) + 1
    start, stop, link = [0], [0], [0]
    edge: dict[int, int] = {}
    node = at = length = left = 0
    for i in range(n):
        c = s[i]
        left += 1
        fresh = 0
        while left:
            if not length:
                at = i
            key = node * sigma + s[at]
            child = edge.get(key)
            if child is None:
                edge[key] = len(start)
                start.append(i)
                stop.append(n)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                a = start[child]
                size = min(stop[child], i + 1) - a
                if length >= size:
                    at += size
                    length -= size
                    node = child
                    continue
                if s[a + length] == c:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                middle = len(start)
                start += (a, i)
                stop += (a + length, n)
                link += (0, 0)
                edge[key] = middle
                edge[middle * sigma + c] = middle + 1
                start[child] = a + length
                edge[middle * sigma + s[a + length]] = child
                if fresh:
                    link[fresh] = middle
                fresh = middle
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - left + 1
    keys = np.fromiter(edge.keys(), np.int64, len(edge))
    child = np.fromiter(edge.values(), np.int64, len(edge))
    parents, symbols = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    parents[child], symbols[child] = keys // sigma, keys % sigma
    return Tree(np.array(start), np.array(stop), parents, symbols)


class Extensions:
    """Order of the suffixes of a sequence, and the length that two of them have in common."""

    def __init__(self, s: list[int]):
        n = len(s)
        tree = ukkonen([*s, 0])  # symbols are 1 or more
        nodes = len(tree.starts)
        order = np.lexsort((tree.symbols[1:], tree.parents[1:])) + 1
        first_child = np.searchsorted(tree.parents[order], np.arange(nodes + 1)).tolist()
        children, width = order.tolist(), (tree.stops - tree.starts).tolist()
        depth, seen, tour, leaves = [0] * nodes, [0] * (n + 1), [], []
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            here = depth[v]
            a, b = first_child[v], first_child[v + 1]
            if a == b:  # a leaf: the whole suffix, its end mark included
                suffix = n + 1 - here
                seen[suffix] = len(tour)
                leaves.append(suffix)
            tour.append(here)
            for child in reversed(children[a:b]):
                depth[child] = here + width[child]
                stack += (~v, child)
        self.tour = RangeMin(np.array(tour, np.int32))
        self.at = np.array(seen)
        self.rank = np.empty(n + 1, np.int64)
        self.rank[leaves] = np.arange(n + 1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.at[i], self.at[j]
        return self.tour.query(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each position the next one with a smaller rank, else the end."""
    n = len(rank)
    found = [n] * n
    for i in range(n - 1, -1, -1):
        j, r = i + 1, rank[i]
        while j < n and rank[j] > r:
            j = found[j]
        found[i] = j
    return np.array(found, np.int64)


def runs_of(s: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """Rows (start, length, period) of the runs of `s`, by start, then period."""
    n = len(s)
    none = np.empty((0, 3), np.int64)
    if n < max(2, min_length, min_exponent):
        return none
    s = np.unique(s, return_inverse=True)[1] + 1
    ahead, back = Extensions(s.tolist()), Extensions(s[::-1].tolist())
    rank = ahead.rank[:n]
    i = np.arange(n)
    found = []
    for order in (rank, -rank):
        p = _next_smaller(order.tolist()) - i
        # No run is longer than the sequence. Under the reversed order the end mark is the greatest, so a
        # word that reaches the end need not be Lyndon; runs at the end have their roots in the first order.
        keep = (p * min_exponent <= n) & ((i + p < n) | (order is rank))
        at, period = i[keep], p[keep]
        right, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        more, less = at + period < n, at > 0
        right[more] = ahead.common(at[more], (at + period)[more])
        left[less] = back.common((n - at)[less], (n - at - period)[less])
        length = left + period + right
        good = length >= np.maximum(min_length, min_exponent * period)
        found.append(np.stack([at - left, length, period], axis=1)[good])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))] if len(rows) else none


def window_words(min_length: int, min_exponent: int) -> int:
    """The most words, at most 4, for which each window of any run stands in it again a period away."""
    sizes = [max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 2)]
    return max(1, min(4, *sizes))


def stretches(codes: np.ndarray, ends: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """Ranges of `codes` that hold every run whole; a sequence ends before each of `ends`.

    A window stays if it stands again, in its stretch, within the stretch's length over the exponent.
    Neighbouring windows that stay form the next stretches, until none changes. Windows are compared
    by hash: a collision only keeps more.
    """
    k = window_words(min_length, min_exponent)
    n = len(codes)
    if n < k:
        return []
    hashed = codes[: n - k + 1].astype(np.uint64)
    for step in range(1, k):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + codes[step : n - k + 1 + step].astype(np.uint64)
        hashed ^= hashed >> np.uint64(29)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else np.array([0])
    ranges = [(a, b - k + 1) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= min_length]
    lows = np.array([a for a, _ in ranges], np.int64)
    highs = np.array([b for _, b in ranges], np.int64)
    while len(lows):
        size = highs - lows
        part = np.repeat(np.arange(len(lows)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lows, size)
        key = hashed[at] ^ (part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key, kind="stable")
        gap = np.where(key[order][1:] == key[order][:-1], np.diff(at[order]), n)
        near = np.full(len(at), n, np.int64)
        near[order[1:]] = np.abs(gap)
        near[order[:-1]] = np.minimum(near[order[:-1]], np.abs(gap))
        stays = near <= ((size + k - 1) // min_exponent)[part]
        edge = np.diff(np.concatenate([[0], stays.astype(np.int8), [0]]))
        inner = np.flatnonzero(part[1:] != part[:-1]) + 1  # a stretch never crosses its range
        cut = inner[stays[inner - 1] & stays[inner]]
        first = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
        last = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
        long = last - first + k - 1 >= min_length
        first, last = first[long], last[long]
        if len(first) == len(lows) and (last - first).sum() == len(at):
            break
        lows, highs = (at[first], at[last - 1] + 1) if len(first) else (first, last)
    return [(a, b + k - 1) for a, b in zip(lows.tolist(), highs.tolist())]


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch with smallest period q and a
    length of at least max(min_length, min_exponent * q) that cannot be extended; `min_exponent` is 2
    or more. `collapsed` joins, by one space, the words that no run holds after its first q words.
    Null, empty and blank texts have no words: no runs, an empty `collapsed`. Rows that repeat a
    doc_id, or have none, are taken each by itself; other columns, of any name, are ignored.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period: min_exponent must be 2 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scratch.text_slices(batches):
            known: dict[bytes, int] = {}
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            codes = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
            found: list[list[dict[str, int]]] = [[] for _ in texts]
            drop: dict[int, np.ndarray] = {}
            for a, b in stretches(codes, ends, min_length, min_exponent):
                doc = int(np.searchsorted(ends, a, side="right"))
                base = a - int(ends[doc] - sizes[doc])
                for start, length, period in (runs_of(codes[a:b], min_length, min_exponent) + [base, 0, 0]).tolist():
                    found[doc].append({"start": start, "length": length, "period": period})
                    drop.setdefault(doc, np.zeros(len(texts[doc]), bool))[start + period : start + length] = True
            for doc, gone in drop.items():
                texts[doc] = [w for w, g in zip(texts[doc], gone.tolist()) if not g]
                found[doc].sort(key=lambda r: (r["start"], r["period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(found, RUN_TYPE), pa.array([b" ".join(t) for t in texts], pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
