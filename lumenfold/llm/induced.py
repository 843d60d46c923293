"""External induced sorting of a text's suffixes, with common-prefix lengths.

Suffixes are S (smaller than their right neighbour) or L; the leftmost S of each run are sorted
first, by naming the pieces between them and sorting the string of names. All others are induced:
buckets of symbols are priority queues in symbol order, each entry a suffix with the length it
shares with the entry before it, and a bucket is emptied in batches, which push their left
neighbours on. Queues keep a bounded part in memory and the rest in a file of the task.
"""

from __future__ import annotations

import tempfile

import numpy as np

SYMBOLS = 257  # 0 ends a piece of text; bytes are one more than they were
HELD_BYTES = 16 << 20
CLIP = 255  # at least; greater depths go up to themselves
MOST = (1 << 15) - 2  # of the type
BITS = 10
PER_KEY = 6


class Spool:
    """Arrays in memory up to a bound, then in an unnamed file that goes with the task."""

    def __init__(self, held: int = HELD_BYTES):
        self.room = held
        self.file = None

    def put(self, a: np.ndarray):
        if self.room >= a.nbytes:
            self.room -= a.nbytes
            return a
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="queue-")
        at = self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(a).data)
        return at, a.dtype, len(a)

    def take(self, handle) -> np.ndarray:
        if isinstance(handle, np.ndarray):
            self.room += handle.nbytes
            return handle
        at, kind, n = handle
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Lengths:
    """Common prefixes of any two suffixes, up to `clip` symbols, by halving over window hashes."""

    def __init__(self, text: np.ndarray, clip: int = CLIP):
        from lumenfold.llm.rolling import SEEDS, Windows

        self.n, self.clip = len(text), clip
        values = np.random.default_rng(7).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
        self.hashes = Windows(values[text], SEEDS[1])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.astype(np.int64), b.astype(np.int64)
        got = np.zeros(len(a), dtype=np.int64)
        step = 1 << (self.clip.bit_length() - 1)
        while step:
            most = np.minimum(self.n - np.maximum(a, b), self.clip)
            end = got + step
            fits = end <= most
            e = np.where(fits, end, got)
            same = fits & (self.hashes.ranges(a + got, a + e) == self.hashes.ranges(b + got, b + e))
            got = np.where(same, end, got)
            step //= 2
        return got.astype(np.int16)


class RangeMin:
    """Smallest of any range, by a table of powers of two."""

    def __init__(self, a: np.ndarray, clip: int = CLIP):
        self.rows, self.clip = [a], clip
        width = 1
        while width * 2 <= len(a):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def ask(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of low..high, both included; the clip for empty ranges."""
        out = np.full(len(low), self.clip, dtype=np.int16)
        size = high - low + 1
        level = np.zeros(len(low), dtype=np.int64)
        level[size > 0] = np.log2(size[size > 0]).astype(np.int64)
        for k in np.unique(level[size > 0]).tolist():
            at = (level == k) & (size > 0)
            row = self.rows[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
        return out


def _types(text: np.ndarray) -> np.ndarray:
    """True for S. The end of the text is smaller than any symbol."""
    n = len(text)
    step = np.empty(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n, dtype=np.int32), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _names(text: np.ndarray, kind: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the pieces from one leftmost S to the next, both included, equal for equal pieces."""
    end = np.append(lms[1:] + 1, len(text) + 1).astype(np.int64)
    coded = np.append((text.astype(np.int64) << 1 | kind) + 2, 1)  # the end of the text is smallest
    rank = np.zeros(len(lms), dtype=np.int64)
    active = np.arange(len(lms))
    offset = 0
    while len(active):
        start = lms[active].astype(np.int64) + offset
        key = np.zeros(len(active), dtype=np.int64)
        for k in range(PER_KEY):
            inside = start + k < end[active]
            key = key << BITS | np.where(inside, coded[np.minimum(start + k, len(text))], 0)
        order = np.lexsort((key, rank[active]))
        r, k = rank[active][order], key[order]
        fresh = np.concatenate([[True], (np.diff(r) != 0) | (np.diff(k) != 0)])
        first = np.concatenate([[True], np.diff(r) != 0])
        # Ranks leave room for the members of a group: base rank + place in the group.
        place = np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))
        base = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
        rank[active[order]] = r + place - base
        size = np.diff(np.append(np.flatnonzero(fresh), len(r)))
        tied = np.repeat(size > 1, size)
        offset += PER_KEY
        more = tied & (lms[active[order]].astype(np.int64) + offset < end[active[order]])
        active = np.sort(active[order][more])
    return rank


def _sort_names(rank: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the string of names, up to `depth` symbols of the text, by doubling.
    A name stands for two symbols at least. Ranks have room for ties, as `_names` gives them."""
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    width = 1
    while 2 * width < depth * 2 and width < n:
        sorted_rank = rank[order]
        fresh = np.concatenate([[True], np.diff(sorted_rank) != 0])
        size = np.diff(np.append(np.flatnonzero(fresh), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        at = order[tied]
        after = np.full(len(at), -1, dtype=np.int64)
        inside = at + width < n
        after[inside] = rank[at[inside] + width]
        by = np.lexsort((after, sorted_rank[tied]))
        at, r, a = at[by], sorted_rank[tied][by], after[by]
        fresh = np.concatenate([[True], (np.diff(r) != 0) | (np.diff(a) != 0)])
        first = np.concatenate([[True], np.diff(r) != 0])
        place = np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))
        base = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
        order[tied] = at
        rank = rank.copy()
        rank[at] = r + place - base
        width *= 2
    return order


class _Queues:
    """One queue of (suffix, common prefix with the entry before) for each symbol."""

    def __init__(self, text: np.ndarray, spool: Spool, clip: int = CLIP):
        self.text, self.spool, self.clip = text, spool, clip
        self.items: list[list] = [[] for _ in range(SYMBOLS)]
        self.running = np.full(SYMBOLS, 0, dtype=np.int16)  # least common prefix since the last push

    def push(self, batch: np.ndarray, common: np.ndarray, left: np.ndarray) -> None:
        """Pushes the left neighbours of batch[left] in order; `common` is of the whole batch."""
        total = RangeMin(common, self.clip)
        before = self.running
        self.running = np.minimum(before, common.min())
        if not len(left):
            return
        place = batch[left] - 1
        symbol = self.text[place]
        by = np.argsort(symbol, kind="stable")
        symbol, place, left = symbol[by], place[by], left[by]
        head = np.concatenate([[True], np.diff(symbol.astype(np.int32)) != 0])
        low = np.where(head, 0, np.concatenate([[0], left[:-1] + 1]))
        share = total.ask(low, left)
        share[head] = np.minimum(share[head], before[symbol[head]])
        share = np.minimum(share + 1, self.clip).astype(np.int16)
        cuts = np.append(np.flatnonzero(head), len(symbol))
        tail = cuts[1:] - 1
        self.running[symbol[tail]] = total.ask(left[tail] + 1, np.full(len(tail), len(batch) - 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            c = int(symbol[a])
            if not self.items[c] and self.first(c):
                share[a] = 0
            self.items[c].append((self.spool.put(place[a:b].copy()), self.spool.put(share[a:b].copy())))

    def first(self, symbol: int) -> bool:
        return symbol not in self.begun

    begun: set[int]

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        got = self.items[symbol]
        if not got:
            return None
        self.items[symbol] = []
        self.begun.add(symbol)
        place, share = zip(*got)
        return np.concatenate([self.spool.take(p) for p in place]), np.concatenate([self.spool.take(s) for s in share])


def suffix_array(text: np.ndarray, depth: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` symbols at least, and the common prefix of each with
    the one before it, up to `depth` or CLIP, if that is more. `text` has symbols under SYMBOLS, of type uint16."""
    clip = max(CLIP, depth)
    if clip > MOST:
        raise ValueError(f"depth is over {MOST}")
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int16)
    kind = _types(text)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]).astype(np.int32) + 1
    lengths = Lengths(text, clip)
    if len(lms):
        lms = lms[_sort_names(_names(text, kind, lms), depth)]
    seed_common = np.zeros(len(lms), dtype=np.int16)
    if len(lms) > 1:
        seed_common[1:] = lengths.common(lms[:-1], lms[1:])
    seed_cut = np.searchsorted(text[lms], np.arange(SYMBOLS + 1))
    spool = Spool()
    try:
        large = _Queues(text, spool, clip)
        large.begun = set()
        done: list[list[tuple]] = [[] for _ in range(SYMBOLS)]
        # The end of the text is the smallest suffix.
        large.push(np.array([n], np.int32), np.zeros(1, np.int16), np.array([0]))
        last: np.ndarray | None = None

        def join(batch: np.ndarray, common: np.ndarray) -> np.ndarray:
            """The first common prefix of a batch is with the suffix handled before it."""
            common = common.copy()
            common[0] = 0 if last is None else lengths.common(last, batch[:1])[0]
            return common

        for c in range(SYMBOLS):
            while (got := large.pop(c)) is not None:
                batch, common = got
                common = join(batch, common)
                done[c].append((spool.put(batch), spool.put(common)))
                left = np.flatnonzero(batch > 0)
                left = left[~kind[batch[left] - 1]]
                large.push(batch, common, left)
                last = batch[-1:]
            a, b = int(seed_cut[c]), int(seed_cut[c + 1])
            if a < b:
                batch = lms[a:b]
                common = join(batch, seed_common[a:b])
                large.push(batch, common, np.arange(b - a))  # what precedes a leftmost S is L
                last = batch[-1:]
        small = _Queues(text, spool, clip)
        small.begun = set()
        last = None
        out, shares = [], []
        for c in range(SYMBOLS - 1, -1, -1):
            while (got := small.pop(c)) is not None:
                batch, common = got
                common = join(batch, common)
                out.append(batch), shares.append(common)
                left = np.flatnonzero(batch > 0)
                small.push(batch, common, left[kind[batch[left] - 1]])
                last = batch[-1:]
            parts = [(spool.take(p), spool.take(s)) for p, s in done[c]]
            done[c] = []
            if parts:
                batch = np.concatenate([p for p, _ in parts])[::-1]
                up = np.concatenate([s for _, s in parts])
                common = join(batch, np.concatenate([up[:1] * 0, up[1:][::-1]]))
                out.append(batch), shares.append(common)
                left = np.flatnonzero(batch > 0)
                left = left[kind[batch[left] - 1]]
                small.push(batch, common, left)
                last = batch[-1:]
    finally:
        spool.close()
    order, down = np.concatenate(out)[::-1], np.concatenate(shares)
    return order, np.concatenate([down[:0], np.zeros(1, np.int16), down[1:][::-1]])
