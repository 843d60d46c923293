"""Window hashes and anchors over many texts at once, in numpy.

A window of consecutive symbols is hashed by differences of prefix sums modulo 2**64. Its anchor is
the smallest hash of the short grams inside it: equal windows have equal anchors at equal offsets,
so a sequence that occurs n times has an anchor that occurs n times at least, at places of its own.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash

SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ALL = np.uint64((1 << 64) - 1)
LONG_WORD = 256
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n, kept for the largest n so far."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        base = (seed | 1) & ((1 << 64) - 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[seed] = have = (out[0], out[1])
    return have


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


class Windows:
    """Hashes of any range of `values` in constant time each."""

    def __init__(self, values: np.ndarray, seed: int):
        up, self.down = powers(seed, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def slide(values: np.ndarray, span: int, pick=np.minimum) -> np.ndarray:
    """Smallest (or largest) of every `span` neighbours."""
    n = len(values) - span + 1
    if n <= 0:
        return values[:0]
    width = 1
    while width * 2 <= span:
        values = pick(values[:-width], values[width:])
        width *= 2
    return pick(values[:n], values[span - width : span - width + n])


def anchors(grams: np.ndarray, span: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor hash of each window of `span` grams, and the gram places that are an anchor of a
    valid window. Gram hashes must not be 0."""
    least = slide(grams, span)
    seen = np.zeros(len(least) + 2 * (span - 1), dtype=np.uint64)
    seen[span - 1 : span - 1 + len(least)] = np.where(valid, least, 0)
    top = slide(seen, span, np.maximum)
    return least, np.flatnonzero(grams[: len(top)] == top)


class Words:
    """Words of several texts: bytes, places, the text of each word, and a hash for each seed.

    `between` marks the bytes between words, a line end among them.
    """

    def __init__(self, texts: list[bytes], between: np.ndarray = WHITE):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        edge = np.diff(between[self.data].view(np.int8), prepend=np.int8(1))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.text = np.searchsorted(ends, self.starts, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def hashes(self, seed: int) -> np.ndarray:
        """64 bits a word: eight bytes at a time through the finaliser, long words by XXH64.

        A polynomial of the bytes would not do here: modulo 2**64 some long words have one value for any base.
        """
        size = self.ends - self.starts
        h = mix(size.astype(np.uint64) + np.uint64(seed))
        wide = packed(self.data)
        left, k = np.flatnonzero(size <= LONG_WORD), 0
        while len(left):
            rest = np.minimum(size[left] - 8 * k, 8).astype(np.uint64)
            chunk = wide[self.starts[left] + 8 * k] & (ALL >> (np.uint64(64) - np.uint64(8) * rest))
            h[left] = mix(h[left] ^ chunk)
            k += 1
            left = left[size[left] > 8 * k]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), seed=seed)
        return h
