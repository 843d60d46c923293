"""Reproducible randomness: every draw is a hash of its key, never of partition or task order.

`rank32` is uniform over 0..2**32-1 and serves modulo picks and probabilities; `order60` is
uniform over 0..2**60-1 and serves ordering, where ties must not happen in practice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.binding import let

SPAN32 = 1 << 32
SPAN60 = 1 << 60


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def digest(*key) -> Column:
    """md5 of the key parts joined by `|`."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in key]))


def _hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def rank32(*key) -> Column:
    return _hex(F.substring(digest(*key), 1, 8))


def order60(*key) -> Column:
    return _hex(F.substring(digest(*key), 1, 15))


def chance(p: float, *key) -> Column:
    """True with probability p."""
    return rank32(*key) < F.lit(int(p * SPAN32))


def pick(values: Column, *key) -> Column:
    """One element of an array, uniformly; null for an empty array."""
    return F.when(F.size(values) > 0, F.get(values, F.pmod(rank32(*key), F.size(values)).cast("int")))


def shuffled(values: Column, *key) -> Column:
    """The array in hash order; the key is extended by the position of each element."""
    tagged = F.transform(values, lambda v, i: F.struct(order60(*key, i).alias("o"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(tagged), lambda s: s["v"])


def falling_weight_index(n: Column, *key) -> Column:
    """Index into a ranked list of length n, drawn with weights n, n-1, ..., 1. An empty list is an error."""
    empty = F.raise_error(F.lit("nothing to draw from: the ranked list is empty")).cast("bigint")
    r = F.pmod(rank32(*key), F.when(n > 0, (n * (n + 1) / 2).cast("bigint")).otherwise(empty))
    upto = lambda k: (k + 1) * n - k * (k + 1) / 2
    return let(r, lambda drawn: F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda k: upto(k) <= drawn)))


def weighted_choice(weights: Sequence[float], *key) -> Column:
    """Index 0..len-1 drawn by the given weights; thresholds are exact 32-bit integers."""
    if not weights or min(weights) < 0 or not sum(weights) > 0:
        raise ValueError(f"weights must be non-negative with a positive sum: {weights}")
    cuts = F.array(*[F.lit(t).cast("bigint") for t in cdf_thresholds(weights)])
    return let(rank32(*key), lambda r: F.size(F.filter(cuts, lambda t: r >= t)))


def cdf_thresholds(weights: Sequence[float]) -> list[int]:
    """Inner cut points of the cumulative distribution on the 32-bit scale."""
    total = math.fsum(weights)
    return [int(math.fsum(weights[: k + 1]) / total * SPAN32) for k in range(len(weights) - 1)]


def random_word(low: int, high: int, *key) -> Column:
    """A lower-case word of low..high letters (at most 16: one md5 byte per letter)."""
    if not 1 <= low <= high <= 16:
        raise ValueError("a word has 1 to 16 letters")
    size = (F.lit(low) + F.pmod(rank32(*key, "len"), F.lit(high - low + 1))).cast("int")
    letter = lambda hexes, i: F.chr(F.lit(97) + F.pmod(_hex(F.substring(hexes, i * 2 + 1, F.lit(2))), F.lit(26)))
    positions = F.sequence(F.lit(0), size - 1)
    return let(digest(*key, "word"), lambda h: F.array_join(F.transform(positions, lambda i: letter(h, i)), ""))
