"""Boxes and points: scalar arithmetic per coordinate, arrays only at the record boundary.

A box is `array<double>` x1,y1,x2,y2. Rounding is that of Python's `round` and `%.3f`: by the exact
binary value of the number, half to even only where that value is a true tie.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.binding import let, let2

DIGITS = 3


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp_unit(value: Column, size) -> Column:
    return F.greatest(F.lit(0.0), F.least(value / _num(size), F.lit(1.0)))


def round_exact(x: Column, digits: int = DIGITS) -> Column:
    """Round a number of moderate size to at most 6 places by its exact binary value.

    Spark's `round` goes by the shortest decimal text, which differs for numbers like 0.5025 (just
    below the tie in binary). Away from ties the scaled value decides. Near one, the distance to
    the tie is computed without rounding error: the number is split into a 24-bit head and the
    rest, so that both products are exact.
    """
    scale = 10**digits
    scaled = x * scale
    below = F.floor(scaled)
    head = x.cast("float").cast("double")
    over = (head * (2 * scale) - (below * 2 + 1)) + (x - head) * (2 * scale)
    up = (over > 0) | ((over == 0) & (below % 2 != 0))
    near = F.abs(scaled - below - 0.5) < 1e-6
    whole = F.when(near, (below + F.when(up, 1).otherwise(0)).cast("double")).otherwise(F.rint(scaled))
    return whole / scale


def norm_coord(value: Column, size) -> Column:
    """Divide, clamp to 0..1, round to 3 places."""
    return round_exact(clamp_unit(value, size))


def norm_box(box: Column, w, h) -> Column:
    return F.array(*[norm_coord(box[i], w if i % 2 == 0 else h) for i in range(4)])


def norm_point(point: Column, w, h) -> Column:
    """Divide and clamp; points are not rounded."""
    return F.array(clamp_unit(point[0], w), clamp_unit(point[1], h))


def denorm_box(box: Column, w, h) -> Column:
    return F.array(*[box[i] * _num(w if i % 2 == 0 else h) for i in range(4)])


def xywh_to_xyxy(box: Column, w=None, h=None) -> Column:
    x2, y2 = box[0] + box[2], box[1] + box[3]
    if w is not None:
        x2 = F.least(x2, _num(w))
    if h is not None:
        y2 = F.least(y2, _num(h))
    return F.array(box[0], box[1], x2, y2)


def _repair(lo: Column, hi: Column, size) -> tuple[Column, Column]:
    fixed = F.when(lo > hi, lo + 1).otherwise(hi)
    return F.when(lo < 0, F.lit(0.0)).otherwise(lo), F.when(fixed > size, _num(size)).otherwise(fixed)


def clean_box(box: Column, w, h) -> Column:
    """Reversed sides get one pixel, then low sides are cut at 0 and high sides at the image edge."""
    x1, x2 = _repair(box[0], box[2], w)
    y1, y2 = _repair(box[1], box[3], h)
    return F.array(*[c.cast("double") for c in (x1, y1, x2, y2)])


def square_margins(w, h) -> tuple[Column, Column]:
    """Left and top margin that centre a w x h image in its square."""
    w, h = _num(w), _num(h)
    left = F.when(h > w, F.floor((h - w) / 2)).otherwise(F.lit(0))
    top = F.when(w > h, F.floor((w - h) / 2)).otherwise(F.lit(0))
    return left, top


def expand_box(box: Column, w, h) -> Column:
    left, top = square_margins(w, h)
    return F.array(box[0] + left, box[1] + top, box[2] + left, box[3] + top)


def expand_point(point: Column, w, h) -> Column:
    left, top = square_margins(w, h)
    return F.array(point[0] + left, point[1] + top)


def expand_target(target: Column, w, h) -> Column:
    """All boxes and points of a target moved into the square; null stays null."""
    return F.when(
        target.isNotNull(),
        F.struct(
            F.transform(target["boxes"], lambda b: expand_box(b, w, h)).alias("boxes"),
            F.transform(target["points"], lambda p: expand_point(p, w, h)).alias("points"),
        ),
    )


def square_side(w, h) -> Column:
    return F.greatest(_num(w), _num(h))


def area(box: Column) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes; null when both areas are 0."""
    return let2(a, b, _overlap)


def _overlap(a: Column, b: Column) -> Column:
    width = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    height = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    inter = width * height
    return F.try_divide(inter, area(a) + area(b) - inter)


def first_seen(values: Column) -> Column:
    """Distinct elements in order of first appearance."""
    return F.array_distinct(values)


def positions_in(values: Column, groups: Column) -> Column:
    """For nested lists of elements, the 0-based index of each element in `values`."""
    find = lambda known, v: (F.array_position(known, v) - 1).cast("int")
    return let(values, lambda known: F.transform(groups, lambda g: F.transform(g, lambda v: find(known, v))))
