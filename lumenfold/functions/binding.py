"""Evaluate once, use often.

Expressions inside lambda bodies are evaluated wherever they are written. `let` binds a value to
a lambda variable instead, so that it is computed once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), lambda v: body(v))[0]


def let2(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: body(s["a"], s["b"]))


def explode_items(array: Column, position: str = "pos", value: str = "item") -> Column:
    """posexplode for computed arrays that are never empty.

    The inner form makes the optimizer infer a size filter, which is pushed below the projection
    that computes the array and so computes it again; the outer form does not.
    """
    return F.posexplode_outer(array).alias(position, value)
