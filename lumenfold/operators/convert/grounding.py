"""Referring expressions, in both directions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.text import swap, template
from lumenfold.operators.convert.base import item, seq, target, turn


def rec(df: DataFrame, templates: Sequence[str], seed: int = 0) -> DataFrame:
    """Expression in, box out."""
    asked = swap(template(templates, seed, df["row_id"]), S.EXPR, df["expression"])
    return item(
        df,
        df["img_path"],
        [turn("human", asked), turn("gpt", f"Answer: {S.BOXES} .", seq([0]))],
        target(F.array("bbox")),
    )


def reg(df: DataFrame, templates: Sequence[str], seed: int = 0) -> DataFrame:
    """Box in, expression out."""
    asked = swap(template(templates, seed, df["row_id"]), S.OBJS, S.BOXES)
    return item(
        df,
        df["img_path"],
        [turn("human", asked, seq([0])), turn("gpt", df["expression"])],
        target(F.array("bbox")),
    )


# Grounded captioning has the same shape.
ground_caption = reg
