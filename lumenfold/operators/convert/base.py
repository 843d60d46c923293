"""Building blocks of conversation items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import schema as S


def text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def seq(*groups) -> Column:
    """A constant index sequence, e.g. `seq([0])`; no groups give an empty one."""
    return F.array(*[F.array(*[F.lit(i) for i in g]) for g in groups]).cast(S.SEQ)


def turn(speaker: str, value, boxes_seq: Column | None = None, points_seq: Column | None = None) -> Column:
    """One turn. A missing sequence is null, which is not the same as an empty one."""
    null = F.lit(None).cast(S.SEQ)
    return F.struct(
        F.lit(speaker).alias("from"),
        text(value).alias("value"),
        (null if boxes_seq is None else boxes_seq.cast(S.SEQ)).alias("boxes_seq"),
        (null if points_seq is None else points_seq.cast(S.SEQ)).alias("points_seq"),
    )


def target(boxes: Column | None = None, points: Column | None = None) -> Column:
    null = F.lit(None).cast(S.BOX_LIST)
    return F.struct(
        (null if boxes is None else boxes.cast(S.BOX_LIST)).alias("boxes"),
        (null if points is None else points.cast(S.BOX_LIST)).alias("points"),
    )


def item(df: DataFrame, image, turns: list[Column], aim: Column | None = None) -> DataFrame:
    """The item table of a record table that carries `row_id`."""
    return df.select(
        "row_id",
        text(image).alias("image"),
        (F.lit(None).cast(S.TARGET) if aim is None else aim).alias("target"),
        F.array(*turns).alias("conversations"),
    )
