"""Pointing questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.draws import chance, shuffled
from lumenfold.functions.text import swap, template
from lumenfold.operators.convert.base import item, seq, target, turn


def _point_qa(df: DataFrame, question: Column, version: str, templates, seed: int, point_prob: float) -> DataFrame:
    by_point = {
        "p": F.lit(True),
        "b": F.lit(False),
        "bp": chance(point_prob, seed, df["row_id"], "point"),
    }
    if version not in by_point:
        raise ValueError(f"version must be b, p or bp: {version}")
    use_point = by_point[version]
    marked = F.concat(question, F.when(use_point, F.lit(S.POINTS)).otherwise(F.lit(S.BOXES)))
    asked = swap(template(templates, seed, df["row_id"]), S.QUESTION, marked)
    answer = F.concat(F.lit("The answer is "), df["answer"], F.lit(" ."))
    return item(
        df,
        df["file_path"],
        [turn("human", asked, F.when(~use_point, seq([0])), F.when(use_point, seq([0]))), turn("gpt", answer)],
        target(F.array("bbox"), F.array("point")),
    )


def point_qa_local(
    df: DataFrame, version: str, templates: Sequence[str], seed: int = 0, point_prob: float = 0.5
) -> DataFrame:
    """The region is given as box (`b`), point (`p`) or either (`bp`)."""
    return _point_qa(df, df["question"], version, templates, seed, point_prob)


def point_qa_twice(
    df: DataFrame, version: str, templates: Sequence[str], seed: int = 0, point_prob: float = 0.5
) -> DataFrame:
    """`{oq,sq,gq}-{b,p,bp}`: question about the object, its superclass, or in general."""
    kinds = {"oq": "obj_question", "sq": "super_question", "gq": "general_question"}
    kind, _, region = version.partition("-")
    if kind not in kinds:
        raise ValueError(f"version must start with one of {list(kinds)}: {version}")
    return _point_qa(df, df[kinds[kind]], region, templates, seed, point_prob)


def v7w_point(
    df: DataFrame, version: str, templates: Sequence[str], shuffle: bool = True, seed: int = 0
) -> DataFrame:
    """Pick one of the candidate boxes, shown in shuffled order; answer as point or box."""
    if version not in ("p", "b"):
        raise ValueError(f"version must be p or b: {version}")
    count = F.size("candidates")
    listed = F.array_join(F.array_repeat(F.lit(S.BOXES), count), " ")
    kind = "point" if version == "p" else "box"
    body = F.concat("question", F.lit(" Candidates: "), listed, F.lit(f" answer in {kind} format."))
    asked = swap(template(templates, seed, df["row_id"]), S.QUESTION, body)
    order = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array(i))).otherwise(seq())
    if shuffle:
        order = shuffled(order, seed, df["row_id"], "candidates")
    if version == "p":
        answer, points = turn("gpt", f"The answer is {S.POINTS} .", None, seq([0])), F.array("point")
    else:
        at = F.array_position("candidates", df["answer"]).cast("int") - 1
        known = F.when(at < 0, F.raise_error(F.lit("answer is not a candidate")).cast("int")).otherwise(at)
        answer = turn("gpt", f"The answer is {S.BOXES} .", F.array(F.array(known)))
        points = F.array().cast(S.BOX_LIST)
    return item(df, df["file_path"], [turn("human", asked, order), answer], target(df["candidates"], points))
