"""Visual question answering sets without coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.text import swap, template
from lumenfold.operators.convert.base import item, turn

UNKNOWN = "UNKNOWN"


def _qa(df: DataFrame, image: str, question: str, answer, templates: Sequence[str], seed: int) -> DataFrame:
    asked = swap(template(templates, seed, df["row_id"]), S.QUESTION, df[question])
    return item(df, df[image], [turn("human", asked), turn("gpt", answer)])


def _so(answer: Column) -> Column:
    return F.concat(F.lit(" So the answer is "), answer, F.lit("."))


def pope(df: DataFrame, templates: Sequence[str], seed: int = 0) -> DataFrame:
    answer = F.concat(F.lit("The answer is "), F.lower(df["label"].cast("string")), F.lit(" ."))
    return _qa(df, "image", "text", answer, templates, seed)


def pure_vqa(df: DataFrame, templates: Sequence[str], seed: int = 0) -> DataFrame:
    return _qa(df, "image_path", "question", "", templates, seed)


def vqav2(df: DataFrame, templates: Sequence[str], has_annotation: bool = True, seed: int = 0) -> DataFrame:
    known = df["annotation"]["multiple_choice_answer"] if has_annotation else F.lit(UNKNOWN)
    answer = F.concat(F.lit("The answer is "), known, F.lit("."))
    return _qa(df, "image_path", "question", answer, templates, seed)


def vqa_ex(
    df: DataFrame, is_e: bool, templates: Sequence[str], has_annotation: bool = True, seed: int = 0
) -> DataFrame:
    """Answers with an explanation (E: the first one; X: all of them run together)."""
    if not has_annotation:
        answer = F.lit(UNKNOWN)
    elif is_e:
        answer = F.concat(df["explanation"][0], _so(df["multiple_answers"]))
    else:
        answer = F.concat(F.array_join(df["justification"], ""), _so(df["multiple_choice_answer"]))
    return _qa(df, "file_path", "question", answer, templates, seed)
