"""Captions, grounded captions, generated question-answer pairs and ready-made conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.text import drop_markers, markers_to_boxes, swap, template
from lumenfold.operators.convert.base import item, target, turn


def caption(df: DataFrame, templates: Sequence[str], seed: int = 0) -> DataFrame:
    return item(df, df["img_path"], [turn("human", template(templates, seed, df["row_id"])), turn("gpt", df["caption"])])


def flickr(df: DataFrame, templates: Sequence[str], seed: int = 0) -> DataFrame:
    """Entity captions: phrase ends become box placeholders."""
    return item(
        df,
        F.concat("image_id", F.lit(".jpg")),
        [
            turn("human", template(templates, seed, df["row_id"])),
            turn("gpt", markers_to_boxes(df["sentence"]), df["boxes_seq"]),
        ],
        target(df["boxes"]),
    )


def gpt4gen(df: DataFrame, version: str, templates: Sequence[str], seed: int = 0) -> DataFrame:
    """`a`: answer; `c`: reasoning as plain text; `bc`: reasoning with boxes."""
    answers = {
        "a": (df["answer"], None),
        "c": (drop_markers(df["cot_with_ans"]), None),
        "bc": (markers_to_boxes(df["cot_with_ans"]), df["answer_boxes_seq"]),
    }
    if version not in answers:
        raise ValueError(f"version must be one of {list(answers)}: {version}")
    answer, answer_seq = answers[version]
    question = swap(template(templates, seed, df["row_id"]), S.QUESTION, markers_to_boxes(df["question"]))
    return item(
        df,
        df["img_path"],
        [turn("human", question, df["question_boxes_seq"]), turn("gpt", answer, answer_seq)],
        target(df["boxes"]),
    )


def instruct(df: DataFrame, add_coco_prefix: bool = False) -> DataFrame:
    """Conversations that are already written down."""
    image = F.concat(F.lit("COCO_train2014_"), "image") if add_coco_prefix else df["image"]
    turns = F.transform(
        "conversations",
        lambda t: F.struct(
            t["from"].alias("from"),
            t["value"].alias("value"),
            F.lit(None).cast(S.SEQ).alias("boxes_seq"),
            F.lit(None).cast(S.SEQ).alias("points_seq"),
        ),
    )
    return df.select(
        "row_id", image.alias("image"), F.lit(None).cast(S.TARGET).alias("target"), turns.alias("conversations")
    )
