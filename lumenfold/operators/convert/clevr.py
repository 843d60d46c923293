"""Synthetic-scene questions, answered plainly or with their program as a trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.binding import let
from lumenfold.functions.geometry import first_seen, positions_in
from lumenfold.functions.text import swap, template
from lumenfold.operators.convert.base import item, seq, target, turn

# Steps whose objects are pointed at (fixed values).
POINTED = ["unique", "union", "intersect", "relate", "same_size", "same_shape", "same_material", "same_color"]
POINTED_BEFORE_TEST = ["scene", "filter_color", "filter_material", "filter_shape", "filter_size"]
TESTS = ["exist", "count"]


def _pointed(program: Column, step: Column, i: Column) -> Column:
    following = F.coalesce(F.get(program, i + 1)["function"].isin(TESTS), F.lit(False))
    return step["function"].isin(POINTED) | (step["function"].isin(POINTED_BEFORE_TEST) & following)


def _objects(step: Column) -> Column:
    return F.coalesce(step["ans"], F.array().cast("array<int>"))


def _trace(program: Column, with_points: bool) -> Column:
    def one(step, i):
        value = F.get(step["value_inputs"], 0)
        name = F.concat(step["function"], F.coalesce(F.concat(F.lit(":"), value), F.lit("")))
        inputs = F.when(
            F.coalesce(F.size(step["inputs"]), F.lit(0)) > 0,
            F.concat(F.lit("["), F.array_join(step["inputs"].cast("array<string>"), ","), F.lit("]")),
        ).otherwise(F.lit(""))
        found = F.lit("")
        if with_points:
            found = F.when(
                _pointed(program, step, i),
                F.when(F.size(_objects(step)) > 0, F.lit(S.POINTS)).otherwise(F.lit(" Found no object.")),
            ).otherwise(F.lit(""))
        return F.concat(name, inputs, found)

    return F.array_join(F.transform(program, one), " -> ")


def clevr(df: DataFrame, version: str, templates: Sequence[str], seed: int = 0) -> DataFrame:
    """`q-a` answer only, `q-s` program trace, `q-bs` trace with points.

    `q-bs` needs the scene's `objects` column next to the question (see `sources.scenes_by_line`).
    """
    if version not in ("q-a", "q-s", "q-bs"):
        raise ValueError(f"unknown version: {version}")
    said = F.concat(F.lit("The answer is "), df["answer"], F.lit("."))
    points, answer_seq = F.array().cast(S.BOX_LIST), seq()
    if version == "q-s":
        said = F.concat(_trace(df["program"], False), F.lit(" "), said)
    elif version == "q-bs":
        said = F.concat(_trace(df["program"], True), F.lit(" "), said)
        marked = F.transform(
            df["program"], lambda p, i: F.struct(_pointed(df["program"], p, i).alias("keep"), _objects(p).alias("ans"))
        )
        groups = F.transform(
            F.filter(marked, lambda m: m["keep"] & (F.size(m["ans"]) > 0)),
            lambda m: F.transform(m["ans"], lambda o: F.slice(df["objects"][o]["pixel_coords"], 1, 2)),
        )
        placed = let(
            groups,
            lambda g: F.struct(first_seen(F.flatten(g)).alias("points"), positions_in(first_seen(F.flatten(g)), g).alias("seq")),
        )
        df = df.withColumn("_placed", placed)
        points, answer_seq = F.col("_placed.points"), F.col("_placed.seq")
    asked = swap(template(templates, seed, df["row_id"]), S.QUESTION, df["question"])
    return item(
        df,
        df["image_filename"],
        [turn("human", asked, None, seq()), turn("gpt", said, None, answer_seq)],
        target(None, points),
    )
