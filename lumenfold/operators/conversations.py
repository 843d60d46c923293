"""Long turn tables to conversations, and checks on items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.prompts import lead, segment
from lumenfold.functions.prompt_templates import get_template


def item_problem(image: Column, target: Column, turns: Column) -> Column:
    """Null for a valid item, else the rule it breaks."""
    has = lambda speaker, mark: F.exists(
        turns, lambda t: (t["from"] == speaker) & F.contains(t["value"], F.lit(mark))
    )
    any_boxes = F.exists(turns, lambda t: F.contains(t["value"], F.lit(S.BOXES)))
    return (
        F.when(has("human", S.IMAGE) & image.isNull(), F.lit("image placeholder without image"))
        .when(has("gpt", S.IMAGE), F.lit("image placeholder in an answer"))
        .when(any_boxes & target["boxes"].isNull(), F.lit("box placeholder without boxes"))
    )


def unused_image(image: Column, turns: Column) -> Column:
    """True where an item has an image that no question mentions (worth a warning, not an error)."""
    used = F.exists(turns, lambda t: (t["from"] == "human") & F.contains(t["value"], F.lit(S.IMAGE)))
    return image.isNotNull() & ~used


def validate(items: DataFrame, on_error: str = "flag") -> DataFrame:
    """Adds `problem`; with `on_error='raise'` the first bad row stops the job."""
    problem = item_problem(F.col("image"), F.col("target"), F.col("conversations"))
    if on_error == "raise":
        stop = F.raise_error(F.concat(F.lit("invalid item: "), problem)).cast("string")
        problem = F.when(problem.isNotNull(), stop)
    out = items.withColumn("problem", problem)
    return out.withColumn("image_unused", unused_image(F.col("image"), F.col("conversations")))


ROLES = {"user": "human", "human": "human", "assistant": "gpt", "gpt": "gpt"}


def _speaker(role: Column) -> Column:
    out = None
    for name, speaker in ROLES.items():
        cond = role == name
        out = F.when(cond, F.lit(speaker)) if out is None else out.when(cond, F.lit(speaker))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown role: "), role)).cast("string"))


def collect_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: system text, and human/gpt turns in order.

    A conversation is one sample and one output row, so this is the one place where turns meet;
    for texts alone `prompt_segments` renders turn by turn instead.
    """
    is_system = F.col("role") == "system"
    system = F.min_by(F.when(is_system, F.col("text")), F.when(is_system, F.col("turn"))).alias("system")
    entry = F.struct(
        F.col("turn").alias("turn"), _speaker(F.col("role")).alias("from"), F.col("text").alias("value")
    )
    listed = F.array_sort(F.collect_list(F.when(F.col("role") != "system", entry))).alias("_turns")
    return turns.groupBy(key).agg(system, listed).select(
        key,
        "system",
        F.transform(
            "_turns",
            lambda t: F.struct(
                t["from"].alias("from"),
                t["value"].alias("value"),
                F.lit(None).cast(S.SEQ).alias("boxes_seq"),
                F.lit(None).cast(S.SEQ).alias("points_seq"),
            ),
        ).alias("conversations"),
    )


def prompt_segments(
    turns: DataFrame, mode: str, key: str = "conv_id", position: str = "position", system: Column | None = None
) -> DataFrame:
    """Prompt text per turn, no grouping: concatenating a conversation's segments gives its prompt.

    `position` counts the human/gpt turns from 0; the first segment carries the lead, with `system`
    in place of the template's system text where it is not null.
    """
    t = get_template(mode)
    human, gpt = t.roles
    at = F.col(position) + len(t.messages)
    role = F.when(_speaker(F.col("role")) == "human", F.lit(human)).otherwise(F.lit(gpt))
    text = segment(t, role, F.col("text"), at)
    first = lead(t, system)
    for n, (r, m) in enumerate(t.messages):
        first = F.concat(first, segment(t, F.lit(r), F.lit(m), F.lit(n)))
    return turns.select(
        key, position, F.when(F.col(position) == 0, F.concat(first, text)).otherwise(text).alias("segment")
    )
