"""Scoring: row-wise correctness first, then one partial aggregation for any grouping.

`preds` and `targets` meet on `row_id`; the denominator is all targets, failed ones included.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import coords, geometry
from lumenfold.functions.text import bare_label, extract_label

Extractor = Callable[[Column], Column]


def align(preds: DataFrame, targets: DataFrame, newest: str | None = None) -> DataFrame:
    """Predictions and targets side by side; a target without prediction counts as failed.

    One prediction counts for a target. With `newest`, a column of `preds` that orders them, the last
    one does; without it a second one is an error, since it would count its target twice.
    """
    others = [c for c in preds.columns if c != "row_id"]
    fields = F.struct(*others)
    if newest is not None:
        one = F.max_by(fields, newest)
    else:
        again = F.raise_error(F.concat(F.lit("several predictions for row "), F.first("row_id").cast("string")))
        one = F.when(F.count(F.lit(1)) > 1, again.cast(preds.select(fields.alias("p")).schema["p"].dataType)).otherwise(F.first(fields))
    single = preds.groupBy("row_id").agg(one.alias("_p")).select("row_id", "_p.*")
    return targets.join(single, "row_id", "left")


def score_match(df: DataFrame, extract: Extractor) -> DataFrame:
    """Equal extracted answers. Adds `correct`, `failed`, `target_failed`."""
    want, got = extract(F.col("target")), extract(F.col("pred"))
    return df.withColumns(
        {
            "target_failed": want.isNull(),
            "failed": want.isNotNull() & got.isNull(),
            "correct": F.coalesce(want == got, F.lit(False)),
        }
    )


def plain_box(text: Column) -> Column:
    return coords.single_box(coords.parse_plain_boxes(text))


def token_box(text: Column) -> Column:
    return coords.single_box(coords.parse_box_tokens(text))


def score_iou(df: DataFrame, extract: Extractor = plain_box, threshold: float = 0.5) -> DataFrame:
    """Overlap above the threshold. An unreadable prediction counts as the box 0,0,0,0.

    Adds `iou` (null where the target is unreadable or both boxes are empty) to the flags.
    """
    zero = F.array(*[F.lit(0.0)] * 4)
    scaled = lambda b: F.transform(b, lambda x: x * 1000)
    boxed = df.withColumns({"_want": extract(F.col("target")), "_got": extract(F.col("pred"))})
    overlap = geometry.iou(scaled(F.coalesce("_got", zero)), scaled(F.col("_want")))
    return (
        boxed.withColumn("iou", overlap)
        .withColumns(
            {
                "target_failed": F.col("_want").isNull(),
                "failed": F.col("_want").isNotNull() & F.col("_got").isNull(),
                "correct": F.coalesce(F.col("iou") > threshold, F.lit(False)),
            }
        )
        .drop("_want", "_got")
    )


def score_containment(df: DataFrame, negative: str = "negative") -> DataFrame:
    """The target label occurs in the raw prediction and, with it removed, the negative label does not."""
    positive = extract_label(F.col("target"))
    rest = F.replace(F.col("pred"), positive, F.lit(""))
    hit = F.contains(F.col("pred"), positive) & ~F.contains(rest, F.col(negative))
    return df.withColumns(
        {
            "target_failed": positive.isNull(),
            "failed": positive.isNotNull() & bare_label(F.col("pred")).isNull(),
            "correct": F.coalesce(hit, F.lit(False)),
        }
    )


def paired_names(classes: DataFrame) -> DataFrame:
    """`name, negative` for classes paired by line (0-1, 2-3, ...); the last of equal names wins."""
    named = classes.select("row_id", F.lower("class_name").alias("name"))
    other = named.select(F.col("row_id").bitwiseXOR(F.lit(1)).alias("row_id"), F.col("name").alias("negative"))
    pairs = named.join(other, "row_id", "left")
    return pairs.groupBy("name").agg(F.max_by("negative", "row_id").alias("negative"))


def with_paired_negative(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Negative label by target name; a name that is not a class leaves it null."""
    named = df.withColumn("name", extract_label(F.col("target")))
    return named.join(paired_names(classes), "name", "left").drop("name")


def with_own_negative(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Negative label from the row's own pair: the last of (positive, negative) that is not the target."""
    own = pairs.select(
        "row_id", F.lower("positive_promt").alias("_pos"), F.lower("negative_promt").alias("_neg")
    )
    target = extract_label(F.col("target"))
    negative = F.when(F.col("_neg") != target, F.col("_neg")).when(F.col("_pos") != target, F.col("_pos"))
    return df.join(own, "row_id", "left").withColumn("negative", negative).drop("_pos", "_neg")


def report(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and failure counts over all rows, or per group; mean IoU where it was scored."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("n_correct"),
        F.try_divide(F.count_if("correct").cast("double"), F.count(F.lit(1))).alias("accuracy"),
        F.count_if("failed").alias("failed"),
        F.count_if("target_failed").alias("target_failed"),
    ]
    if "iou" in scored.columns:
        aggs.append(F.avg("iou").alias("iou"))
    return scored.groupBy(*by).agg(*aggs)


def multi_report(sets: Mapping[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Several named test sets, each with its own scorer, as one table and one job."""
    out = None
    for name, (df, scorer) in sets.items():
        rows = scorer(df).select(F.lit(f"multitest_{name}").alias("test_set"), "correct", "failed", "target_failed")
        out = rows if out is None else out.unionByName(rows)
    return report(out, ["test_set"])
