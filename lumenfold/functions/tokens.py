"""Token arrays: episode concatenation, truncation that protects image tokens, padding, checks.

Works on `array<int>` ids or `array<string>` pieces; tokenising itself is an input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.binding import let

PROTECTED = [S.IM_PATCH, S.IM_END, S.IM_START]


def concat_episode(items: Column) -> Column:
    """One sample from `array<struct<input_ids,attention_mask,labels>>`.

    Middle items lose their last token, the first and last do not; only the last item's labels
    are trained on.
    """
    return let(items, _concat_items)


def _concat_items(items: Column) -> Column:
    last = F.size(items) - 1

    def joined(field: str) -> Column:
        def part(x, i):
            cut = F.slice(x[field], 1, F.greatest(F.size(x[field]) - 1, F.lit(0)))
            kept = F.when((i == 0) | (i == last), x[field]).otherwise(cut)
            if field != "labels":
                return kept
            return F.when(i == last, kept).otherwise(F.transform(kept, lambda _: F.lit(S.IGNORE_INDEX)))

        return F.flatten(F.transform(items, part)).alias(field)

    return F.struct(joined("input_ids"), joined("attention_mask"), joined("labels"))


def kept_positions(tokens: Column, limit: int, protected: Sequence = PROTECTED, on_error: str = "raise") -> Column:
    """Positions that survive truncation to `limit`: unprotected tokens go first, from the end.

    Linear in the row: positions are split once into protected and open ones. When the protected
    tokens alone are too many it fails, or with `on_error="flag"` gives null for that row.
    """
    if on_error not in ("raise", "flag"):
        raise ValueError(f"on_error is 'raise' or 'flag': {on_error}")
    return let(tokens, lambda t: _kept(t, limit, protected, on_error))


def _kept(tokens: Column, limit: int, protected: Sequence, on_error: str) -> Column:
    n = F.size(tokens)
    safe = F.array(*[F.lit(p) for p in protected])
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    is_safe = lambda i: F.array_contains(safe, F.get(tokens, i))
    held = F.filter(every, is_safe)
    open_ = F.filter(every, lambda i: ~is_safe(i))
    problem = F.lit(None) if on_error == "flag" else F.raise_error(F.lit("protected tokens exceed the truncation size"))
    failed = problem.cast("array<int>")

    def cut(h: Column) -> Column:
        room = F.lit(limit) - F.size(h)
        return F.when(room < 0, failed).otherwise(F.array_sort(F.concat(h, F.slice(open_, 1, F.greatest(room, F.lit(0))))))

    return F.when(n <= limit, every).otherwise(let(held, cut))


def at_positions(values: Column, positions: Column) -> Column:
    return let(values, lambda v: F.transform(positions, lambda i: F.get(v, i)))


def truncate(sample: Column, limit: int, protected: Sequence = PROTECTED, on_error: str = "raise") -> Column:
    """Ids, mask and labels of a sample cut at the same positions; null ones for a flagged row."""
    fields = ("input_ids", "attention_mask", "labels")
    keep = kept_positions(sample["input_ids"], limit, protected, on_error)
    return let(keep, lambda k: F.struct(*[at_positions(sample[f], k).alias(f) for f in fields]))


def pad_batches(
    df: DataFrame, batch_size: int, pad, row_id: str = "row_id", left: bool = False, partition: Sequence[str] = ()
) -> DataFrame:
    """Pad `input_ids`, `attention_mask`, `labels` to the longest row of each batch.

    A batch is `row_id div batch_size`, so a window never holds more than one batch.
    """
    batched = df.withColumn("batch_id", F.floor(F.col(row_id) / batch_size).cast("bigint"))
    width = F.max(F.size("input_ids")).over(Window.partitionBy(*partition, "batch_id"))

    def padded(name: str, filler) -> Column:
        fill = F.array_repeat(F.lit(filler), F.col("_width") - F.size(name))
        return F.concat(fill, F.col(name)) if left else F.concat(F.col(name), fill)

    return (
        batched.withColumn("_width", width)
        .withColumns(
            {
                "input_ids": padded("input_ids", pad),
                "attention_mask": padded("attention_mask", 0),
                "labels": padded("labels", S.IGNORE_INDEX),
            }
        )
        .drop("_width")
    )


def negatives_to_pad(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: F.when(x < 0, F.lit(pad)).otherwise(x))


def image_span_problem(tokens: Column, patches: int = 256, wrap: bool = True) -> Column:
    """Null for a sound row, else what is wrong with its image tokens. Rows without patches are sound."""
    return let(tokens, lambda t: _span_problem(t, patches, wrap))


def _span_problem(tokens: Column, patches: int, wrap: bool) -> Column:
    count = lambda piece: F.size(F.filter(tokens, lambda t: t == piece))
    n_patch = count(S.IM_PATCH)
    every = F.sequence(F.lit(0), F.size(tokens) - 1)
    if wrap:
        starts = F.filter(every, lambda i: F.get(tokens, i) == S.IM_START)
        loose = F.exists(starts, lambda i: F.coalesce(F.get(tokens, i + patches + 1) != S.IM_END, F.lit(True)))
        problem = F.when(count(S.IM_START) != count(S.IM_END), F.lit("start and end counts differ")).when(
            loose, F.lit("end token does not follow the patches")
        )
    else:
        first = F.array_position(tokens, S.IM_PATCH).cast("int")
        run = F.slice(tokens, first, patches)
        problem = F.when(n_patch != patches, F.lit("patch count is wrong")).when(
            ~F.forall(run, lambda t: t == S.IM_PATCH), F.lit("patches are not consecutive")
        )
    return F.when(n_patch > 0, problem)


def reorder_images(images: Column, turns: Column) -> Column:
    """Images in the order the turns' `image_seq` lists name them."""
    order = F.flatten(F.transform(turns, lambda t: F.coalesce(t["image_seq"], F.array().cast("array<int>"))))
    return let(images, lambda all_: F.transform(order, lambda i: F.element_at(all_, i + 1)))
