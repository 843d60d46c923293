"""Token rows as runs: `array<struct<value, start, length>>`, the patches of an image being one run.

A run says where it starts, so that cutting is a filter and one `least` per run, never a scan of the
tokens. Episode concatenation, truncation, padding and span checks of `functions.tokens` work on runs
here, in steps that follow the number of runs; `decode` makes the plain array at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.binding import let, let2
from lumenfold.functions.tokens import PROTECTED

FIELDS = ("input_ids", "attention_mask", "labels")


def run(value: Column, start, length) -> Column:
    whole = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("int")
    return F.struct(value.alias("value"), whole(start).alias("start"), whole(length).alias("length"))


def encode(tokens: Column) -> Column:
    """Runs of equal neighbours; an empty array has none."""
    return let(tokens, _encode)


def _encode(t: Column) -> Column:
    n = F.size(t)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    heads = F.filter(every, lambda i: (i == 0) | ~F.get(t, i).eqNullSafe(F.get(t, i - 1)))
    return let(heads, lambda h: F.transform(
        h, lambda s, k: run(F.get(t, s), s, F.coalesce(F.get(h, k + 1), n) - s)))


def decode(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["length"])))


def total(runs: Column) -> Column:
    """Tokens of a row."""
    return let(runs, lambda r: F.when(F.size(r) > 0, F.element_at(r, -1)["start"] + F.element_at(r, -1)["length"]).otherwise(F.lit(0)))


def cut(runs: Column, start, stop, to=0) -> Column:
    """The tokens of [start, stop), numbered from `to` on."""
    low, high, to = (c if isinstance(c, Column) else F.lit(c) for c in (start, stop, to))
    inside = F.filter(runs, lambda r: (r["start"] < high) & (r["start"] + r["length"] > low))

    def clip(r: Column) -> Column:
        first = F.greatest(r["start"], low)
        return run(r["value"], first - low + to, F.least(r["start"] + r["length"], high) - first)

    return F.transform(inside, clip)


def constant(value: Column, length: Column, start=0) -> Column:
    """One run, or none of length 0."""
    one = F.array(run(value, start, length))
    return F.when(length > 0, one).otherwise(F.slice(one, 1, 0))


def concat_episode(items: Column) -> Column:
    """`tokens.concat_episode` on items whose three fields are runs; the result is three runs arrays."""
    return let(items, _concat_items)


def _concat_items(items: Column) -> Column:
    last = F.size(items) - 1
    size = lambda x, i: F.when((i == 0) | (i == last), total(x["input_ids"])).otherwise(F.greatest(total(x["input_ids"]) - 1, F.lit(0)))

    def joined(sizes: Column) -> Column:
        # One number an item: sums over the items before.
        before = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda s, x: s + x)

        def part(field: str):
            def one(x, i):
                moved = cut(x[field], 0, F.get(sizes, i), before(i))
                if field != "labels":
                    return moved
                skipped = F.lit(S.IGNORE_INDEX).cast("int")
                return F.when(i == last, moved).otherwise(constant(skipped, F.get(sizes, i), before(i)))

            return F.flatten(F.transform(items, one)).alias(field)

        return F.struct(*[part(f) for f in FIELDS])

    return let(F.transform(items, size), joined)


def truncate(sample: Column, limit: int, protected: Sequence = PROTECTED, on_error: str = "raise") -> Column:
    """`tokens.truncate` on a sample of runs: unprotected tokens go first, from the end.

    All tokens stay up to the one where the room for unprotected tokens ends, behind it only the
    protected runs. Null for a row flagged because its protected tokens alone are too many.
    """
    spans = kept_spans(sample["input_ids"], limit, protected, on_error)
    return let2(sample, spans, lambda s, k: F.when(k.isNotNull(), F.struct(*[at_spans(s[f], k).alias(f) for f in FIELDS])))


def kept_spans(runs: Column, limit: int, protected: Sequence = PROTECTED, on_error: str = "raise") -> Column:
    """What survives truncation as `array<struct<start, stop, to>>`: few spans, the first from 0."""
    if on_error not in ("raise", "flag"):
        raise ValueError(f"on_error is 'raise' or 'flag': {on_error}")
    return let(runs, lambda r: _spans(r, limit, protected, on_error))


def _spans(runs: Column, limit: int, protected: Sequence, on_error: str) -> Column:
    safe = F.array(*[F.lit(p) for p in protected])
    is_safe = lambda r: F.array_contains(safe, r["value"])
    span = lambda a, b, to: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), to.cast("int").alias("to"))
    n = total(runs)
    problem = F.lit(None) if on_error == "flag" else F.raise_error(F.lit("protected tokens exceed the truncation size"))
    held = F.aggregate(F.filter(runs, is_safe), F.lit(0), lambda s, r: s + r["length"])
    # Where the open tokens that fit end: runs before are counted off, the run that ends the room is cut.
    state = F.struct(F.lit(limit).cast("int").alias("room"), F.lit(None).cast("int").alias("stop"))

    def step(s, r):
        over = F.struct(F.lit(0).alias("room"), (r["start"] + s["room"]).alias("stop"))
        on = F.struct((s["room"] - r["length"]).alias("room"), s["stop"].alias("stop"))
        return F.when(s["stop"].isNotNull() | is_safe(r), s).otherwise(F.when(r["length"] <= s["room"], on).otherwise(over))

    def beyond(h: Column) -> Column:
        room = state.withField("room", F.lit(limit) - h)
        stop = F.aggregate(runs, room, step, lambda s: F.coalesce(s["stop"], n))
        return let(stop, lambda p: let(F.filter(runs, lambda r: is_safe(r) & (r["start"] > p)), lambda rest: F.concat(
            F.array(span(F.lit(0), p, F.lit(0))),
            F.transform(rest, lambda r, i: span(r["start"], r["start"] + r["length"], p + F.aggregate(
                F.slice(rest, F.lit(1), i), F.lit(0), lambda s, x: s + x["length"]))))))

    whole = F.array(span(F.lit(0), n, F.lit(0)))
    cutting = let(held, lambda h: F.when(h > limit, problem.cast("array<struct<start:int,stop:int,to:int>>")).otherwise(beyond(h)))
    return F.when(n <= limit, whole).otherwise(cutting)


def at_spans(runs: Column, spans: Column) -> Column:
    return F.flatten(F.transform(spans, lambda s: cut(runs, s["start"], s["stop"], s["to"])))


def pad_batches(
    df: DataFrame, batch_size: int, pad, row_id: str = "row_id", left: bool = False, partition: Sequence[str] = ()
) -> DataFrame:
    """`tokens.pad_batches` on runs: a row gets one run more."""
    batched = df.withColumn("batch_id", F.floor(F.col(row_id) / batch_size).cast("bigint")).withColumn("_n", total(F.col("input_ids")))
    width = F.max("_n").over(Window.partitionBy(*partition, "batch_id"))

    def padded(name: str, filler) -> Column:
        fill = F.col("_width") - F.col("_n")
        value = F.lit(filler)
        if left:
            return F.concat(constant(value, fill), cut(F.col(name), 0, F.col("_n"), fill))
        return F.concat(F.col(name), constant(value, fill, F.col("_n")))

    return batched.withColumn("_width", width).withColumns(
        {name: padded(name, filler) for name, filler in zip(FIELDS, (pad, 0, S.IGNORE_INDEX))}).drop("_n", "_width")


def value_at(runs: Column, position: Column) -> Column:
    """The token at a position, null outside."""
    return F.get(F.filter(runs, lambda r: (r["start"] <= position) & (r["start"] + r["length"] > position)), F.lit(0))["value"]


def image_span_problem(runs: Column, patches: int = 256, wrap: bool = True) -> Column:
    """`tokens.image_span_problem` on runs."""
    return let(runs, lambda r: _span_problem(r, patches, wrap))


def _span_problem(runs: Column, patches: int, wrap: bool) -> Column:
    of = lambda piece: F.filter(runs, lambda r: r["value"] == piece)
    count = lambda piece: F.aggregate(of(piece), F.lit(0), lambda s, r: s + r["length"])
    n_patch = count(S.IM_PATCH)
    if wrap:
        starts = F.flatten(F.transform(of(S.IM_START), lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
        loose = F.exists(starts, lambda i: F.coalesce(value_at(runs, i + patches + 1) != S.IM_END, F.lit(True)))
        problem = F.when(count(S.IM_START) != count(S.IM_END), F.lit("start and end counts differ")).when(
            loose, F.lit("end token does not follow the patches"))
    else:
        problem = F.when(n_patch != patches, F.lit("patch count is wrong")).when(
            F.size(of(S.IM_PATCH)) > 1, F.lit("patches are not consecutive"))
    return F.when(n_patch > 0, problem)
