"""Coordinates as text: formatting, parsing back, and filling placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions import geometry as G
from lumenfold.functions.binding import let, let2

# Patterns of the plain notation: numbers with one integer digit (fixed values).
_NUM = r"\d(?:\.\d*)?"
BOX_GROUP = rf"{_NUM}(?:,{_NUM}){{3}}(?:;{_NUM}(?:,{_NUM}){{3}})*"
POINT_GROUP = rf"{_NUM}(?:,{_NUM})(?:;{_NUM}(?:,{_NUM}))*"
# Patterns of the bin-token notation, after spaces are removed (fixed values).
_BIN = r"<bin_\d*?>"
BOX_TOKENS = rf"<b_st>{_BIN}(?:{_BIN}){{3}}(?:<b_sep>{_BIN}(?:{_BIN}){{3}})*<b_ed>"
POINT_TOKENS = rf"<p_st>{_BIN}(?:{_BIN}){{1}}(?:<p_sep>{_BIN}(?:{_BIN}){{1}})*<p_ed>"
DEFAULT_BINS = 1001


def _brackets(round_brackets: bool) -> tuple[str, str]:
    return ("(", ")") if round_brackets else ("[", "]")


def format_plain(
    coords: Column, digits: int = G.DIGITS, round_brackets: bool = False, rounded: bool = False
) -> Column:
    """`[x1,y1,x2,y2;...]` for a list of boxes, or of points; `rounded` if the numbers already are."""
    left, right = _brackets(round_brackets)
    decimal = f"array<decimal(18,{digits})>"
    exact = lambda c: c if rounded else F.transform(c, lambda x: G.round_exact(x, digits))
    one = lambda c: F.array_join(exact(c).cast(decimal).cast("array<string>"), ",")
    return F.concat(F.lit(left), F.array_join(F.transform(coords, one), ";"), F.lit(right))


def _parse_plain(text: Column, group: str, round_brackets: bool) -> Column:
    left, right = _brackets(round_brackets)
    found = F.regexp_extract_all(text, F.lit(rf"\{left}({group})\{right}"), F.lit(1))
    return F.transform(
        found,
        lambda g: F.transform(F.split(g, ";"), lambda b: F.split(b, ",").cast("array<double>")),
    )


def parse_plain_boxes(text: Column, round_brackets: bool = False) -> Column:
    """All box groups in a text: list of lists of boxes."""
    return _parse_plain(text, BOX_GROUP, round_brackets)


def parse_plain_points(text: Column, round_brackets: bool = False) -> Column:
    return _parse_plain(text, POINT_GROUP, round_brackets)


def _format_tokens(coords: Column, kind: str, width: int, bins: int) -> Column:
    token = lambda v: F.concat(F.lit("<bin_"), F.rint(v * (bins - 1)).cast("bigint").cast("string"), F.lit(">"))
    one = lambda c: F.array_join(F.transform(F.slice(c, 1, width), token), " ")
    body = F.array_join(F.transform(coords, one), f"<{kind}_sep>")
    return F.concat(F.lit(f"<{kind}_st>"), body, F.lit(f"<{kind}_ed>"))


def format_box_tokens(boxes: Column, bins: int = DEFAULT_BINS) -> Column:
    return _format_tokens(boxes, "b", 4, bins)


def format_point_tokens(points: Column, bins: int = DEFAULT_BINS) -> Column:
    return _format_tokens(points, "p", 2, bins)


def _parse_tokens(text: Column, pattern: str, kind: str, bins: int) -> Column:
    found = F.regexp_extract_all(F.replace(text, F.lit(" "), F.lit("")), F.lit(f"({pattern})"), F.lit(1))
    numbers = lambda b: F.transform(
        F.regexp_extract_all(b, F.lit(r"<bin_(\d*?)>"), F.lit(1)), lambda n: n.cast("double") / (bins - 1)
    )
    return F.transform(found, lambda g: F.transform(F.split(g, f"<{kind}_sep>"), numbers))


def parse_box_tokens(text: Column, bins: int = DEFAULT_BINS) -> Column:
    return _parse_tokens(text, BOX_TOKENS, "b", bins)


def parse_point_tokens(text: Column, bins: int = DEFAULT_BINS) -> Column:
    """Spaces are dropped before matching, so that formatted points parse back."""
    return _parse_tokens(text, POINT_TOKENS, "p", bins)


def single_box(groups: Column) -> Column:
    """The box, when a text holds exactly one group of exactly one box; null otherwise."""
    return let(groups, lambda g: F.when((F.size(g) == 1) & (F.size(g[0]) == 1), F.get(F.get(g, 0), 0)))


def fill(text: Column, placeholder: str, values: Column, strict: bool = True) -> Column:
    """Replace the n-th placeholder by the n-th value.

    A count mismatch raises, or gives null with `strict=False` so that the row can be set aside.
    """
    return let2(F.split(text, rf"\Q{placeholder}\E", -1), values, lambda p, v: _weave(p, v, placeholder, strict))


def _weave(parts: Column, values: Column, placeholder: str, strict: bool) -> Column:
    joined = F.array_join(
        F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(values, i), F.lit("")))), ""
    )
    fits = F.size(parts) - 1 == F.size(values)
    text = F.array_join(parts, placeholder)
    otherwise = F.raise_error(F.concat(F.lit("placeholder count does not match: "), text)) if strict else F.lit(None)
    return F.when(fits, joined).otherwise(otherwise.cast("string"))


def take_all(values: Column, seq: Column) -> Column:
    """Index lists to values; a bad index raises."""

    def checked(v, i):
        bad = (i < 0) | (i >= F.size(v))
        return F.get(v, F.when(bad, F.raise_error(F.lit("index out of range")).cast("int")).otherwise(i))

    return let(values, lambda v: F.transform(seq, lambda group: F.transform(group, lambda i: checked(v, i))))


def take_pairs(values: Column, seq: Column) -> Column:
    """As `take_all` over one list per image: an index is `struct<img,box>`."""

    def checked(v, p):
        inner = F.get(v, p["img"])
        bad = (p["img"] < 0) | (p["img"] >= F.size(v)) | (p["box"] < 0) | (p["box"] >= F.size(inner))
        return F.when(bad, F.raise_error(F.lit("index out of range")).cast("array<double>")).otherwise(
            F.get(inner, p["box"])
        )

    return let(values, lambda v: F.transform(seq, lambda group: F.transform(group, lambda p: checked(v, p))))


def _fill_turn(turn: Column, boxes: Column, points: Column, take, as_box, as_point, strict: bool) -> Column:
    def filled(text, seq, mark, values, show):
        shown = F.transform(take(values, seq), lambda v: show(v))
        return F.when(seq.isNull(), text).otherwise(fill(text, mark, shown, strict))

    done = let(
        filled(turn["value"], turn["boxes_seq"], S.BOXES, boxes, as_box),
        lambda text: filled(text, turn["points_seq"], S.POINTS, points, as_point),
    )
    touched = turn["boxes_seq"].isNotNull() | turn["points_seq"].isNotNull()
    return F.struct(
        turn["from"].alias("from"),
        done.alias("value"),
        F.when(touched, turn["value"]).alias("raw_value"),
        turn["boxes_seq"].alias("boxes_seq"),
        turn["points_seq"].alias("points_seq"),
    )


def _plain_box(boxes: Column) -> Column:
    return format_plain(boxes, rounded=True)


def fill_conversation(
    turns: Column, target: Column, w, h, as_box=_plain_box, as_point=format_plain, strict: bool = True
) -> Column:
    """Normalise the target and write it into every turn.

    A null sequence leaves a text as it is; an empty one demands that it has no placeholder.
    The text before filling stays in `raw_value`.
    """
    empty = F.array().cast(S.BOX_LIST)
    boxes = F.coalesce(F.transform(target["boxes"], lambda b: G.norm_box(b, w, h)), empty)
    points = F.coalesce(F.transform(target["points"], lambda p: G.norm_point(p, w, h)), empty)
    every = lambda b, p: F.transform(turns, lambda t: _fill_turn(t, b, p, take_all, as_box, as_point, strict))
    return let2(boxes, points, every)


def fill_multi_image(turns: Column, targets: Column, as_box=_plain_box, as_point=format_plain, strict: bool = True):
    """As `fill_conversation` for several images: targets carry their own size and indexes are pairs."""
    boxes = F.transform(targets, lambda t: F.transform(t["boxes"], lambda b: G.norm_box(b, t["width"], t["height"])))
    points = F.transform(
        targets, lambda t: F.transform(t["points"], lambda p: G.norm_point(p, t["width"], t["height"]))
    )
    every = lambda b, p: F.transform(turns, lambda t: _fill_turn(t, b, p, take_pairs, as_box, as_point, strict))
    return let2(boxes, points, every)
