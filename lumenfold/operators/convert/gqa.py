"""Scene-graph questions in 3 question forms x 7 answer forms.

Answer forms: `a` short answer; `c`/`bc` reasoning without/with boxes; `s`/`bs` semantic program
without/with boxes; `l`/`bl` full sentence without/with boxes. Question forms: `q` plain, `qb`
with boxes, `qbp` either. Boxes of a question continue the answer's box list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.binding import let, let2
from lumenfold.functions.draws import chance
from lumenfold.functions.geometry import first_seen, positions_in
from lumenfold.functions.text import drop_markers, markers_to_boxes, strip, swap, template, words
from lumenfold.operators.convert.base import item, seq, target, turn

# Reference groups in a semantic string, with the spaces around them (fixed value).
ID_GROUP = r"(\s\((?:(?:\d+(?:,\d+)*)|-)\)\s?)"
QUESTION_FORMS = ["q", "qb", "qbp"]
ANSWER_FORMS = ["a", "c", "bc", "s", "bs", "l", "bl"]

_NO_BOXES = lambda: F.array().cast(S.BOX_LIST)


def _box_of(objects: Column, rid: Column) -> Column:
    return let(objects[rid], lambda o: _corners(o, rid))


def _corners(o: Column, rid: Column) -> Column:
    box = F.array(o["x"], o["y"], o["x"] + o["w"], o["y"] + o["h"]).cast("array<double>")
    missing = F.raise_error(F.concat(F.lit("object is not in the scene: "), rid)).cast("array<double>")
    return F.when(o.isNull(), missing).otherwise(box)


def _boxes_of(objects: Column, id_lists: Column) -> Column:
    return F.transform(id_lists, lambda ids: F.transform(ids, lambda r: _box_of(objects, r)))


def _semantic_groups(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ID_GROUP), F.lit(1))


def semantic_with_boxes(text: Column) -> Column:
    """Id groups become box placeholders, `(-)` groups vanish."""
    groups = _semantic_groups(text)
    mark = F.transform(groups, lambda g: F.when(F.contains(g, F.lit("-")), F.lit("")).otherwise(F.lit(S.BOXES)))
    parts = F.split(text, ID_GROUP, -1)
    join = lambda m: F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(m, i), F.lit(""))))
    return F.array_join(let(mark, join), "")


def semantic_ids(text: Column) -> Column:
    """Object ids of each group that has any."""
    filled = F.filter(_semantic_groups(text), lambda g: ~F.contains(g, F.lit("-")))
    return F.transform(filled, lambda g: F.split(F.regexp_replace(g, r"[\s()]", ""), ","))


def _spans(spans: Column) -> Column:
    """Map `a:b` or `a` to the index of the last word, with the ids."""
    def one(e):
        last = let(
            F.split(e["key"], ":").cast("array<int>"),
            lambda ends: F.when(F.size(ends) == 1, ends[0]).otherwise(F.get(ends, 1) - 1),
        )
        return F.struct(last.alias("last"), F.split(e["value"], ",").alias("ids"))

    return F.transform(F.map_entries(spans), one)


def mark_spans(sentence: Column, spans: Column, join_with: str) -> Column:
    """A box placeholder after the last word of each span."""
    ends = F.transform(_spans(spans), lambda s: s["last"])
    return let2(words(sentence), ends, lambda p, e: _mark_words(p, e, join_with))


def _mark_words(parts: Column, ends: Column, join_with: str) -> Column:
    outside = F.exists(ends, lambda e: (e < 0) | (e >= F.size(parts)))
    marked = F.transform(
        parts, lambda w, i: F.concat(w, F.repeat(F.lit(S.BOXES), F.size(F.filter(ends, lambda e: e == i))))
    )
    return F.when(outside, F.raise_error(F.lit("span is outside the sentence")).cast("string")).otherwise(
        F.array_join(marked, join_with)
    )


def _span_ids(spans: Column) -> Column:
    return F.transform(_spans(spans), lambda s: s["ids"])


def _full_sentence(df: DataFrame, join_with: str) -> Column:
    plain = strip(F.regexp_replace(df["fullAnswer"], r"^(?:Yes|No),", ""))
    return F.concat(
        mark_spans(plain, df["annotations"]["fullAnswer"], join_with), F.lit("The answer is "), df["answer"], F.lit(".")
    )


def _answer(df: DataFrame, form: str, join_with: str) -> tuple[Column, Column]:
    """Text of the answer, and the scene boxes of each of its placeholders."""
    short = F.concat(F.lit("The answer is "), df["answer"], F.lit("."))
    if form == "a":
        return short, _empty_groups()
    if form == "c":
        return drop_markers(df["cot"]["value"]), _empty_groups()
    if form == "bc":
        return markers_to_boxes(df["cot"]["value"]), _empty_groups()
    if form == "s":
        bare = F.regexp_replace(df["semanticStr"], ID_GROUP, "")
        return F.concat(bare, F.lit(". "), short), _empty_groups()
    if form == "l":
        return swap(_full_sentence(df, join_with), S.BOXES, ""), _empty_groups()
    if form == "bs":
        text = F.concat(semantic_with_boxes(df["semanticStr"]), F.lit(". "), short)
        return text, _boxes_of(df["objects"], semantic_ids(df["semanticStr"]))
    return _full_sentence(df, join_with), _boxes_of(df["objects"], _span_ids(df["annotations"]["fullAnswer"]))


def _empty_groups() -> Column:
    return F.array().cast("array<array<array<double>>>")


def _place(given: Column, answer_groups: Column, question_groups: Column) -> Column:
    """`struct<answer_boxes,answer_seq,boxes,seq>`: box lists without and with the question's boxes."""
    def extend(known: Column) -> Column:
        fresh = first_seen(F.filter(F.flatten(question_groups), lambda b: ~F.array_contains(known, b)))
        return let(
            F.concat(known, fresh),
            lambda more: F.struct(
                known.alias("answer_boxes"),
                positions_in(known, answer_groups).alias("answer_seq"),
                more.alias("boxes"),
                positions_in(more, question_groups).alias("seq"),
            ),
        )

    return let(F.concat(given, first_seen(F.flatten(answer_groups))), extend)


def gqa(
    df: DataFrame,
    version: str,
    templates: Sequence[str],
    seed: int = 0,
    box_prob: float = 0.5,
    join_with: str = "",
) -> DataFrame:
    """Convert under `question-answer` version, e.g. `qb-bs`.

    Forms with scene boxes need the scene's `objects` map next to the question. `join_with` is the
    text between words of full-sentence answers (nothing by default, as models were trained).
    """
    qform, _, aform = version.partition("-")
    if qform not in QUESTION_FORMS or aform not in ANSWER_FORMS:
        raise ValueError(f"unknown version: {version}")
    said, answer_groups = _answer(df, aform, join_with)
    given = df["cot"]["boxes"] if aform == "bc" else _NO_BOXES()
    asked, question_groups, boxed = df["question"], _empty_groups(), F.lit(False)
    if qform != "q":
        spans = df["annotations"]["question"]
        question_groups = _boxes_of(df["objects"], _span_ids(spans))
        boxed = F.lit(True) if qform == "qb" else chance(box_prob, seed, df["row_id"], "boxed")
        asked = F.when(boxed, mark_spans(df["question"], spans, " ")).otherwise(df["question"])
    full = swap(template(templates, seed, df["row_id"]), S.QUESTION, asked)
    placed = df.select(
        "row_id", F.concat("imageId", F.lit(".jpg")).alias("image"), full.alias("_asked"), said.alias("_said"),
        boxed.alias("_boxed"), _place(given, answer_groups, question_groups).alias("_p"),
        (df["cot"]["seq"] if aform == "bc" else F.lit(None).cast(S.SEQ)).alias("_seq"),
    )
    asked_seq = F.when(F.col("_boxed"), F.col("_p.seq")).otherwise(seq())
    said_seq = F.coalesce(F.col("_seq"), F.col("_p.answer_seq"))
    return item(
        placed,
        F.col("image"),
        [turn("human", F.col("_asked"), asked_seq), turn("gpt", F.col("_said"), said_seq)],
        target(F.when(F.col("_boxed"), F.col("_p.boxes")).otherwise(F.col("_p.answer_boxes"))),
    )
