"""Commonsense questions whose sentences mix words and object lists; 9 versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.text import swap, template
from lumenfold.operators.convert.base import target, turn

# Letters, and texts around the parts of a turn (fixed values).
OPTIONS = "ABCDEFG"
CHOOSE = "You should decide on the best choice and output the corresponding letter."
EXPLAIN = "You should explain the reason for the above answer."
CHOOSE_REASON = (
    "You should decide on the best choice that explains the above answer and output the corresponding letter."
)
PREDICTION_NOTE = "WARNING: answer and rationale here are just placeholders. we have no real anno."

_ASK = [("QUESTION:", "question", "")]
_ASK_OPTIONS = [("QUESTION:", "question", ""), ("\nOPTIONS:", "answers", CHOOSE)]
# Per version, the turns (human first); a turn is a list of (text before, part, text after).
VERSIONS: dict[str, list[list[tuple[str, str, str]]]] = {
    "q-a": [_ASK, [("", "answer", "")]],
    "q-ra": [_ASK, [("", "rationale", ""), ("", "answer", "")]],
    "qc-a": [_ASK_OPTIONS, [("", "answer_letter", "")]],
    "qc-ra": [_ASK_OPTIONS, [("", "rationale", ""), ("", "answer_letter", "")]],
    "qc-rac": [_ASK_OPTIONS, [("", "rationale", ""), ("", "answer", ""), ("", "answer_letter", "")]],
    "qa-r": [[("QUESTION:", "question", ""), ("\nANSWER:", "answer", EXPLAIN)], [("", "rationale", "")]],
    "qac-r": [
        [
            ("QUESTION:", "question", ""),
            ("\nANSWER:", "answer", ""),
            ("\nRATIONALE OPTIONS:", "rationales", CHOOSE_REASON),
        ],
        [("", "rationale_letter", "")],
    ],
    "q-a-q-r": [_ASK, [("", "answer", "")], [("", "explain", "")], [("", "rationale", "")]],
    "qc-a-qc-r": [
        _ASK_OPTIONS,
        [("", "answer_letter", "")],
        [("RATIONALE OPTIONS:", "rationales", CHOOSE_REASON)],
        [("", "rationale_letter", "")],
    ],
}
PREDICTION_VERSIONS = ["qc-a", "qc-ra", "qc-rac", "qac-r", "qc-a-qc-r"]
RATIONALE_VERSIONS = ["qac-r", "qc-a-qc-r"]


def _pack(text: Column, boxes: Column) -> Column:
    return F.struct(text.alias("text"), boxes.cast(S.SEQ).alias("seq"))


def sentence_pack(json_text: str) -> str:
    """SQL for a mixed sentence in JSON: its text with box placeholders, and the index lists.

    Read as strings, a nested list is its JSON text and starts with a bracket. Only a sentence in
    which some word itself starts with one needs typed values (variants) to tell them apart.
    """
    plain = (
        f"transform(from_json({json_text}, 'array<string>', map('mode', 'FAILFAST')), w -> if(startswith(w, '['), "
        f"named_struct('w', '{S.BOXES}', 'l', if(w = '[]', cast(array() as array<int>), "
        f"cast(split(translate(w, '[] ', ''), ',') as array<int>))), named_struct('w', w, 'l', cast(null as array<int>))))"
    )
    typed = (
        f"transform(cast(parse_json({json_text}) as array<variant>), e -> named_struct("
        f"'w', if(try_variant_get(e, '$', 'array<int>') is null, cast(e as string), '{S.BOXES}'), "
        f"'l', try_variant_get(e, '$', 'array<int>')))"
    )
    words = f"if(contains({json_text}, '\"['), {typed}, {plain})"
    return (
        f"transform(array({words}), ws -> named_struct('text', array_join(transform(ws, x -> x.w), ' '), "
        f"'seq', filter(transform(ws, x -> x.l), l -> l is not null)))[0]"
    )


def _choices(packs: Column) -> Column:
    """All choices as `(A) ... (B) ...`; at most seven have a letter."""
    listed = F.slice(packs, 1, len(OPTIONS))
    letters = F.array(*[F.lit(c) for c in OPTIONS])
    text = F.array_join(F.transform(listed, lambda p, i: F.concat(F.lit("("), letters[i], F.lit(") "), p["text"])), " ")
    return _pack(text, F.flatten(F.transform(listed, lambda p: p["seq"])))


def _letter(label: Column) -> Column:
    letters = F.array(*[F.lit(c) for c in OPTIONS])
    return _pack(F.concat(F.lit("The answer is ("), letters[label], F.lit(").")), F.array())


def vcr(
    df: DataFrame,
    version: str,
    templates: Sequence[str],
    seed: int = 0,
) -> DataFrame:
    """Sentences are JSON text; a fifth box number (a probability) is dropped."""
    if version not in VERSIONS:
        raise ValueError(f"version must be one of {list(VERSIONS)}: {version}")
    return _render(_parse(df), version, templates, seed)


def _parse(df: DataFrame) -> DataFrame:
    """Sentences to packs, once per record; a version then only picks and joins them."""
    return df.select(
        "row_id",
        "img_fn",
        F.transform("boxes", lambda b: F.slice(b, 1, 4)).alias("boxes"),
        F.col("answer_label").alias("_a"),
        F.col("rationale_label").alias("_r"),
        F.expr(sentence_pack("question")).alias("_q"),
        F.expr(f"transform(answer_choices, s -> {sentence_pack('s')})").alias("_as"),
        F.expr(f"transform(rationale_choices, s -> {sentence_pack('s')})").alias("_rs"),
    )


def _render(parsed: DataFrame, version: str, templates: Sequence[str], seed: int, note: str = "") -> DataFrame:
    # Where a record becomes several rows, its choices were listed before.
    listed = lambda name, packs: F.col(name) if name in parsed.columns else _choices(F.col(packs))
    part = {
        "question": F.col("_q"),
        "answers": listed("_answers", "_as"),
        "rationales": listed("_rationales", "_rs"),
        "answer": F.col("_as")[F.col("_a")],
        "rationale": F.col("_rs")[F.col("_r")],
        "answer_letter": _letter(F.col("_a")),
        "rationale_letter": _letter(F.col("_r")),
        "explain": _pack(F.lit(EXPLAIN), F.array()),
    }

    def merged(pieces) -> tuple[Column, Column]:
        texts = [c for before, name, after in pieces
                 for c in ([F.lit(before)] if before else []) + [part[name]["text"]] + ([F.lit(after)] if after else [])]
        return F.concat_ws(" ", *texts), F.concat(*[part[name]["seq"] for _, name, _ in pieces])

    turns = []
    for n, pieces in enumerate(VERSIONS[version]):
        value, boxes_seq = merged(pieces)
        if n == 0:
            value = swap(template(templates, seed, F.col("row_id")), S.QUESTION, value)
        if note and n == len(VERSIONS[version]) - 1:
            value = F.concat(value, F.lit(note))
        turns.append(turn("human" if n % 2 == 0 else "gpt", value, boxes_seq))
    return parsed.select(
        "row_id", F.col("img_fn").alias("image"), target(F.col("boxes")).alias("target"),
        F.array(*turns).alias("conversations"),
    )


def vcr_pred(df: DataFrame, version: str, templates: Sequence[str], seed: int = 0) -> DataFrame:
    """Items to predict on, with forced labels and a note on the last turn.

    Rationale versions ask once per answer: each record becomes four rows, `row_id` = 4*id + answer.
    """
    if version not in PREDICTION_VERSIONS:
        raise ValueError(f"version must be one of {PREDICTION_VERSIONS}: {version}")
    parsed = _parse(df).withColumns({"_a": F.lit(0), "_r": F.lit(0)})
    if version in RATIONALE_VERSIONS:
        parsed = parsed.withColumns({"_answers": _choices(F.col("_as")), "_rationales": _choices(F.col("_rs"))})
        parsed = parsed.drop("_a").select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_a"))
        parsed = parsed.withColumn("row_id", F.col("row_id") * 4 + F.col("_a"))
    return _render(parsed, version, templates, seed, PREDICTION_NOTE)
