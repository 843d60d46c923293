"""Text helpers with Python's whitespace rules, and the answer extractors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.binding import let
from lumenfold.functions.draws import pick

_SPACE = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)^{_SPACE}+|{_SPACE}+$"

# Extraction patterns (fixed values).
ANSWER_PATTERN = r"(?d)(?:(?:So t|T|t)he answer is|Answer:) (.+)"
SENTENCE_ANSWER_PATTERN = r"(?d)The answer is (.+?)\."
CONTROL_TOKENS = ["<image>", "<im_start>", "<im_end>", "[BEGIN EXAMPLE]", "[END EXAMPLE]", "[FINAL QUESTION]"]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def words(text: Column) -> Column:
    """Split on runs of whitespace; no empty words."""
    return F.filter(F.split(text, rf"(?U){_SPACE}+"), lambda w: F.length(w) > 0)


def swap(text: Column, old: str, new) -> Column:
    """Replace all occurrences of a literal."""
    return F.replace(text, F.lit(old), new if isinstance(new, Column) else F.lit(new))


def markers_to_boxes(text: Column) -> Column:
    return swap(swap(text, S.PHRASE_START, ""), S.PHRASE_END, S.BOXES)


def drop_markers(text: Column) -> Column:
    return swap(swap(text, S.PHRASE_START, ""), S.PHRASE_END, "")


def template(templates: Sequence[str], *key) -> Column:
    """One template text per key; repeated entries act as weights."""
    if not templates:
        raise ValueError("a template set needs at least one text")
    if len(templates) == 1:
        return F.lit(templates[0])
    return pick(F.array(*[F.lit(t) for t in templates]), *key, "template")


def scrub(text: Column) -> Column:
    """Remove control tokens from user text, one after another."""
    for token in CONTROL_TOKENS:
        text = swap(text, token, "")
    return text


def _single(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(strip(text), F.lit(pattern), F.lit(1))
    return let(found, lambda f: F.when(F.size(f) == 1, F.get(f, 0)))


def extract_answer(text: Column) -> Column:
    """`... the answer is X.` or `Answer: X`, exactly once; null otherwise."""
    return strip(F.regexp_replace(strip(_single(text, ANSWER_PATTERN)), r"\.+$", ""))


def extract_sentence_answer(text: Column) -> Column:
    """`The answer is X.`, exactly once, up to the first full stop."""
    return strip(_single(text, SENTENCE_ANSWER_PATTERN))


def extract_label(text: Column) -> Column:
    """Label of a `there is "X" in the image` target: last assistant part up to `</s>`."""
    return bare_label(F.substring_index(F.substring_index(text, "ASSISTANT:", -1), "</s>", 1))


def bare_label(text: Column) -> Column:
    for junk in ["The answer is", "there is", "in the image", '"', "'", "."]:
        text = swap(text, junk, "")
    return F.lower(strip(text))
