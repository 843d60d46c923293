"""Conversations to prompts, message lists and loss segments.

Messages are `array<struct<role,message>>`; a null or empty message prints its role only. A
style is three texts around role and message, so one expression renders all of them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions import prompt_templates as T
from lumenfold.functions.binding import let
from lumenfold.functions.prompt_templates import PromptTemplate, get_template
from lumenfold.functions.text import strip, swap

MESSAGES = "array<struct<role:string,message:string>>"


@dataclass(frozen=True)
class Layout:
    named: bool  # whether the system text is printed
    lead: str  # between the system text and the first role
    gap: str  # between role and message
    tails: tuple[str, str]  # after a message at an even / odd position
    bare: str  # after the role when there is no message


def layout(t: PromptTemplate) -> Layout:
    """The texts of a template's style; templates without a style cannot be rendered."""
    sep, sep2 = t.sep or "", t.sep2 or ""
    by_style = {
        T.ADD_COLON_SINGLE: Layout(True, sep, ": ", (sep, sep), ":"),
        T.EMPTY: Layout(False, sep, ": ", (sep, sep2), ":"),
        T.ADD_COLON_TWO: Layout(True, sep, ": ", (sep, sep2), ":"),
        T.ADD_SPACE_TWO: Layout(True, sep, " ", (sep, sep2), ""),
        T.NO_COLON_SINGLE: Layout(True, "", "", (sep, sep), ""),
        T.BAIZE: Layout(True, "\n", "", ("\n", "\n"), ""),
        T.DOLLY: Layout(True, "", ":\n", (sep, sep2 + "\n\n"), ":\n"),
        T.RWKV: Layout(True, "", ": ", ("\n\n", "\n\n"), ":"),
        T.PHOENIX: Layout(True, "", ": <s>", ("</s>", "</s>"), ": <s>"),
        T.NEW_LINE: Layout(True, sep, "\n", (sep, sep), "\n"),
        T.BILLA: Layout(True, sep, ": ", (sep, sep), ": "),
    }
    if t.style not in by_style:
        raise ValueError(f"template {t.name} has no prompt style: {t.style}")
    return by_style[t.style]


def segment(t: PromptTemplate, role: Column, message: Column, position: Column) -> Column:
    """Text of one message in a prompt; usable on one row per turn, without any grouping."""
    lay = layout(t)
    body = swap(swap(message, "\r\n", "\n"), "\n\n", "\n") if t.style == T.RWKV else message
    tail = F.lit(lay.tails[0])
    if lay.tails[0] != lay.tails[1]:
        tail = F.when(position % 2 == 0, F.lit(lay.tails[0])).otherwise(F.lit(lay.tails[1]))
    said = F.coalesce(F.length(message), F.lit(0)) > 0
    return F.when(said, F.concat(role, F.lit(lay.gap), body, tail)).otherwise(F.concat(role, F.lit(lay.bare)))


def system_text(t: PromptTemplate, system: Column | None = None) -> Column:
    """The row's own system text; where there is none, the template's."""
    return F.lit(t.system) if system is None else F.coalesce(system, F.lit(t.system))


def lead(t: PromptTemplate, system: Column | None = None) -> Column:
    """What stands before the first role. Styles that print no system text ignore the row's too."""
    lay = layout(t)
    return F.concat(system_text(t, system), F.lit(lay.lead)) if lay.named else F.lit(lay.lead)


def preset(t: PromptTemplate) -> Column:
    items = [F.struct(F.lit(r).alias("role"), F.lit(m).alias("message")) for r, m in t.messages]
    return F.array(*items).cast(MESSAGES)


def render(mode: str, messages: Column, with_preset: bool = True, system: Column | None = None) -> Column:
    """The whole prompt of one conversation under one template; `system` replaces its system text."""
    t = get_template(mode)
    everything = F.concat(preset(t), messages) if with_preset and t.messages else messages
    texts = F.transform(everything, lambda m, i: segment(t, m["role"], m["message"], i))
    return F.concat(lead(t, system), F.array_join(texts, ""))


def _by_mode(mode: Column, modes: Iterable[str], value) -> Column:
    out = None
    for m in modes:
        out = F.when(mode == m, value(m)) if out is None else out.when(mode == m, value(m))
    return out.otherwise(F.raise_error(F.concat(F.lit("unexpected mode: "), mode)).cast("string"))


def render_by_mode(mode: Column, turns: Column, modes: Iterable[str], system: Column | None = None) -> Column:
    """Prompt of human/gpt turns under the template each row names. A CASE over few modes: no join."""
    return _by_mode(mode, modes, lambda m: render(m, to_messages(turns, m), system=system))


def to_messages(turns: Column, mode: str) -> Column:
    """human/gpt turns to template roles; the first turn must be human and the list non-empty."""
    human, gpt = get_template(mode).roles
    mapped = F.transform(
        turns,
        lambda t: F.struct(
            F.when(t["from"] == "human", F.lit(human))
            .when(t["from"] == "gpt", F.lit(gpt))
            .otherwise(F.raise_error(F.concat(F.lit("unknown speaker: "), t["from"])).cast("string"))
            .alias("role"),
            t["value"].alias("message"),
        ),
    )
    ok = (F.size(turns) > 0) & (F.get(turns, 0)["from"] == "human")
    return F.when(ok, mapped).otherwise(F.raise_error(F.lit("first turn must be human")).cast(MESSAGES))


def empty_last(messages: Column) -> Column:
    """The last message blanked: what a model is asked to continue."""
    blank = lambda m, at_end: F.struct(
        m["role"].alias("role"), F.when(at_end, F.lit("")).otherwise(m["message"]).alias("message")
    )
    return let(messages, lambda ms: F.transform(ms, lambda m, i: blank(m, i == F.size(ms) - 1)))


def prompt_and_target(mode: str, messages: Column, support: bool = False, system: Column | None = None) -> Column:
    """`struct<prompt,target>`: target is the full text; a support item keeps its last message."""
    asked = messages if support else empty_last(messages)
    return F.struct(
        render(mode, asked, system=system).alias("prompt"), render(mode, messages, system=system).alias("target")
    )


def expand_image(text: Column, patches: int = 256, wrap: bool = True) -> Column:
    """`<image>` to its run of patch tokens."""
    run = S.IM_PATCH * patches
    return swap(text, S.IMAGE, S.IM_START + run + S.IM_END if wrap else run)


def image_to_front(text: Column, mode: str) -> Column:
    """First human text with `<image>` moved ahead of it, followed by a separator and the role."""
    t = get_template(mode)
    return F.concat(F.lit(f"{S.IMAGE}{t.sep}{t.roles[0]}: "), strip(swap(text, S.IMAGE, "")))


def image_first(turns: Column, mode: str) -> Column:
    """`image_to_front` on the first turn of a conversation."""
    return F.transform(
        turns,
        lambda t, i: t.withField("value", F.when(i == 0, image_to_front(t["value"], mode)).otherwise(t["value"])),
    )


def loss_segments(prompt: Column, mode: str = "vicuna_v1.1", mask_on_mismatch: bool = True) -> Column:
    """`array<struct<text,trainable>>` whose texts concatenate to the prompt.

    Per round the part up to and including `ASSISTANT: ` is masked and the answer with its end
    mark is kept. The first round that is empty or has not exactly one answer ends the count;
    what follows is masked, and if it is not empty the whole sample is.
    """
    t = get_template(mode)
    cut = f"{t.sep}{t.roles[1]}: "
    return let(F.split(prompt, rf"\Q{t.sep2}\E", -1), lambda rounds: _segments(rounds, t, cut, mask_on_mismatch))


def _segments(rounds: Column, t: PromptTemplate, cut: str, mask_on_mismatch: bool) -> Column:
    parts = F.transform(rounds, lambda r: F.split(r, rf"\Q{cut}\E", -1))
    fine = F.transform(parts, lambda p: F.size(p) == 2)
    first_bad = F.array_position(fine, False)
    good = F.when(first_bad == 0, F.size(rounds)).otherwise(first_bad.cast("int") - 1)
    return let(good, lambda n: _marked(rounds, parts, n, t, cut, mask_on_mismatch))


def _marked(rounds: Column, parts: Column, good: Column, t: PromptTemplate, cut: str, mask_on_mismatch: bool) -> Column:
    rest = F.array_join(F.slice(rounds, good + 1, F.size(rounds)), t.sep2)
    return let(rest, lambda r: _listed(rounds, parts, good, r, t, cut, mask_on_mismatch))


def _listed(rounds, parts, good, rest, t: PromptTemplate, cut: str, mask_on_mismatch: bool) -> Column:
    whole = (F.lit(not mask_on_mismatch)) | (F.length(rest) == 0)
    mark = lambda i: F.when(i < F.size(rounds) - 1, F.lit(t.sep2)).otherwise(F.lit(""))
    kept = F.flatten(
        F.transform(
            F.slice(parts, 1, good),
            lambda p, i: F.array(
                F.struct(F.concat(p[0], F.lit(cut)).alias("text"), F.lit(False).alias("trainable")),
                F.struct(F.concat(p[1], mark(i)).alias("text"), whole.alias("trainable")),
            ),
        )
    )
    tail = F.array(F.struct(rest.alias("text"), F.lit(False).alias("trainable")))
    return F.when(F.length(rest) > 0, F.concat(kept, tail)).otherwise(kept)


def openai_messages(mode: str, messages: Column, system: Column | None = None) -> Column:
    """System first, then user/assistant in turn from the template's offset; null answers left out."""
    t = get_template(mode)
    said = F.transform(
        F.slice(F.concat(preset(t), messages), t.offset + 1, 1 << 30) if t.messages else messages,
        lambda m, i: F.struct(
            F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), m["message"].alias("content")
        ),
    )
    kept = F.filter(said, lambda m: (m["role"] == "user") | m["content"].isNotNull())
    first = F.array(F.struct(F.lit("system").alias("role"), system_text(t, system).alias("content")))
    return F.concat(first, kept)


def chat_pairs(messages: Column, offset: int = 0) -> Column:
    """Question/answer pairs; the answer of an open question is null."""
    said = F.slice(messages, offset + 1, 1 << 30) if offset else messages
    pair = lambda ms, i: F.struct(
        F.get(ms, i * 2)["message"].alias("question"), F.get(ms, i * 2 + 1)["message"].alias("answer")
    )
    count = lambda ms: F.ceil(F.size(ms) / 2).cast("int")
    none = F.array().cast("array<struct<question:string,answer:string>>")
    pairs = lambda ms: F.transform(F.sequence(F.lit(0), count(ms) - 1), lambda i: pair(ms, i))
    return let(said, lambda ms: F.when(count(ms) > 0, pairs(ms)).otherwise(none))


def conversation_record(
    mode: str, messages: Column, conv_id=None, model_name=None, system: Column | None = None
) -> Column:
    """The conversation as JSON: name, system, roles, messages as pairs, offset, ids."""
    t = get_template(mode)
    null = F.lit(None).cast("string")
    return F.to_json(
        F.struct(
            F.lit(t.name).alias("name"),
            system_text(t, system).alias("system"),
            F.array(*[F.lit(r) for r in t.roles]).alias("roles"),
            F.transform(F.concat(preset(t), messages) if t.messages else messages,
                        lambda m: F.array(m["role"], m["message"])).alias("messages"),
            F.lit(t.offset).alias("offset"),
            (null if conv_id is None else conv_id.cast("string")).alias("conv_id"),
            (null if model_name is None else model_name).alias("model_name"),
        ),
        {"ignoreNullFields": "false"},
    )


def templates_frame(spark: SparkSession) -> DataFrame:
    """The registry as a table: 23 rows."""
    rows = [
        (t.name, t.system, list(t.roles), t.style, t.sep, t.sep2, [list(m) for m in t.messages], t.offset,
         t.stop_str, list(t.stop_token_ids))
        for t in T.TEMPLATES.values()
    ]
    return spark.createDataFrame(
        rows,
        "name string, system string, roles array<string>, style string, sep string, sep2 string, "
        "messages array<array<string>>, offset int, stop_str string, stop_token_ids array<int>",
    )
