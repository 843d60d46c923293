from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions import coords, draws, geometry, prompts, text, tokens
from lumenfold.operators.entities import parse_phrases


def lit_array(values, ddl):
    import json

    return F.from_json(F.lit(json.dumps(values)), ddl)


def boxes(values):
    return lit_array(values, S.BOX_LIST)


def tup(row):
    return None if row is None else [list(x) if isinstance(x, list) else x for x in row]


def test_rounding_is_that_of_python(spark):
    values = [k / 2000 for k in range(2001)] + [v / w for w in (333, 400, 480, 640) for v in range(0, w, 3)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", geometry.round_exact(F.col("x")).alias("r"))
    assert all(r == round(x, 3) for x, r in df.collect())
    shown = df.select("x", coords.format_plain(F.array(F.array("x"))).alias("s")).collect()
    assert all(s == f"[{x:.3f}]" for x, s in shown)


def test_norm_box_clamps_and_rounds(one):
    assert one(geometry.norm_box(F.array(*map(F.lit, [0.0625, -5.0, 2.0, 1.0])), F.lit(1), F.lit(4))) == [0.062, 0.0, 1.0, 0.25]


def test_norm_point_is_not_rounded(one):
    assert one(geometry.norm_point(F.array(F.lit(1.0), F.lit(1.0)), F.lit(16), F.lit(3))) == [0.0625, 1 / 3]


def test_denorm_and_xywh(one):
    b = F.array(*map(F.lit, [0.5, 0.25, 1.0, 0.5]))
    assert one(geometry.denorm_box(b, 10, 8)) == [5.0, 2.0, 10.0, 4.0]
    assert one(geometry.xywh_to_xyxy(F.array(*map(F.lit, [1, 2, 10, 10])), 6, None)) == [1, 2, 6, 12]


def test_clean_box_repairs_reversed_and_outside(one):
    assert one(geometry.clean_box(F.array(*map(F.lit, [9.0, -3.0, 4.0, 50.0])), F.lit(20), F.lit(30))) == [9.0, 0.0, 10.0, 30.0]


def test_expand_square(one):
    b = F.array(*map(F.lit, [1, 2, 3, 4]))
    assert one(geometry.expand_box(b, 10, 5)) == [1, 4, 3, 6]
    assert one(geometry.expand_box(b, 5, 10)) == [3, 2, 5, 4]
    assert one(geometry.expand_box(b, 5, 5)) == [1, 2, 3, 4]
    assert one(geometry.expand_point(F.array(F.lit(1), F.lit(2)), 5, 10)) == [3, 2]


def test_iou_of_empty_boxes_is_null(one):
    zero = F.array(*[F.lit(0.0)] * 4)
    unit = F.array(*map(F.lit, [0.0, 0.0, 1.0, 1.0]))
    assert one(geometry.iou(zero, zero)) is None
    assert one(geometry.iou(unit, unit)) == 1.0


def test_plain_text_round_trip(one):
    value = [[[0.123, 0.5, 1.0, 0.999]], [[0.0, 0.0, 0.1, 0.1], [0.2, 0.2, 0.3, 0.3]]]
    groups = lit_array(value, "array<array<array<double>>>")
    shown = F.array_join(F.transform(groups, lambda g: coords.format_plain(g)), " and ")
    assert one(shown) == "[0.123,0.500,1.000,0.999] and [0.000,0.000,0.100,0.100;0.200,0.200,0.300,0.300]"
    assert one(coords.parse_plain_boxes(shown)) == value
    small = F.transform(groups, lambda g: coords.format_plain(g, round_brackets=True))
    assert one(coords.parse_plain_boxes(F.array_join(small, ""), round_brackets=True)) == value


def test_points_round_trip(one):
    value = [[[0.123, 0.5]], [[0.0, 0.25], [0.2, 0.3]]]
    groups = lit_array(value, "array<array<array<double>>>")
    assert one(coords.parse_plain_points(F.array_join(F.transform(groups, lambda g: coords.format_plain(g)), "x"))) == value
    tokens_text = F.array_join(F.transform(groups, lambda g: coords.format_point_tokens(g)), "x")
    assert one(tokens_text) == "<p_st><bin_123> <bin_500><p_ed>x<p_st><bin_0> <bin_250><p_sep><bin_200> <bin_300><p_ed>"
    assert one(coords.parse_point_tokens(tokens_text)) == value


def test_box_tokens_round_trip(one):
    value = [[[0.123, 0.5, 1.0, 0.999], [0.0, 0.0, 0.1, 0.1]]]
    groups = lit_array(value, "array<array<array<double>>>")
    shown = F.array_join(F.transform(groups, lambda g: coords.format_box_tokens(g)), "")
    assert one(shown) == "<b_st><bin_123> <bin_500> <bin_1000> <bin_999><b_sep><bin_0> <bin_0> <bin_100> <bin_100><b_ed>"
    assert one(coords.parse_box_tokens(shown)) == value


def test_single_box(one):
    one_box, two = F.lit("a [0.1,0.2,0.3,0.4]"), F.lit("[0.1,0.2,0.3,0.4;0.1,0.2,0.3,0.4]")
    assert one(coords.single_box(coords.parse_plain_boxes(one_box))) == [0.1, 0.2, 0.3, 0.4]
    assert one(coords.single_box(coords.parse_plain_boxes(two))) is None
    assert one(coords.single_box(coords.parse_plain_boxes(F.lit("nothing")))) is None


def test_fill_keeps_braces_and_checks_counts(one):
    values = F.array(F.lit("X"), F.lit("Y"))
    assert one(coords.fill(F.lit("{} <boxes> {0}<boxes>"), S.BOXES, values)) == "{} X {0}Y"
    assert one(coords.fill(F.lit("<boxes>"), S.BOXES, values, strict=False)) is None
    with pytest.raises(Exception, match="placeholder count"):
        one(coords.fill(F.lit("<boxes>"), S.BOXES, values))


def turns(*items):
    return lit_array([dict(zip(["from", "value", "boxes_seq", "points_seq"], t)) for t in items], S.TURNS)


def test_fill_conversation_null_is_not_empty(one):
    aim = F.struct(boxes([[0, 0, 5, 10]]).alias("boxes"), boxes([[5, 5]]).alias("points"))
    conv = turns(
        ("human", "where <boxes>?", None, None), ("gpt", "at <boxes> <points>", [[0]], [[0]]), ("gpt", "no", [], None)
    )
    out = one(coords.fill_conversation(conv, aim, F.lit(10), F.lit(10)))
    assert [t["value"] for t in out] == ["where <boxes>?", "at [0.000,0.000,0.500,1.000] [0.500,0.500]", "no"]
    assert [t["raw_value"] for t in out] == [None, "at <boxes> <points>", "no"]
    with pytest.raises(Exception, match="placeholder count"):
        one(coords.fill_conversation(turns(("human", "<boxes>", [], None)), aim, F.lit(10), F.lit(10)))
    with pytest.raises(Exception, match="index out of range"):
        one(coords.fill_conversation(turns(("human", "<boxes>", [[1]], None)), aim, F.lit(10), F.lit(10)))


def test_fill_multi_image_points_come_from_points(one):
    targets = lit_array(
        [{"boxes": [[0, 0, 1, 1]], "points": [[1, 1]], "width": 2, "height": 2},
         {"boxes": [[0, 0, 4, 4]], "points": [[2, 1]], "width": 4, "height": 4}],
        f"array<struct<boxes:{S.BOX_LIST},points:{S.BOX_LIST},width:int,height:int>>",
    )
    pair_seq = "array<array<struct<img:int,box:int>>>"
    conv = lit_array(
        [{"from": "human", "value": "<boxes> <points>", "boxes_seq": [[{"img": 1, "box": 0}]],
          "points_seq": [[{"img": 1, "box": 0}, {"img": 0, "box": 0}]]}],
        f"array<struct<from:string,value:string,boxes_seq:{pair_seq},points_seq:{pair_seq}>>",
    )
    out = one(coords.fill_multi_image(conv, targets))
    assert out[0]["value"] == "[0.000,0.000,1.000,1.000] [0.500,0.250;0.500,0.500]"


def test_dedup_index(one):
    groups = lit_array([[[1, 1], [2, 2]], [[1, 1]]], "array<array<array<double>>>")
    values = geometry.first_seen(F.flatten(groups))
    assert one(values) == [[1.0, 1.0], [2.0, 2.0]]
    assert one(geometry.positions_in(values, groups)) == [[0, 1], [0]]


def messages(*pairs):
    return lit_array([{"role": r, "message": m} for r, m in pairs], prompts.MESSAGES)


HELLO = [("R0", "Hello!"), ("R1", "Hi!"), ("R0", "How?"), ("R1", None)]
EXPECTED = {
    "koala_v1": "BEGINNING OF CONVERSATION: R0: Hello! R1: Hi!</s>R0: How? R1:",
    "hypnotized_ans_v1.0": " R0: Hello! R1: Hi!</s>R0: How? R1:",
    "otter": " R0 Hello! R1 Hi!<|endofchunk|>R0 How? R1",
    "oasst_pythia": "R0Hello!<|endoftext|>R1Hi!<|endoftext|>R0How?<|endoftext|>R1",
    "claude": "\n\nR0: Hello!\n\nR1: Hi!\n\nR0: How?\n\nR1:",
    "billa": "\nR0: Hello!\nR1: Hi!\nR0: How?\nR1: ",
}
TAILS = {
    "dolly_v2": "R0:\nHello!\n\nR1:\nHi!### End\n\nR0:\nHow?\n\nR1:\n",
    "phoenix": "R0: <s>Hello!</s>R1: <s>Hi!</s>R0: <s>How?</s>R1: <s>",
    "mpt": "<|im_end|>R0\nHello!<|im_end|>R1\nHi!<|im_end|>R0\nHow?<|im_end|>R1\n",
    "baize": "\n[|Human|]Hello!\n[|AI|]Hi!\nR0Hello!\nR1Hi!\nR0How?\nR1",
    "rwkv": "R0: Hello!\n\nR1: Hi!\n\nR0: How?\n\nR1:",
    "one_shot": "instability.\n### R0: Hello!\n### R1: Hi!\n### R0: How?\n### R1:",
}


@pytest.mark.parametrize("mode", EXPECTED)
def test_prompt_styles(one, mode):
    assert one(prompts.render(mode, messages(*HELLO))) == EXPECTED[mode]


@pytest.mark.parametrize("mode", TAILS)
def test_prompt_styles_with_system(one, mode):
    out = one(prompts.render(mode, messages(*HELLO)))
    assert out.endswith(TAILS[mode])
    assert out.startswith(prompts.get_template(mode).system)


def test_rwkv_folds_newlines(one):
    out = one(prompts.render("rwkv", messages(("R0", "a\r\n\r\nb")), with_preset=False))
    assert out.endswith("R0: a\nb\n\n")


def test_registry(spark):
    assert prompts.templates_frame(spark).count() == 23
    for name in ("chatgpt", "bard"):
        with pytest.raises(ValueError, match="no prompt style"):
            prompts.layout(prompts.get_template(name))
    with pytest.raises(KeyError):
        prompts.get_template("nope")
    assert prompts.get_template("common").name == "vicuna_v1.1"
    assert prompts.get_template("icl").name == "icl_v1.0"


def test_first_turn_must_be_human(one):
    with pytest.raises(Exception, match="first turn"):
        one(prompts.to_messages(turns(("gpt", "x", None, None)), "common"))


def test_image_tokens(one):
    assert one(prompts.expand_image(F.lit("a <image>"), 2)) == "a <im_start><im_patch><im_patch><im_end>"
    assert one(prompts.expand_image(F.lit("a <image>"), 1, wrap=False)) == "a <im_patch>"
    assert one(prompts.image_to_front(F.lit(" what is <image> \n"), "vicuna_v1.1")) == "<image> USER: what is"


def test_loss_segments(one):
    seg = lambda s, **k: [(x["text"], x["trainable"]) for x in one(prompts.loss_segments(F.lit(s), **k))]
    assert seg("S USER: q ASSISTANT: a</s>USER: r ASSISTANT: b</s>") == [
        ("S USER: q ASSISTANT: ", False), ("a</s>", True), ("USER: r ASSISTANT: ", False), ("b</s>", True),
    ]
    # A round without an answer ends the count; with the rest not empty nothing is trained on.
    assert seg("S USER: q ASSISTANT: a</s>USER: r") == [
        ("S USER: q ASSISTANT: ", False), ("a</s>", False), ("USER: r", False)
    ]
    assert seg("S USER: q ASSISTANT: a</s>USER: r", mask_on_mismatch=False)[1] == ("a</s>", True)


def test_prompt_and_target(one):
    m = messages(("USER", "q"), ("ASSISTANT", "a"))
    out = one(prompts.prompt_and_target("final_v1.0", m))
    assert out["prompt"] == "[FINAL QUESTION]:  USER: q ASSISTANT:"
    assert out["target"] == "[FINAL QUESTION]:  USER: q ASSISTANT: a</s>"
    assert one(prompts.prompt_and_target("final_v1.0", m, support=True))["prompt"].endswith("a</s>")


def test_a_conversation_brings_its_own_system_text(one):
    said, own, none = messages(*HELLO), F.lit("Be brief."), F.lit(None).cast("string")
    for mode in ("vicuna_v1.1", "otter", "baize", "mpt", "claude", "dolly_v2"):
        plain, t = one(prompts.render(mode, said)), prompts.get_template(mode)
        assert one(prompts.render(mode, said, system=none)) == plain
        assert one(prompts.render(mode, said, system=own)) == "Be brief." + plain.removeprefix(t.system)
    # This style prints no system text.
    assert one(prompts.render("hypnotized_ans_v1.0", said, system=own)) == one(prompts.render("hypnotized_ans_v1.0", said))
    assert one(prompts.openai_messages("chatgpt", said, own))[0]["content"] == "Be brief."
    assert '"system":"Be brief."' in one(prompts.conversation_record("claude", said, system=own))


def test_message_formats(one):
    out = one(prompts.openai_messages("chatgpt", messages(*HELLO)))
    assert [(x["role"], x["content"]) for x in out] == [
        ("system", "You are a helpful assistant."), ("user", "Hello!"), ("assistant", "Hi!"), ("user", "How?"),
    ]
    assert [tuple(p) for p in one(prompts.chat_pairs(messages(*HELLO)))] == [("Hello!", "Hi!"), ("How?", None)]
    assert one(prompts.chat_pairs(messages())) == []
    rec = one(prompts.conversation_record("claude", messages(("Human", "x")), F.lit(3)))
    assert rec == (
        '{"name":"claude","system":"","roles":["Human","Assistant"],"messages":[["Human","x"]],'
        '"offset":0,"conv_id":"3","model_name":null}'
    )


def test_truncation_flags_rows_with_too_many_protected_tokens(one):
    toks = F.split(F.lit("<im_patch> <im_patch> a"), " ")
    assert one(tokens.kept_positions(toks, 1, on_error="flag")) is None
    assert one(tokens.kept_positions(toks, 2, on_error="flag")) == [0, 1]


def test_truncation_protects_image_tokens(one):
    toks = lambda s: F.split(F.lit(s), " ")
    cut = lambda s, k: " ".join(one(tokens.at_positions(toks(s), tokens.kept_positions(toks(s), k))))
    assert cut("a b c d", 4) == "a b c d"
    assert cut("a b c d", 2) == "a b"
    assert cut("a <im_start> <im_patch> b <im_end> c", 4) == "a <im_start> <im_patch> <im_end>"
    assert cut("a <im_start> <im_patch> b <im_end> c", 3) == "<im_start> <im_patch> <im_end>"
    with pytest.raises(Exception, match="protected tokens exceed"):
        cut("a <im_start> <im_patch> b <im_end> c", 2)


def test_episode_concat(one):
    ddl = "array<struct<input_ids:array<int>,attention_mask:array<int>,labels:array<int>>>"
    item = lambda *ids: {"input_ids": list(ids), "attention_mask": [1] * len(ids), "labels": list(ids)}
    out = one(tokens.concat_episode(lit_array([item(1, 2), item(3, 4), item(5, 6)], ddl)))
    assert out["input_ids"] == [1, 2, 3, 5, 6]
    assert out["labels"] == [-100, -100, -100, 5, 6]
    assert one(tokens.concat_episode(lit_array([item(1, 2)], ddl)))["labels"] == [1, 2]


def test_padding(spark):
    rows = [(0, [1], [1], [1]), (1, [1, 2, 3], [1, 1, 1], [1, 2, 3]), (2, [9], [1], [9])]
    df = spark.createDataFrame(rows, "row_id bigint, input_ids array<int>, attention_mask array<int>, labels array<int>")
    got = {r.row_id: r for r in tokens.pad_batches(df, 2, 0).collect()}
    assert got[0].input_ids == [1, 0, 0] and got[0].labels == [1, -100, -100] and got[0].attention_mask == [1, 0, 0]
    assert got[2].input_ids == [9]
    assert {r.row_id: r for r in tokens.pad_batches(df, 2, 0, left=True).collect()}[0].input_ids == [0, 0, 1]


def test_image_span_problem(one):
    check = lambda s, **k: one(tokens.image_span_problem(F.split(F.lit(s), " "), 2, **k))
    p = "<im_patch>"
    assert check("a b") is None
    assert check(f"a <im_start> {p} {p} <im_end>") is None
    assert check(f"a <im_start> {p} <im_end>") == "end token does not follow the patches"
    assert check(f"a <im_start> {p} {p}") == "start and end counts differ"
    assert check(f"a {p} {p}", wrap=False) is None
    assert check(f"{p} a {p}", wrap=False) == "patches are not consecutive"
    assert check(f"{p}", wrap=False) == "patch count is wrong"


def test_reorder_images(one):
    t = lit_array([{"image_seq": [1]}, {"image_seq": None}, {"image_seq": [0, 1]}], "array<struct<image_seq:array<int>>>")
    assert one(tokens.reorder_images(F.array(F.lit("a"), F.lit("b")), t)) == ["b", "a", "b"]
    assert one(tokens.negatives_to_pad(F.array(F.lit(-100), F.lit(5)), 0)) == [0, 5]


def test_extractors(one):
    gqa = lambda s: one(text.extract_answer(F.lit(s)))
    assert gqa("So the answer is yes. ") == "yes"
    assert gqa("Answer: a b..") == "a b"
    assert gqa("The answer is a\nthe answer is b") is None
    assert gqa("no idea") is None
    point = lambda s: one(text.extract_sentence_answer(F.lit(s)))
    assert point("The answer is a dog. And so on.") == "a dog"
    assert point("The answer is a. The answer is b.") is None
    assert one(text.extract_label(F.lit('x ASSISTANT: y ASSISTANT: there is "Cat." in the image.</s>z'))) == "cat"
    assert one(text.scrub(F.lit("a[BEGIN EXAMPLE]<im<image>age>"))) == "a<image>"


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(200).select("id", draws.rank32(1, F.col("id")).alias("r"), draws.random_word(1, 10, 7, F.col("id")).alias("w"))
    one_part = sorted(map(tuple, df.repartition(1).collect()))
    assert one_part == sorted(map(tuple, df.repartition(7).collect()))
    assert all(1 <= len(w) <= 10 and w.isalpha() and w.islower() for _, _, w in one_part)
    assert len({len(w) for _, _, w in one_part}) == 10


def test_falling_weights(spark):
    counts = dict(
        spark.range(20000).select(draws.falling_weight_index(F.lit(3), F.col("id")).alias("k")).groupBy("k").count().collect()
    )
    assert abs(counts[0] / 20000 - 3 / 6) < 0.02 and abs(counts[2] / 20000 - 1 / 6) < 0.02


def test_phrase_parse(one):
    out = one(parse_phrases(F.lit("[/EN#1/people Two men] ride [/EN#22/vehicles/other a red bike] . [x")))
    assert out["sentence"] == "Two men ride a red bike ."
    assert [tuple(p) for p in out["phrases"]] == [
        (0, "Two men", "1", ["people"]), (3, "a red bike", "22", ["vehicles", "other"]),
    ]
