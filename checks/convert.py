"""Annotation converters over records derived from orders, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import box, box_sql, flat_items, flat_sql, load, order60, query, rank32, table, template_sql
from lumenfold import schema as S
from lumenfold.functions.binding import explode_items
from lumenfold.operators import convert
from lumenfold.operators.convert.gqa import ANSWER_FORMS, QUESTION_FORMS
from lumenfold.operators.convert.vcr import PREDICTION_VERSIONS, RATIONALE_VERSIONS, VERSIONS
from lumenfold.sources import readers

ASK = ["<image> <question>", "Look at <image>. <question>", "<question> Answer from <image>."]
FIND = ["Where is <expr> in <image>?", "Point out <expr> in <image>."]
NAME = ["What is at <objs> in <image>?", "Describe <objs> of <image>."]
TELL = ["Describe <image>.", "What does <image> show?", "Caption <image>."]

JPG = "'img_'||id_text||'.jpg'"
A, B = box_sql("a"), box_sql("b")


def ask(question: str) -> str:
    return f"replace({template_sql(ASK, 0, 'row_id')},'<question>',{question})"


def records(spark, sf):
    df = load(spark, sf, "records")
    return df.withColumns({
        "img_path": F.concat(F.lit("img_"), "id_text", F.lit(".jpg")),
        "file_path": F.concat(F.lit("img_"), "id_text", F.lit(".jpg")),
        "bbox": box("a"), "boxes": F.array(box("a"), box("b")), "expression": F.concat(F.lit("the "), "word"),
    })


def seq(text: str):
    return F.expr(text).cast(S.SEQ)


@query("B1", flat_sql("(select doc_id row_id, * from documents)", "'doc_'||doc_id||'.jpg'", template_sql(TELL, 0, "row_id"), "text"))
def caption(spark, sf):
    df = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.concat(F.lit("doc_"), "doc_id", F.lit(".jpg")).alias("img_path"), F.col("text").alias("caption"))
    return flat_items(convert.caption(df, TELL))


# Synthetic scenes: a program of four steps over three objects.


def _clevr(spark, sf):
    q = load(spark, sf, "questions")
    step = lambda name, inputs, values, ans: F.struct(
        F.lit(name).alias("function"), F.expr(inputs).cast("array<int>").alias("inputs"),
        values.cast("array<string>").alias("value_inputs"), ans.cast("array<int>").alias("ans"))
    k = F.col("user_id")
    none = F.array()
    return q.select(
        "row_id", "image_index", F.col("image").alias("image_filename"),
        F.concat(F.lit("Is there a "), "event_type", F.lit("?")).alias("question"), F.col("event_type").alias("answer"),
        F.array(
            step("scene", "array()", F.lit(None), F.array(F.lit(0), F.lit(1), F.lit(2))),
            step("filter_color", "array(0)", F.array("event_type"), F.array((k % 2).cast("int"), F.lit(2))),
            step("exist", "array(1)", none, none),
            step("filter_size", "array(0)", F.array(F.lit("large")), F.when(k % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(2)))),
            step("count", "array(3)", none, none),
            step("union", "array(1,3)", none, F.when(k % 3 == 0, F.array((k % 2).cast("int"))).otherwise(F.array(F.lit(2), (k % 2).cast("int")))),
        ).alias("program"),
    )


def _scenes(spark, sf):
    point = lambda i: F.struct(F.array(F.col("x0") + i, F.col("y0"), F.lit(9.5)).alias("pixel_coords"))
    return load(spark, sf, "scenes").select("row_id", F.array(point(0), point(1), point(2)).alias("objects"))


_CQ = ask("'Is there a '||event_type||'?'")
_CA = "'The answer is '||event_type||'.'"


def _trace(p1: str, p2: str, p3: str) -> str:
    return (f"'scene -> filter_color:'||event_type||'[0]'||{p1}||' -> exist[1] -> filter_size:large[0]'||{p2}"
            f"||' -> count[3] -> union[1,3]'||{p3}||' '||{_CA}")


@query("B2", flat_sql("questions", "image", _CQ, _CA, points="''", q_points="''", a_points="''"), ["questions"])
def clevr_answer(spark, sf):
    return flat_items(convert.clevr(_clevr(spark, sf), "q-a", ASK))


@query("B3", flat_sql("questions", "image", _CQ, _trace("''", "''", "''"), points="''", q_points="''", a_points="''"), ["questions"])
def clevr_trace(spark, sf):
    return flat_items(convert.clevr(_clevr(spark, sf), "q-s", ASK))


_P = lambda i: f"(x0::bigint+{i})||','||y0::bigint"


@query("B4,A7", "with q as (select q.*, x0, y0 from questions q join scenes s on s.row_id=q.image_index) " + flat_sql(
    "q", "image", _CQ,
    _trace("'<points>'", "case when user_id%3=0 then ' Found no object.' else '<points>' end", "'<points>'"),
    points=f"{_P('user_id%2')}||';'||{_P(2)}", q_points="''",
    a_points="case when user_id%3=0 then '0,1;0' else '0,1;1;1,0' end"), ["questions", "scenes"])
def clevr_points(spark, sf):
    return flat_items(convert.clevr(readers.scenes_by_line(_clevr(spark, sf), _scenes(spark, sf)), "q-bs", ASK))


@query("B5", flat_sql("records", "id_text||'.jpg'", template_sql(TELL, 0, "row_id"),
                      "'A '||word||'<boxes> by '||st||'<boxes> .'", boxes=f"{A}||';'||{B}", a_boxes="'0;0,1'"), ["records"])
def flickr(spark, sf):
    df = records(spark, sf).select(
        "row_id", F.col("id_text").alias("image_id"), "boxes",
        F.concat(F.lit("<ph_st>A "), "word", F.lit("<ph_ed> by <ph_st>"), "st", F.lit("<ph_ed> .")).alias("sentence"),
        seq("array(array(0),array(0,1))").alias("boxes_seq"))
    return flat_items(convert.flickr(df, TELL))


def _generated(spark, sf):
    return records(spark, sf).select(
        "row_id", "img_path", "boxes", "answer",
        F.concat(F.lit("Is <ph_st>"), "word", F.lit("<ph_ed> here?")).alias("question"), seq("array(array(1))").alias("question_boxes_seq"),
        F.concat(F.lit("See <ph_st>"), "st", F.lit("<ph_ed>: "), "answer").alias("cot_with_ans"), seq("array(array(0))").alias("answer_boxes_seq"))


for _v, _text, _aseq in [("a", "answer", "null"), ("c", "'See '||st||': '||answer", "null"), ("bc", "'See '||st||'<boxes>: '||answer", "'0'")]:
    query("B6", flat_sql("records", JPG, ask("'Is '||word||'<boxes> here?'"), _text, boxes=f"{A}||';'||{B}", q_boxes="'1'", a_boxes=_aseq),
          ["records"], name=f"gpt4gen_{_v}")(lambda spark, sf, v=_v: flat_items(convert.gpt4gen(_generated(spark, sf), v, ASK)))


# Scene-graph questions: three objects, the third equal to the first in even rows.


def _gqa(spark, sf):
    o = lambda p, dx: F.struct((F.col(f"{p}x1") + dx).cast("int").alias("x"), F.col(f"{p}y1").cast("int").alias("y"),
                               (F.col(f"{p}x2") - F.col(f"{p}x1")).cast("int").alias("w"), (F.col(f"{p}y2") - F.col(f"{p}y1")).cast("int").alias("h"))
    shift = (F.col("row_id") % 2).cast("int")
    questions = records(spark, sf).select(
        "row_id", F.col("id_text").alias("imageId"), "answer",
        F.concat(F.lit("Is the "), "word", F.lit(" near "), "st", F.lit("?")).alias("question"),
        F.concat(F.lit("Yes, the "), "word", F.lit(" is near it.")).alias("fullAnswer"),
        F.concat(F.lit("select: "), "word", F.lit(" (11)->relate: "), "word", F.lit(",on,s (11,22)->exist: x (-)")).alias("semanticStr"),
        F.struct(F.concat(F.lit("the <ph_st>"), "word", F.lit("<ph_ed> by <ph_st>"), "st", F.lit("<ph_ed> so "), "answer").alias("value"),
                 "boxes", seq("array(array(0),array(1))").alias("seq")).alias("cot"),
        F.struct(F.expr("map('0','11','2:4','22,33')").alias("question"), F.expr("map('1:3','33','4','11')").alias("fullAnswer")).alias("annotations"))
    scenes = records(spark, sf).select(
        F.col("id_text").alias("imageId"), F.create_map(F.lit("11"), o("a", 0), F.lit("22"), o("b", 0), F.lit("33"), o("a", shift)).alias("objects"))
    return questions.join(scenes, "imageId")


C = "concat_ws(',',ax1+1,ay1,ax2+1,ay2)"
EVEN = "row_id%2=0"
_SHORT = "'The answer is '||answer||'.'"
# Per answer form: text, boxes, sequence, boxes and sequence after a boxed question.
_FRESH = (f"{A}||';'||{B}||case when {EVEN} then '' else ';'||{C} end", f"case when {EVEN} then '0;1,0' else '0;1,2' end")
_BL = f"'the'||word||'is<boxes>near'||'it.<boxes>'||{_SHORT}"
GQA_ORACLE = {
    "a": (_SHORT, "''", "''", *_FRESH),
    "c": ("'the '||word||' by '||st||' so '||answer", "''", "''", *_FRESH),
    "bc": ("'the '||word||'<boxes> by '||st||'<boxes> so '||answer", f"{A}||';'||{B}", "'0;1'", *_FRESH),
    "s": (f"'select: '||word||'->relate: '||word||',on,s->exist: x. '||{_SHORT}", "''", "''", *_FRESH),
    "bs": (f"'select: '||word||'<boxes>->relate: '||word||',on,s<boxes>->exist: x. '||{_SHORT}", f"{A}||';'||{B}", "'0;0,1'", *_FRESH),
    "l": (f"'the'||word||'isnearit.'||{_SHORT}", "''", "''", *_FRESH),
    "bl": (_BL, f"case when {EVEN} then {A} else {C}||';'||{A} end", f"case when {EVEN} then '0;0' else '0;1' end",
           f"case when {EVEN} then {A}||';'||{B} else {C}||';'||{A}||';'||{B} end", f"case when {EVEN} then '0;1,0' else '1;2,0' end"),
}
_PLAIN_Q = "'Is the '||word||' near '||st||'?'"
_BOXED_Q = "'Is<boxes> the '||word||' near<boxes> '||st||'?'"
_BOXED = {"q": "false", "qb": "true", "qbp": f"{rank32(0, 'row_id', '=boxed')}<2147483648"}


def _gqa_sql(qform: str, aform: str) -> str:
    text, boxes, a_seq, more, q_seq = GQA_ORACLE[aform]
    on = _BOXED[qform]
    return flat_sql("records", "id_text||'.jpg'", ask(f"case when {on} then {_BOXED_Q} else {_PLAIN_Q} end"), text,
                    boxes=f"case when {on} then {more} else {boxes} end", q_boxes=f"case when {on} then {q_seq} else '' end", a_boxes=a_seq)


_GQA_IDS = {"a": "B7", "c": "B8", "bc": "B8", "s": "B9", "bs": "B10", "l": "B11", "bl": "B11"}
for _q in QUESTION_FORMS:
    for _a in ANSWER_FORMS:
        query(",".join([_GQA_IDS[_a], {"q": "B12", "qb": "B13", "qbp": "B14"}[_q]]), _gqa_sql(_q, _a), ["records"], name=f"gqa_{_q}_{_a}")(
            lambda spark, sf, v=f"{_q}-{_a}": flat_items(convert.gqa(_gqa(spark, sf), v, ASK)))


@query("B15", flat_sql("records", "'COCO_train2014_'||id_text||'.jpg'", "'<image> is it '||word||'?'", "answer"), ["records"])
def instruct(spark, sf):
    t = lambda who, v: F.struct(F.lit(who).alias("from"), v.alias("value"))
    df = records(spark, sf).select(
        "row_id", F.concat("id_text", F.lit(".jpg")).alias("image"),
        F.array(t("human", F.concat(F.lit("<image> is it "), "word", F.lit("?"))), t("gpt", F.col("answer"))).alias("conversations"))
    return flat_items(convert.instruct(df, add_coco_prefix=True))


_VQ = ask("'is it '||word||'?'")
_vq = lambda: F.concat(F.lit("is it "), "word", F.lit("?"))


@query("B16", flat_sql("records", JPG, _VQ, "'The answer is '||answer||' .'"), ["records"])
def pope(spark, sf):
    df = records(spark, sf).select("row_id", F.col("img_path").alias("image"), _vq().alias("text"), F.upper("answer").alias("label"))
    return flat_items(convert.pope(df, ASK))


@query("B16", flat_sql("records", JPG, _VQ, "''"), ["records"])
def pure_vqa(spark, sf):
    return flat_items(convert.pure_vqa(records(spark, sf).select("row_id", F.col("img_path").alias("image_path"), _vq().alias("question")), ASK))


def vqa_records(spark, sf):
    return records(spark, sf).select("row_id", F.col("img_path").alias("image_path"), _vq().alias("question"),
                                     F.struct(F.col("answer").alias("multiple_choice_answer")).alias("annotation"))


for _has in (True, False):
    query("B16", flat_sql("records", JPG, _VQ, "'The answer is '||answer||'.'" if _has else "'The answer is UNKNOWN.'"), ["records"],
          name="vqav2" if _has else "vqav2_unknown")(
        lambda spark, sf, has=_has: flat_items(convert.vqav2(vqa_records(spark, sf), ASK, has_annotation=has)))

_SO = "' So the answer is '||answer||'.'"
for _n, _e, _has, _text in [("vqa_e", True, True, f"'It is '||word||{_SO}"), ("vqa_x", False, True, f"'It is '||word||st||{_SO}"), ("vqa_ex_unknown", True, False, "'UNKNOWN'")]:
    query("B17", flat_sql("records", JPG, _VQ, _text), ["records"], name=_n)(
        lambda spark, sf, e=_e, has=_has: flat_items(convert.vqa_ex(records(spark, sf).select(
            "row_id", "file_path", _vq().alias("question"),
            F.array(F.concat(F.lit("It is "), "word"), F.col("st")).alias("explanation"), F.col("answer").alias("multiple_answers"),
            F.array(F.concat(F.lit("It is "), "word"), F.col("st")).alias("justification"), F.col("answer").alias("multiple_choice_answer"),
        ), e, ASK, has_annotation=has)))


# Commonsense questions: four choices each, sentences as mixed JSON.


def _vcr(spark, sf):
    choice = lambda kind, i: F.concat(F.lit(f'["{kind}{i}","'), "word", F.lit(f'",[{i % 2}],"."]'))
    return records(spark, sf).select(
        "row_id", F.col("img_path").alias("img_fn"),
        F.array(F.concat(box("a"), F.array(F.lit(0.9))), F.concat(box("b"), F.array(F.lit(0.8)))).alias("boxes"),
        F.concat(F.lit('["Why","is",[0],"near",[1,0],"'), "word", F.lit('","?"]')).alias("question"),
        F.array(*[choice("Choice", i) for i in range(4)]).alias("answer_choices"),
        F.array(*[choice("Reason", i) for i in range(4)]).alias("rationale_choices"),
        F.col("a_label").cast("int").alias("answer_label"), F.col("r_label").cast("int").alias("rationale_label"))


def _vcr_parts(a: str, r: str) -> dict[str, tuple[str, str]]:
    one = lambda kind, at: f"'{kind}'||({at})||' '||word||' <boxes> .'"
    every = lambda kind: "||' '||".join(f"'({c}) '||{one(kind, i)}" for i, c in enumerate("ABCD"))
    letter = lambda at: f"'The answer is ('||substr('ABCD',({at}+1)::int,1)||').'"
    return {
        "question": ("'Why is <boxes> near <boxes> '||word||' ?'", "'0;1,0'"),
        "answers": (every("Choice"), "'0;1;0;1'"), "rationales": (every("Reason"), "'0;1;0;1'"),
        "answer": (one("Choice", a), f"(({a})%2)::varchar"), "rationale": (one("Reason", r), f"(({r})%2)::varchar"),
        "answer_letter": (letter(a), "''"), "rationale_letter": (letter(r), "''"),
        "explain": ("'You should explain the reason for the above answer.'", "''"),
    }


# Written out per version: for each turn, the parts and fixed texts in order.
_CHOOSE = "'You should decide on the best choice and output the corresponding letter.'"
_REASON = "'You should decide on the best choice that explains the above answer and output the corresponding letter.'"
_Q, _OPT = ["'QUESTION:'", "@question"], ["'QUESTION:'", "@question", "chr(10)||'OPTIONS:'", "@answers", _CHOOSE]
VCR_TURNS = {
    "q-a": [_Q, ["@answer"]],
    "q-ra": [_Q, ["@rationale", "@answer"]],
    "qc-a": [_OPT, ["@answer_letter"]],
    "qc-ra": [_OPT, ["@rationale", "@answer_letter"]],
    "qc-rac": [_OPT, ["@rationale", "@answer", "@answer_letter"]],
    "qa-r": [["'QUESTION:'", "@question", "chr(10)||'ANSWER:'", "@answer", "'You should explain the reason for the above answer.'"], ["@rationale"]],
    "qac-r": [["'QUESTION:'", "@question", "chr(10)||'ANSWER:'", "@answer", "chr(10)||'RATIONALE OPTIONS:'", "@rationales", _REASON], ["@rationale_letter"]],
    "q-a-q-r": [_Q, ["@answer"], ["@explain"], ["@rationale"]],
    "qc-a-qc-r": [_OPT, ["@answer_letter"], ["'RATIONALE OPTIONS:'", "@rationales", _REASON], ["@rationale_letter"]],
}


def _vcr_sql(version: str, predict: bool = False) -> str:
    fan = predict and version in RATIONALE_VERSIONS
    parts = _vcr_parts("forced" if predict else "a_label", "0" if predict else "r_label")
    source = "(select * exclude (row_id), row_id*4+forced row_id from records, (values (0),(1),(2),(3)) v(forced))" if fan else (
        "(select *, 0 forced from records)" if predict else "records")
    rows = []
    for n, turn in enumerate(VCR_TURNS[version]):
        text = "||' '||".join(parts[p[1:]][0] if p[0] == "@" else p for p in turn)
        seqs = [parts[p[1:]][1] for p in turn if p[0] == "@"]
        seq_text = "concat_ws(';'," + ",".join(f"nullif({s},'')" for s in seqs) + ")"
        if n == 0:
            text = ask(text)
        if predict and n == len(VCR_TURNS[version]) - 1:
            text += "||'WARNING: answer and rationale here are just placeholders. we have no real anno.'"
        rows.append(f"select row_id, {JPG} image, {A}||';'||{B} boxes, {n} turn, '{'human' if n % 2 == 0 else 'gpt'}' speaker, {text} said, {seq_text} seq from {source} r")
    return " union all ".join(rows)


def _long_items(items):
    from checks.base import show_boxes, show_seq

    # Boxes are written once an item, below the explode.
    shown = items.select("row_id", "image", show_boxes(F.col("target.boxes")).alias("boxes"), "conversations")
    return shown.select("row_id", "image", "boxes", explode_items(F.col("conversations"), "turn", "t")).select(
        "row_id", "image", "boxes", "turn", F.col("t.from").alias("speaker"), F.col("t.value").alias("said"), show_seq(F.col("t.boxes_seq")).alias("seq"))


for _v in VERSIONS:
    query("B18,A1", _vcr_sql(_v), ["records"], name=f"vcr_{_v.replace('-', '_')}")(
        lambda spark, sf, v=_v: _long_items(convert.vcr(_vcr(spark, sf), v, ASK)))
for _v in PREDICTION_VERSIONS:
    query("B19", _vcr_sql(_v, True), ["records"], name=f"vcr_pred_{_v.replace('-', '_')}")(
        lambda spark, sf, v=_v: _long_items(convert.vcr_pred(_vcr(spark, sf), v, ASK)))


# Pointing.

_POINT = "'5,'||ay2"


def _pointed(spark, sf):
    return records(spark, sf).withColumn("point", F.array(F.lit(5.0), F.col("ay2").cast("double")))


def _point_sql(question: str, version: str) -> str:
    on = {"p": "true", "b": "false", "bp": f"{rank32(0, 'row_id', '=point')}<2147483648"}[version]
    return flat_sql("records", JPG, ask(f"{question}||case when {on} then '<points>' else '<boxes>' end"), "'The answer is '||answer||' .'",
                    boxes=A, points=_POINT, q_boxes=f"case when {on} then null else '0' end", q_points=f"case when {on} then '0' else null end")


for _v in ("b", "p", "bp"):
    query("B20", _point_sql("'is it '||word||'?'", _v), ["records"], name=f"point_qa_local_{_v}")(
        lambda spark, sf, v=_v: flat_items(convert.point_qa_local(_pointed(spark, sf).withColumn("question", _vq()), v, ASK)))
    for _k, _name in (("oq", "obj"), ("sq", "super"), ("gq", "general")):
        query("B21", _point_sql(f"'{_name} '||word||'?'", _v), ["records"], name=f"point_qa_twice_{_k}_{_v}")(
            lambda spark, sf, v=f"{_k}-{_v}": flat_items(convert.point_qa_twice(_pointed(spark, sf).withColumns(
                {f"{n}_question": F.concat(F.lit(f"{n} "), "word", F.lit("?")) for n in ("obj", "super", "general")}), v, ASK)))

_CANDIDATES = f"{A}||';'||{B}||';'||{C}"
_SHUFFLED = (f"(select string_agg(i::varchar,';' order by {order60(0, 'row_id', '=candidates', 'i')}) from (values (0),(1),(2)) v(i))")


def _candidates(spark, sf):
    c = F.transform(box("a"), lambda x, i: x + F.when(i % 2 == 0, 1).otherwise(0))
    return _pointed(spark, sf).select(
        "row_id", "file_path", _vq().alias("question"), F.array(box("a"), box("b"), c).alias("candidates"), "point",
        F.when(F.col("row_id") % 2 == 0, box("b")).otherwise(c).alias("answer"))


def _v7w_sql(version: str) -> str:
    kind = "point" if version == "p" else "box"
    q = ask(f"'is it '||word||'? Candidates: <boxes> <boxes> <boxes> answer in {kind} format.'")
    if version == "p":
        return flat_sql("records", JPG, q, "'The answer is <points> .'", boxes=_CANDIDATES, points=_POINT, q_boxes=_SHUFFLED, a_points="'0'")
    return flat_sql("records", JPG, q, "'The answer is <boxes> .'", boxes=_CANDIDATES, points="''", q_boxes=_SHUFFLED,
                    a_boxes=f"case when {EVEN} then '1' else '2' end")


for _v in ("p", "b"):
    query("B22", _v7w_sql(_v), ["records"], name=f"v7w_point_{_v}")(
        lambda spark, sf, v=_v: flat_items(convert.v7w_point(_candidates(spark, sf), v, ASK)))


@query("B23,D8,D9", flat_sql("records", JPG, f"replace({template_sql(FIND, 0, 'row_id')},'<expr>','the '||word)", "'Answer: <boxes> .'", boxes=A, a_boxes="'0'"), ["records"])
def rec(spark, sf):
    return flat_items(convert.rec(records(spark, sf), FIND))


@query("B24", flat_sql("records", JPG, f"replace({template_sql(NAME, 0, 'row_id')},'<objs>','<boxes>')", "'the '||word", boxes=A, q_boxes="'0'"), ["records"])
def reg(spark, sf):
    return flat_items(convert.reg(records(spark, sf), NAME))
