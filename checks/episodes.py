"""Few-shot episodes over the class records of `checks.classes`."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks.base import load, order60, query, rank32, show_boxes, show_seq, template_sql, word_sql
from checks.classes import CONTEXT, SAMPLES, SPLIT_SQL, TRAIN_SQL, class_vectors, train_records
from checks.convert import FIND, records
from lumenfold.functions.draws import cdf_thresholds
from lumenfold.operators import classes as cls
from lumenfold.operators import convert, episodes as ep
from lumenfold.plans import fewshot

QUERIES_TEXT = ["What is in <image>?", "Name the object of <image>.", "Based on the examples, what is in <image>?"]
NB = 5
KEY = (0, 0, "class_id")

# One neighbour per episode with weights 5,4,3,2,1, and the images of its class record.
DRAWN_SQL = TRAIN_SQL + f""",
dr as (select t.*, {rank32(*KEY, '=neighbour')}%15 r from train t),
di as (select *, case when r<5 then 1 when r<9 then 2 when r<12 then 3 when r<14 then 4 else 5 end ni from dr),
nbd as (select d.*, d.ids[d.ni] nb_id, d.imgs[d.ni] nb_img, 'class '||d.ids[d.ni] nb_name, t.samples nb_samples from di d join train t on t.class_id=d.ids[d.ni])"""


def _sample(array: str, *key) -> str:
    return f"({array})[({rank32(*KEY, *key)}%{SAMPLES}+1)::INT]"


def _there(label: str, end: str = " [END EXAMPLE]") -> str:
    return f"'there is \"'||{label}||'\" in the image.{end}'"


WORD = word_sql(1, 10, *KEY)
OWN_SIDE = f"{rank32(*KEY, '=side')}%2=0"


def _support_sql(shot: str, answer_own: str, answer_nb: str, question: str) -> str:
    """Long rows of support items with their position: own slots come first in the order key."""
    return f"""
sl as (select *, unnest(range(0,({shot})::BIGINT)) s from nbd),
su as (select class_id, s i, {_sample('samples', '=own', 's')} image, {answer_own} answer, 0 side from sl union all
       select class_id, s+({shot}), case when s=0 then nb_img else {_sample('nb_samples', '=nb', 's')} end, {answer_nb}, 1 from sl),
so as (select *, row_number() over (partition by class_id order by {order60(*KEY, '=order', 'i')}, i)-1 pos from su),
al as (select class_id, pos, image, '{question}' question, answer, case when pos=0 then 'causal_v1.0' else 'hypnotized_ans_v1.0' end as "mode" from so"""


def _query_row(shot: str, question: str, answer: str) -> str:
    return f""" union all select class_id, 2*({shot}), case when {OWN_SIDE} then {_sample('samples', '=own', '=query')} else {_sample('nb_samples', '=nb', '=query')} end,
       {question}, {answer}, 'final_v1.0' from nbd)"""


_SHOWN = "[BEGIN EXAMPLE] What is in the image <image>?"


def _weight_sql(shot: str) -> str:
    return DRAWN_SQL + "," + _support_sql(shot, _there(WORD), _there("nb_name"), _SHOWN) + _query_row(
        shot, template_sql(QUERIES_TEXT, *KEY), f"case when {OWN_SIDE} then {_there(WORD, '')} else {_there('nb_name', '')} end")


_ALL = ' select class_id, pos::integer pos, image, question, answer, "mode" from al'


def _long(df):
    return ep.explode_items(df).select("class_id", "pos", "image", "question", "answer", "mode")


@query("C2", f"with {DRAWN_SQL} select class_id, nb_id::varchar id, nb_name as \"name\", nb_img img, array_to_string(nb_samples,',') pool from nbd", ["vectors"])
def neighbour_draw(spark, sf):
    return ep.with_neighbour(train_records(spark, sf)).select("class_id", "nb.*", F.array_join("nb_samples", ",").alias("pool"))


@query("C3", f"""with {TRAIN_SQL}, s as (select *, unnest(range(0,6)) s from train)
select class_id, s::integer pos, {_sample('samples', '=own', 's')} image, 'class '||ids[({rank32(*KEY, '=label')}%{NB}+1)::INT] as "label" from s""", ["vectors"])
def negative_draws(spark, sf):
    return ep.negative_draws(train_records(spark, sf), 6)


@query("C4", f"with {_weight_sql('3')}{_ALL}", ["vectors"])
def two_way_weight(spark, sf):
    return _long(ep.two_way_weight(train_records(spark, sf), QUERIES_TEXT, 3))


_CUTS = cdf_thresholds([math.exp(i / 2) for i in range(1, 5)])
_SHOT = "1+" + "+".join(f"(({rank32(*KEY, '=shot')})>={c})::INT" for c in _CUTS)


@query("C5", f"with {_weight_sql(_SHOT)}{_ALL}", ["vectors"])
def two_way_random_shot(spark, sf):
    return _long(ep.two_way_random_shot(train_records(spark, sf), QUERIES_TEXT, 4))


_NAMED = "[BEGIN EXAMPLE] Tell me something about this image <image>."
_SAME = "'Which images in the previous example are in the same category as this image <image>? (Provide the answer in order as list)'"
_REF = f"(3+{rank32(*KEY, '=refshot')}%3)"
_named = lambda side: f"{word_sql(1, 10, *KEY, '=name', side, 's')}||'_'||{WORD}"


def _ref_sql(flip: bool) -> str:
    want = f"case when {OWN_SIDE} then {1 if flip else 0} else {0 if flip else 1} end"
    base = DRAWN_SQL + "," + _support_sql(_REF, _named(0), _named(1), _NAMED).replace(
        "answer, case when pos=0", "'The reference name of this image is \"'||answer||'\". [END EXAMPLE]' answer, case when pos=0")
    base = base.replace("al as (select", f"nm as (select class_id, string_agg(case when side={want} then ''''||answer||'''' end, ', ' order by pos) names from so group by class_id),\nal as (select")
    row = _query_row(_REF, _SAME, f"'['||(select names from nm where nm.class_id=nbd.class_id)||']._'||{WORD}")
    return base + row


@query("C6", f"with {_ref_sql(False)}{_ALL}", ["vectors"])
def two_way_ref(spark, sf):
    return _long(ep.two_way_ref(train_records(spark, sf), 5))


@query("C6", f"with {_ref_sql(True)}{_ALL}", ["vectors"])
def two_way_ref_legacy(spark, sf):
    return _long(ep.two_way_ref(train_records(spark, sf), 5, legacy=True))


_KIND_BIT = f"{rank32(*KEY, '=kind')}%2"


@query("C7", f"""select * from (with {_weight_sql('5')}{_ALL}) w where {_KIND_BIT}=1 union all
select * from (with {_ref_sql(False)}{_ALL}) r where {_KIND_BIT}=0""", ["vectors"])
def two_way_ref_or_weight(spark, sf):
    return _long(ep.two_way_ref_or_weight(train_records(spark, sf), QUERIES_TEXT, 5))


# Puzzle plans over the images of the orders.


def _images(spark, sf):
    return load(spark, sf, "images").select(F.col("image_id").alias("class_id"), F.concat(F.lit("img_"), "image_id").alias("image"), "width", "height")


_TK = (0, 0, "image_id", "'img_'||image_id")
_GRID = "[[[2,2]],[[2,3],[3,2]],[[3,3]],[[3,4],[4,3]],[[4,4]]]"
_PLAN = f"""
g as (select *, ({_GRID})[({rank32(*_TK, '=tiles')}%5+1)::INT] opts from images),
h as (select *, opts[({rank32(*_TK, '=grid')}%len(opts)+1)::INT] grid from g),
t as (select image_id, width, height, grid[1] c, grid[2] r, unnest(range(0,(grid[1]*grid[2])::BIGINT)) i from h),
q as (select *, i//r tc, i%r tr, width//c tw, height//r th from t),
o as (select *, row_number() over (partition by image_id order by {order60(*_TK, '=shown', 'i')}, i)-1 pos from q)"""


@query("C8", f"with {_PLAN} select image_id class_id, pos::integer pos, tc::integer col, tr::integer as \"row\", (tc*tw)::integer x1, (tr*th)::integer y1, ((tc+1)*tw)::integer x2, ((tr+1)*th)::integer y2 from o", ["images"])
def tile_plan(spark, sf):
    df = ep.tile_plan(_images(spark, sf)).select("class_id", F.posexplode_outer("tiles").alias("pos", "t"))
    return df.select("class_id", "pos", "t.*")


_PIECE = "[BEGIN EXAMPLE] This image <image> is a puzzle piece."
_PUZZLE = ("Using the puzzle pieces provided above to piece together this image <image>, "
           "and provide the coordinates of each piece on the image coordinate system in order.")


@query("C8", f"""with {_PLAN} select image_id class_id, pos::integer pos, 'img_'||image_id||'#'||(tc*tw)||','||(tr*th)||','||((tc+1)*tw)||','||((tr+1)*th) image,
       '{_PIECE}' question, '[END EXAMPLE]' answer, case when pos=0 then 'causal_v1.0' else 'hypnotized_ans_v1.0' end as "mode" from o union all
select image_id, count(*)::integer, 'img_'||image_id, '{_PUZZLE}', 'The order is: ['||string_agg('['||tc||', '||tr||']', ', ' order by pos)||'].', 'final_v1.0'
       from o group by image_id""", ["images"])
def jigsaw(spark, sf):
    return _long(ep.jigsaw(_images(spark, sf)))


# Evaluation episodes: classes in line order, context and test images in hash order.


def _split(spark, sf):
    split = cls.context_split(load(spark, sf, "class_images"), CONTEXT)
    lists = cls.context_lists(split, CONTEXT).withColumn("row_id", F.col("class_id").cast("bigint"))
    return split.where("split = 'test'"), lists


@query("C9", f"with {SPLIT_SQL} select class_id, k-{CONTEXT} pos, image from sp where k>={CONTEXT} and k<{CONTEXT}+7", ["class_images"])
def eval_index(spark, sf):
    return ep.eval_index(_split(spark, sf)[0], 7)


_CTX = f"cx as (select class_id, lower(replace(any_value(class_name),'_',' ')) cname, lower(any_value(class_name)) lname, array_agg(image order by k) ctx from sp where k<{CONTEXT} group by class_id)"


@query("C10", f"with {SPLIT_SQL}, {_CTX} select sp.class_id, k-{CONTEXT} pos, image, lname as \"label\", array_to_string(ctx[1:3],',') context from sp join cx using (class_id) where k>={CONTEXT}",
       ["class_images"])
def eval_single(spark, sf):
    test, lists = _split(spark, sf)
    return ep.eval_single(ep.eval_index(test), lists, 3).select("class_id", "pos", "image", "label", F.array_join("context", ",").alias("context"))


_TWO = f"""
ix as (select sp.class_id, k-{CONTEXT} pos, image, a.lname own, b.lname other, a.ctx actx, b.ctx bctx from sp join cx a on a.class_id=sp.class_id
       join cx b on b.class_id=xor(sp.class_id,1) where k>={CONTEXT}),
s as (select *, unnest([0,1,2,3]) i from ix),
e as (select class_id, pos, i, case when i<2 then actx[i+1] else bctx[i-1] end img, case when i<2 then own else other end nm from s),
f as (select *, row_number() over (partition by class_id, pos order by {order60(0, 'class_id', 'pos', '=order', 'i')}, i)-1 slot from e)"""


@query("C11", f"""with {SPLIT_SQL}, {_CTX}, {_TWO}
select class_id, pos, slot::integer slot, img image, {_there('nm')} answer, case when slot=0 then 'causal_v1.0' else 'hypnotized_ans_v1.0' end as "mode" from f union all
select class_id, pos, 4, image, {_there('own', '')}, 'final_v1.0' from ix""", ["class_images"])
def eval_two_way(spark, sf):
    test, lists = _split(spark, sf)
    df = ep.eval_two_way(ep.eval_index(test), lists, 2)
    return df.select("class_id", "pos", F.posexplode_outer("items").alias("slot", "i")).select("class_id", "pos", "slot", "i.image", "i.answer", "i.mode")


@query("C12", f"""
with s as (select *, unnest([0,1,2,3]) i from records),
f as (select *, row_number() over (partition by row_id order by {order60(0, 'row_id', '=order', 'i')}, i)-1 slot from s)
select row_id, slot::integer slot, case when i<2 then 'p' else 'n' end||i%2||'_'||row_id image, {_there("case when i<2 then word else st end")} answer,
       case when slot=0 then 'causal_v1.0' else 'hypnotized_ans_v1.0' end as "mode" from f union all
select row_id, 4, 'q_'||row_id, {_there('answer', '')}, 'final_v1.0' from records""", ["records"])
def pair_two_way(spark, sf):
    img = lambda p: F.concat(F.lit(p + "_"), "id_text")
    df = records(spark, sf).select(
        "row_id", img("q").alias("image_name"), F.array(img("p0"), img("p1"), img("p2")).alias("positive_list"), F.array(img("n0"), img("n1")).alias("negative_list"),
        F.col("word").alias("positive_promt"), F.col("st").alias("negative_promt"), F.col("answer").alias("label_name"))
    out = ep.pair_two_way(df, 2)
    return out.select("row_id", F.posexplode_outer("items").alias("slot", "i")).select("row_id", "slot", "i.image", "i.answer", "i.mode")


@query("C19", f"""select row_id, n::integer slot, 'img_'||id_text||'.jpg' image, ax1||','||ay1||','||ax2||','||ay2 boxes,
       'human: '||replace({template_sql(FIND, 0, 'row_id')},'<expr>','the '||word)||'|gpt: Answer: <boxes> .' said, '0' a_boxes from records, range(4) t(n)""", ["records"])
def repeat_item(spark, sf):
    df = ep.repeat_item(convert.rec(records(spark, sf), FIND), 2)
    turns = F.transform("i.conversations", lambda t: F.concat(t["from"], F.lit(": "), t["value"]))
    return df.select("row_id", F.posexplode_outer("items").alias("slot", "i")).select(
        "row_id", "slot", "i.image", show_boxes(F.col("i.target.boxes")).alias("boxes"), F.array_join(turns, "|").alias("said"),
        show_seq(F.col("i.conversations")[1]["boxes_seq"]).alias("a_boxes"))


@query("C20", """
with s as (select *, unnest([0,1,2,3]) slot from records)
select row_id session, slot, case slot when 0 then 'a' when 1 then 'b' when 2 then 'c' else 'd' end||row_id image,
       case when slot=3 then 'what is '||word||'?<image>' else '[BEGIN EXAMPLE] What is in the image <image>?' end question,
       case slot when 3 then '' when 2 then st||' [END EXAMPLE]' else word||' [END EXAMPLE]' end answer,
       case slot when 0 then 'causal_v1.0' when 3 then 'final_v1.0' else 'hypnotized_ans_v1.0' end as "mode" from s""", ["records"])
def ad_hoc(spark, sf):
    img = lambda p: F.concat(F.lit(p), "id_text")
    df = records(spark, sf).select(
        F.col("row_id").alias("session"), F.array(img("a"), img("b")).alias("pos_images"), F.col("word").alias("pos_answer"),
        F.array(img("c")).alias("neg_images"), F.col("st").alias("neg_answer"), img("d").alias("image"), F.concat(F.lit("what is "), "word", F.lit("?")).alias("question"))
    return ep.explode_items(ep.ad_hoc(df)).select("session", F.col("pos").alias("slot"), "image", "question", "answer", "mode")


_CAUSAL = "You should find the causal relationship between the examples I am going to show you. And use that to answer to the [FINAL QUESTION]. "


@query("C4,F3,G5,G6,G7", f"""with {_weight_sql('2')}
select class_id, string_agg(case when pos=0 then '{_CAUSAL}' when pos=4 then '[FINAL QUESTION]:  ' else ' ' end||'USER: '||question||' ASSISTANT: '||answer||
       case when pos in (0,4) then '</s>' else '' end, '' order by pos) prompt from al group by class_id""", ["vectors"])
def episode_prompts(spark, sf):
    """The flagship: class vectors, similarity, neighbours, records, episodes, prompts."""
    images = load(spark, sf, "class_images").select("class_id", "class_name", "image")
    df = fewshot.episode_prompts(class_vectors(spark, sf), images, QUERIES_TEXT, shot=2, bins=NB, samples=SAMPLES)
    return df.select("class_id", "prompt")
