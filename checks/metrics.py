"""Scoring over derived predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import load, query, table
from lumenfold.functions import coords, geometry
from lumenfold.functions.text import extract_answer, extract_sentence_answer
from lumenfold.operators import metrics

_FLAGS = "count(*) n, sum((ok)::int)::bigint n_correct, sum((ok)::int)/count(*) accuracy, sum((bad)::int)::bigint failed, 0::bigint target_failed"


def _split(spark, sf):
    df = load(spark, sf, "predictions")
    return df.select("row_id", "pred"), df.select("row_id", "target", "test_set")


@query("H1,H2", f"""select test_set, {_FLAGS} from (select *, row_id%10=0 bad, row_id%10<>0 and row_id%5<>1 ok from predictions)
       group by test_set""", ["predictions"])
def match_accuracy(spark, sf):
    preds, targets = _split(spark, sf)
    return metrics.report(metrics.score_match(metrics.align(preds, targets), extract_answer), ["test_set"])


@query("H3", f"select {_FLAGS} from (select *, row_id%5<>1 or row_id%10=0 bad, false ok from predictions)", ["predictions"])
def sentence_accuracy(spark, sf):
    """The stricter extractor does not read `So the answer is`."""
    preds, targets = _split(spark, sf)
    return metrics.report(metrics.score_match(metrics.align(preds, targets), extract_sentence_answer))


def _boxes(spark, sf):
    df = load(spark, sf, "box_predictions")
    t = F.array(*[F.col(c).cast("double") for c in ("tx1", "ty1", "tx2", "ty2")])
    p = F.array(*[(F.col(c) + F.col(d)).cast("double") for c, d in (("tx1", "dx"), ("ty1", "dy"), ("tx2", "dx"), ("ty2", "dy"))])
    size = F.lit(700)
    shown = lambda b: F.concat(F.lit("Answer: "), coords.format_plain(F.array(geometry.norm_box(b, size, size))), F.lit(" ."))
    return df.select("row_id", F.when(F.col("miss") == 7, F.lit("none")).otherwise(shown(p)).alias("pred"),
                     F.when(F.col("miss") == 9, F.lit("?")).otherwise(shown(t)).alias("target"))


_n = lambda e: f"printf('%.3f',({e})/700)::double*1000"
_IOU = f"""
t as (select row_id, miss, {_n('tx1')} a1, {_n('ty1')} a2, {_n('tx2')} a3, {_n('ty2')} a4, {_n('tx1+dx')} b1, {_n('ty1+dy')} b2, {_n('tx2+dx')} b3, {_n('ty2+dy')} b4 from box_predictions),
i as (select *, greatest(least(a3,b3)-greatest(a1,b1),0)*greatest(least(a4,b4)-greatest(a2,b2),0) x from t),
u as (select row_id, miss, case when miss=9 then null when miss=7 then 0.0 else x/((a3-a1)*(a4-a2)+(b3-b1)*(b4-b2)-x) end iou from i)"""


@query("H4,H5", f"""with {_IOU}
select count(*) n, count(*) filter (iou>0.5) n_correct, count(*) filter (iou>0.5)/count(*) accuracy, count(*) filter (miss=7) failed,
       count(*) filter (miss=9) target_failed, round(avg(iou),9) iou from u""", ["box_predictions"])
def iou_accuracy(spark, sf):
    return metrics.report(metrics.score_iou(_boxes(spark, sf))).withColumn("iou", F.round("iou", 9))


@query("H5", f"with {_IOU} select row_id, round(iou,9) iou, coalesce(iou>0.5,false) correct, miss=7 failed, miss=9 target_failed from u", ["box_predictions"])
def iou_rows(spark, sf):
    return metrics.score_iou(_boxes(spark, sf)).select("row_id", F.round("iou", 9).alias("iou"), "correct", "failed", "target_failed")


def _classes(spark, sf):
    """Part names as classes by line; names repeat, so the last line of a name decides its partner."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.upper("p_name").alias("class_name"))


_PAIRS = """pairs as (select a.p_name as "name", arg_max(b.p_name, a.p_partkey) negative from part a join part b on b.p_partkey=xor(a.p_partkey,1) group by a.p_name)"""


@query("H7", f'with {_PAIRS} select "name", negative from pairs')
def paired_names(spark, sf):
    return metrics.paired_names(_classes(spark, sf))


_SAID = "(select p_partkey row_id, p_name pos, p_partkey%4 kind from part)"


@query("H6,H7", f"""with {_PAIRS}, p as (select r.*, negative from {_SAID} r join pairs on "name"=pos)
select row_id, negative, case kind when 0 then true when 1 then not contains(replace(pos||' or '||negative,pos,''),negative) when 2 then false
       else not contains(replace('it is '||pos||'s',pos,''),negative) end correct from p""")
def containment_rows(spark, sf):
    df = table(spark, sf, "part")
    classes = _classes(spark, sf)
    pairs = metrics.paired_names(classes)
    kind = F.col("p_partkey") % 4
    rows = df.join(pairs, df["p_name"] == pairs["name"]).select(
        F.col("p_partkey").alias("row_id"),
        F.concat(F.lit('USER: q ASSISTANT: there is "'), F.initcap("p_name"), F.lit('" in the image.</s>')).alias("target"),
        F.when(kind == 0, F.concat(F.lit("there is "), "p_name")).when(kind == 1, F.concat("p_name", F.lit(" or "), "negative"))
        .when(kind == 2, F.upper("p_name")).otherwise(F.concat(F.lit("it is "), "p_name", F.lit("s"))).alias("pred"))
    return metrics.score_containment(metrics.with_paired_negative(rows, classes)).select("row_id", "negative", "correct")


@query("H7", """select row_id, case when st='o' then 'a '||word else 'not '||word end negative,
       case when st='o' then true else false end correct from records""", ["records"])
def own_pair_rows(spark, sf):
    """The target is the first name of the pair, or (rows not in state o) the second with the first predicted beside it."""
    df = load(spark, sf, "records")
    first, second = F.concat(F.lit("not "), "word"), F.concat(F.lit("a "), "word")
    pairs = df.select("row_id", F.upper(first).alias("positive_promt"), F.initcap(second).alias("negative_promt"))
    is_o = F.col("st") == "o"
    said = df.select("row_id", F.when(is_o, first).otherwise(second).alias("target"),
                     F.when(is_o, first).otherwise(F.concat(second, F.lit(" "), first)).alias("pred"))
    return metrics.score_containment(metrics.with_own_negative(said, pairs)).select("row_id", "negative", "correct")


@query("H8,D10", """
select 'multitest_'||test_set test_set, count(*) n, sum((row_id%10<>0 and row_id%5<>1)::int)::bigint n_correct,
       sum((row_id%10<>0 and row_id%5<>1)::int)/count(*) accuracy, sum((row_id%10=0)::int)::bigint failed, 0::bigint target_failed
from predictions where test_set<>'set_c' group by test_set union all
select 'multitest_strict', count(*), 0, 0.0, sum((row_id%5<>1 or row_id%10=0)::int)::bigint, 0 from predictions where test_set='set_c'""", ["predictions"])
def multi_test_report(spark, sf):
    df = load(spark, sf, "predictions")
    loose = lambda d: metrics.score_match(d, extract_answer)
    strict = lambda d: metrics.score_match(d, extract_sentence_answer)
    return metrics.multi_report({
        "set_a": (df.where("test_set='set_a'"), loose), "set_b": (df.where("test_set='set_b'"), loose),
        "strict": (df.where("test_set='set_c'"), strict)})
