"""Class sets from the embeddings: labels are classes, `vec_id % 2` is the modality of a vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import load, order60, query, rank32, table
from lumenfold.operators import classes as cls
from lumenfold.plans import fewshot

BINS, SAMPLES = 5, 8


def vectors(spark, sf):
    """Every vector; those of a twentieth, as of unreadable images, are null."""
    return load(spark, sf, "vectors").withColumn("embedding", F.expr("case when vec_id % 20 <> 19 then embedding end"))


def class_vectors(spark, sf):
    """Mean vectors of at most 15 images per class and modality; unreadable ones are drawn too, and then skipped."""
    df = vectors(spark, sf)
    return fewshot.class_vectors(df.where("modality = 0"), df.where("modality = 1"), 15)


# DuckDB side of the class vectors, the blended scores and their ranking.
VECTORS_SQL = f"""
h as (select class_id, modality, case when vec_id%20<>19 then embedding end embedding,
             row_number() over (partition by class_id, modality order by {order60(0, 'class_id', 'image')}, image) r from vectors),
d as (select class_id, modality, unnest(embedding)::double x, generate_subscripts(embedding,1) dim from h where r<=15),
e as (select class_id, modality, dim, avg(x) x from d group by class_id, modality, dim),
u as (select *, x/sqrt(sum(x*x) over (partition by class_id, modality)) nx from e)"""
SCORES_SQL = VECTORS_SQL + """,
m as (select a.class_id a, b.class_id b, round(sum(case when a.modality=1 and b.modality=1 then 0.5 when a.modality=0 and b.modality=0 then 0.5 else 0.8 end*a.nx*b.nx),6) score
      from u a join u b on a.dim=b.dim group by a.class_id, b.class_id)"""
RANKED_SQL = SCORES_SQL + ", rk as (select a class_id, row_number() over (partition by a order by score desc, b)-1 rank, b neighbor_id, score from m)"


@query("G5", f"with {VECTORS_SQL} select class_id, modality, dim-1 dim, round(x,9) x from e", ["vectors"])
def class_embedding(spark, sf):
    df = vectors(spark, sf)
    out = None
    for m in (0, 1):
        one = cls.class_embedding(df.where(F.col("modality") == m), 15).select(
            "class_id", F.lit(m).cast("bigint").alias("modality"), F.posexplode("embedding").alias("dim", "x"))
        out = one if out is None else out.union(one)
    return out.select("class_id", "modality", F.col("dim").cast("bigint").alias("dim"), F.round("x", 9).alias("x"))


@query("G6", f"with {SCORES_SQL} select a, b, score from m", ["vectors"])
def similarity(spark, sf):
    return cls.similarity(class_vectors(spark, sf), blocks=3)


def ranked(spark, sf):
    return cls.rank_neighbours(cls.similarity(class_vectors(spark, sf), blocks=1))


@query("G7,A10", f"with {RANKED_SQL} select class_id, rank::integer rank, neighbor_id, score from rk", ["vectors"])
def rank_neighbours(spark, sf):
    return ranked(spark, sf)


@query("G1,A9", """
select class_id::varchar class_id, 'class '||class_id class_name, part, line_no, image from (
  select vec_id%10 k, label class_id, 0 part, vec_id line_no, 'train/n'||label||'/v'||vec_id||'.JPEG' image from embeddings where vec_id%5<>0 union all
  select vec_id%10, label, 1, vec_id, 'val/v'||vec_id||'.JPEG' from embeddings where vec_id%5=0 and vec_id%25<>0) t""")
def class_images(spark, sf):
    df = table(spark, sf, "embeddings")
    folders = df.groupBy("label").agg(F.min("vec_id").alias("line_no")).select(
        "line_no", F.concat(F.lit("n"), "label").alias("folder"), F.col("label").cast("string").alias("class_id"),
        F.concat(F.lit("class "), "label").alias("class_name"))
    folder = F.concat(F.lit("n"), "label")
    train = df.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("line_no"), folder.alias("folder"), F.concat(folder, F.lit("/v"), "vec_id").alias("path"))
    val = df.where("vec_id % 5 = 0").select(
        F.col("vec_id").alias("line_no"), F.concat(F.lit("v"), "vec_id").alias("path"), F.col("label").cast("string").alias("class_id"))
    blocked = df.where("vec_id % 25 = 0").select(F.col("vec_id").alias("line_no"))
    return cls.class_images(folders, train, val, blocked=blocked)


@query("G2", f"""
with c as (select class_id, row_number() over (order by {order60(0, 'class_id', '=split')}) r from (select distinct class_id from class_images))
select vec_id, case when r<=3 then 'test' else 'train' end split from class_images join c using (class_id)""", ["class_images"])
def split_classes(spark, sf):
    return cls.split_classes(load(spark, sf, "class_images"), 3).select("vec_id", "split")


# Train records: 5 similarity bins with one drawn rank each, 8 own samples.
TRAIN_SQL = RANKED_SQL + f""",
size as (select count(distinct class_id) c, (count(distinct class_id)+{BINS}-1)//{BINS} w from rk),
bins as (select class_id, bin, greatest(1,bin*w) low, least((bin+1)*w,c)-greatest(1,bin*w) n from (select distinct class_id from rk), size, range({BINS}) t(bin)),
nb as (select b.class_id, bin, neighbor_id from bins b join rk on rk.class_id=b.class_id and rank=low+{rank32(0, 'b.class_id', 'bin', '=bin')}%n),
pool as (select class_id, image, row_number() over (partition by class_id order by {order60(0, 'class_id', 'image', '=pool')}, image)-1 k,
         count(*) over (partition by class_id) n from vectors),
own as (select class_id, image, row_number() over (partition by class_id order by {order60(0, 'class_id', 'image', '=own')}, image)-1 k from vectors),
nbi as (select nb.class_id, bin, neighbor_id, image from nb join pool p on p.class_id=neighbor_id and p.k={rank32(0, 'nb.class_id', 'bin', 'neighbor_id', '=img')}%p.n),
train as (select s.class_id, 'class '||s.class_id class_name, samples, ids, imgs from
  (select class_id, array_agg(image order by k) samples from own where k<{SAMPLES} group by class_id) s join
  (select class_id, array_agg(neighbor_id order by bin) ids, array_agg(image order by bin) imgs from nbi group by class_id) n on n.class_id=s.class_id)"""


def train_records(spark, sf):
    images = load(spark, sf, "class_images").select("class_id", "class_name", "image")
    return fewshot.train_records(class_vectors(spark, sf), images, BINS, SAMPLES)


@query("G3", f"""with {TRAIN_SQL} select class_id, class_name, array_to_string(samples,',') samples, array_to_string(ids,',') ids,
       array_to_string(list_transform(ids, lambda i: 'class '||i),',') as "names", array_to_string(imgs,',') imgs from train""", ["vectors"])
def train_pairs(spark, sf):
    show = lambda f: F.array_join(F.transform("neighbors", lambda n: n[f]), ",")
    return train_records(spark, sf).select("class_id", "class_name", F.array_join("samples", ",").alias("samples"),
                                           show("id").alias("ids"), show("name").alias("names"), show("img").alias("imgs"))


SPLIT_SQL = f"""
sp as (select class_id, class_name, image, row_number() over (partition by class_id order by {order60(0, 'class_id', 'image', '=context')}, image)-1 k from class_images)"""
CONTEXT = 16


@query("G4", f"with {SPLIT_SQL} select class_id, image, case when k<{CONTEXT} then 'context' else 'test' end split, case when k<{CONTEXT} then k else k-{CONTEXT} end pos from sp",
       ["class_images"])
def context_split(spark, sf):
    return cls.context_split(load(spark, sf, "class_images"), CONTEXT).select("class_id", "image", "split", "pos")


@query("C1", """select p_name class_id, min(p_partkey) row_id, count(*)>1 repeated from part group by p_name""")
def first_per_class(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_name").alias("class_id"), F.col("p_partkey").alias("row_id"))
    twice = cls.duplicate_classes(df).select("class_id", F.lit(True).alias("_d"))
    return cls.first_per_class(df).join(twice, "class_id", "left").select("class_id", "row_id", F.coalesce("_d", F.lit(False)).alias("repeated"))
