"""Mixtures of slices of conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import ORACLES, order60, query, rank32, show_boxes, show_seq, table
from checks.classes import train_records
from checks.convert import ASK, FIND, NAME, records, vqa_records
from checks.episodes import QUERIES_TEXT
from lumenfold.operators import convert, mixing
from lumenfold.operators import episodes as ep
from lumenfold.operators.ranking import block_range, number_rows, with_rank
from lumenfold.plans import corpora

_SRC = """
a as (select row_number() over (order by conv_id, turn)-1 row_id, 'conv'||conv_id||'.'||turn tag from conversations),
b as (select doc_id row_id, 'doc'||doc_id tag from documents),
c as (select event_id row_id, 'event'||event_id tag from events)"""
SIZES = "(select count(*) from a) na, (select count(*) from b) nb, (select count(*) from c) nc"


def sources(spark, sf):
    """Three sets with dense row ids; the first is numbered in (conversation, turn) order by counts per conversation."""
    conv = table(spark, sf, "conversations")
    a = with_rank(conv, [], ["conv_id", "turn"], block_range(F.col("conv_id"), 64), out="row_id").select(
        "row_id", F.concat(F.lit("conv"), "conv_id", F.lit("."), "turn").alias("tag"))
    b = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.concat(F.lit("doc"), "doc_id").alias("tag"))
    c = table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.concat(F.lit("event"), "event_id").alias("tag"))
    return [a, b, c]


def _out(df):
    return df.select("mix_id", "source", "row_id", "tag")


@query("D1", f"""with {_SRC}, n as (select {SIZES})
select row_id mix_id, 0::integer source, row_id, tag from a union all select row_id+na, 1, row_id, tag from b, n union all select row_id+na+nb, 2, row_id, tag from c, n""")
def concat(spark, sf):
    return _out(mixing.concat(sources(spark, sf)))


@query("D2", f"""with {_SRC}, n as (select least(na,nb,nc) m from (select {SIZES}))
select row_id*3 mix_id, 0::integer source, row_id, tag from a, n where row_id<m union all select row_id*3+1, 1, row_id, tag from b, n where row_id<m union all
select row_id*3+2, 2, row_id, tag from c, n where row_id<m""")
def interleave_first(spark, sf):
    return _out(mixing.interleave(sources(spark, sf)))


@query("D3", f"""with {_SRC}, n as (select *, greatest(na,nb,nc) m from (select {SIZES})), r as (select unnest(range(0,m)) r, na, nb, nc from n)
select r*3 mix_id, 0::integer source, row_id, tag from r join a on row_id=r%na union all select r*3+1, 1, row_id, tag from r join b on row_id=r%nb union all
select r*3+2, 2, row_id, tag from r join c on row_id=r%nc""")
def interleave_all(spark, sf):
    return _out(mixing.interleave(sources(spark, sf), mixing.ALL))


P = [0.5, 0.3, 0.2]
_T1, _T2 = 2147483648, 3435973836  # 0.5 and 0.8 of 2**32


def _chance_sql(rule: str) -> str:
    return f"""with {_SRC}, n as (select {SIZES}),
dr as (select i mix_id, {rank32(7, 'i', '=source')} u from (select unnest(range(0,20*(na+nb+nc))) i from n)),
ds as (select mix_id, (u>={_T1})::int+(u>={_T2})::int source from dr),
dk as (select *, row_number() over (partition by source order by mix_id)-1 k, case source when 0 then na when 1 then nb else nc end sz from ds, n),
st as (select {rule}(mix_id) stop from dk where k=sz-1),
pl as (select mix_id, source::integer source, k%sz row_id from dk, st where mix_id<=stop),
al as (select 0 source, * from a union all select 1, * from b union all select 2, * from c)
select mix_id, source, row_id, tag from pl join al using (source, row_id)"""


@query("D4", _chance_sql("min"))
def interleave_chance_first(spark, sf):
    return _out(mixing.interleave_by_chance(sources(spark, sf), P, 7))


@query("D5", _chance_sql("max"))
def interleave_chance_all(spark, sf):
    return _out(mixing.interleave_by_chance(sources(spark, sf), P, 7, mixing.ALL))


@query("D6", f"""select event_id row_id from (select event_id, row_number() over (order by {order60(42, 'event_id')}) r, count(*) over () n from events) where r<=floor(n*0.37)""")
def subset_shuffled(spark, sf):
    return mixing.subset(table(spark, sf, "events").select(F.col("event_id").alias("row_id")), 0.37)


@query("D6", "select event_id row_id from events where event_id<floor((select count(*) from events)*0.05)")
def subset_first(spark, sf):
    return mixing.subset(table(spark, sf, "events").select(F.col("event_id").alias("row_id")), 1 / 20, shuffle=False)


# Few-shot episodes of every class, then a grounding item of every record: two shapes in one set.
_ROUTED = f"""with e as ({ORACLES['two_way_weight']}), r as ({ORACLES['rec']}),
c as (select class_id, row_number() over (order by class_id)-1 mix_id, count(*) over () n from (select distinct class_id from e))
select mix_id, 0::integer source, 'episode' kind, pos, image, question, answer, "mode", null::varchar boxes, null::varchar a_boxes from e join c using (class_id)
union all select row_id+(select max(n) from c), 1, 'item', 0, image, q, a, null, boxes, a_boxes from r"""


@query("D7", _ROUTED)
def route_episodes(spark, sf):
    classes = train_records(spark, sf)
    classes = with_rank(classes, [], ["class_id"], block_range(F.col("class_id")), out="row_id")
    mixed = mixing.concat([classes, records(spark, sf)])

    def episodes(rows):
        built = ep.two_way_weight(rows.select("row_id", "class_id", "class_name", "samples", "neighbors"), QUERIES_TEXT, 3)
        return rows.select("mix_id", "source", "class_id").join(built, "class_id").select("mix_id", "source", F.col("items").alias("item"))

    def items(rows):
        built = convert.rec(rows, FIND)
        keys = rows.select("mix_id", "source", "row_id")
        return keys.join(built, "row_id").select("mix_id", "source", F.struct("image", "target", "conversations").alias("item"))

    routed = mixing.route(mixed, {0: ("episode", episodes)}, ("item", items))
    shots = routed.where("item.kind = 'episode'").select("mix_id", "source", "item.kind", F.posexplode("item.episode").alias("pos", "i"))
    q, a = F.col("item.item.conversations")[0], F.col("item.item.conversations")[1]
    single = routed.where("item.kind = 'item'").select(
        "mix_id", "source", "item.kind", F.lit(0).alias("pos"), F.col("item.item.image").alias("image"), q["value"].alias("question"),
        a["value"].alias("answer"), F.lit(None).cast("string").alias("mode"), show_boxes(F.col("item.item.target.boxes")).alias("boxes"),
        show_seq(a["boxes_seq"]).alias("a_boxes"))
    none = F.lit(None).cast("string")
    return shots.select("mix_id", "source", "kind", "pos", "i.image", "i.question", "i.answer", "i.mode", none.alias("boxes"), none.alias("a_boxes")).union(single)


_SUMMARY = f"""with {_SRC}, n as (select least(na,nb,nc) m from (select {SIZES}))
select s::integer source, case s when 0 then 'conv' when 1 then 'doc' when 2 then 'event' end as "name", case when s is null then 3*m else m end n_rows,
       null::double probability, 42 seed, 'first_exhausted' stopping from n, (values (0),(1),(2),(null)) v(s)"""


@query("D12", _SUMMARY)
def mixture_summary(spark, sf):
    spec = mixing.Mixture(("conv", "doc", "event"))
    frames = dict(zip(spec.sources, sources(spark, sf)))
    return mixing.summary(spec.build(frames), spec)


# Named variants through their converters, one on a twentieth of its records, mixed by chance until one runs out.
VARIANT_MIX = mixing.Mixture(("rec", "reg", "VQAv2_train", "recvg/20"), (0.4, 0.3, 0.2, 0.1), 42, mixing.FIRST, ())
TEMPLATE_SETS = {"REC": FIND, "REG": NAME, "VQA": ASK}
_VARIANTS_SQL = f"""i as (select 0 source, row_id k, * from ({ORACLES['rec']}) t union all select 1, row_id, * from ({ORACLES['reg']}) t
  union all select 2, row_id, * from ({ORACLES['vqav2']}) t
  union all select 3, row_number() over (order by row_id)-1, * exclude r from (select t.*, row_number() over (order by {order60(43, 'row_id')}) r from ({ORACLES['rec']}) t)
            where r<=floor((select count(*) from orders)*0.05)),
z as (select source, count(*) sz from i group by source),
dr as (select i mix_id, {rank32(42, 'i', '=source')} u from (select unnest(range(0,(select sum(sz)::bigint from z))) i)),
ds as (select mix_id, (u>=1717986918)::int+(u>=3006477107)::int+(u>=3865470566)::int source from dr),
dk as (select *, row_number() over (partition by source order by mix_id)-1 n from ds),
st as (select min(mix_id) stop from dk join z using (source) where n=sz-1),
pl as (select mix_id, source, n%sz k from dk join z using (source), st where mix_id<=stop)"""


def _variants(spark, sf):
    """Items of each variant under dense numbers; `record` is the number of the record they come from."""
    frames = {}
    rows = records(spark, sf)
    inputs = {"VQAv2_train": vqa_records(spark, sf)}
    for name in VARIANT_MIX.sources:
        variant = corpora.TWENTIETHS.get(name) or corpora.VARIANTS[name]
        items = variant.items(inputs.get(name, rows), TEMPLATE_SETS).withColumnRenamed("row_id", "record")
        frames[name] = number_rows(items, "record")
    return frames


@query("D11", f"with {_VARIANTS_SQL} select mix_id, pl.source::integer source, row_id record, image, q, a, boxes from pl join i on i.source=pl.source and i.k=pl.k")
def mixture_of_variants(spark, sf):
    mixed = VARIANT_MIX.build(_variants(spark, sf))
    q, a = F.col("conversations")[0], F.col("conversations")[1]
    return mixed.select("mix_id", "source", "record", "image", q["value"].alias("q"), a["value"].alias("a"),
                        show_boxes(F.col("target.boxes")).alias("boxes"))


@query("D12", f"""with {_VARIANTS_SQL}, c as (select source, count(*) n from pl group by source)
select source::integer source, ['rec','reg','VQAv2_train','recvg/20'][source+1] "name", n n_rows, [0.4,0.3,0.2,0.1][source+1]::double probability, 42 seed,
       'first_exhausted' stopping from c union all select null, null, sum(n)::bigint, null, 42, 'first_exhausted' from c""")
def mixture_summary_by_chance(spark, sf):
    return mixing.summary(VARIANT_MIX.build(_variants(spark, sf)), VARIANT_MIX)


_SETS_SQL = f"""with r as (select *, {rank32('event_id', '=set')}%10 u from events)
select case when u<7 then 'train' when u=7 then 'validation' when u=8 then 'test' else 'multitest_hard' end as "set", count(*) n_rows from r group by 1"""


@query("D10", _SETS_SQL)
def build_sets(spark, sf):
    from lumenfold.functions.draws import rank32 as draw

    df = table(spark, sf, "events").withColumn("u", F.pmod(draw(F.col("event_id"), "set"), F.lit(10)))
    sets = corpora.build_sets(
        train=lambda: df.where("u < 7"), validation=lambda: df.where("u = 7"), test=lambda: df.where("u = 8"),
        multitest={"hard": (lambda: df.where("u = 9"), None)}, do_train=True, do_eval=True, do_predict=True, do_multi_predict=True)
    out = None
    for name, (frame, _) in sets.items():
        one = frame.select(F.lit(name).alias("set"))
        out = one if out is None else out.union(one)
    return out.groupBy("set").agg(F.count(F.lit(1)).alias("n_rows"))
