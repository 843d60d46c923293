"""Conversations to prompts, segments and message lists; token arrays from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import load, query, rank32, table
from lumenfold import schema as S
from lumenfold.functions import prompts, text, token_runs, tokens
from lumenfold.functions.binding import explode_items
from lumenfold.functions.prompt_templates import TEMPLATES
from lumenfold.operators import conversations as conv


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Per style: text before the first role, between role and message, after even and odd messages.
STYLES = {
    "vicuna_v1.1": ("{system} ", ": ", " ", "</s>"), "hypnotized_ans_v1.0": (" ", ": ", " ", "</s>"),
    "otter": ("{system} ", " ", " ", "<|endofchunk|>"), "oasst_pythia": ("{system}", "", "<|endoftext|>", "<|endoftext|>"),
    "baize": ("{system}\n[|Human|]Hello!\n[|AI|]Hi!\n", "", "\n", "\n"), "dolly_v2": ("{system}", ":\n", "\n\n", "### End\n\n"),
    "rwkv": ("{system}Bob: Hi\n\nAlice: {hello}\n\n", ": ", "\n\n", "\n\n"), "phoenix": ("{system}", ": <s>", "</s>", "</s>"),
    "mpt": ("{system}<|im_end|>", "\n", "<|im_end|>", "<|im_end|>"), "billa": ("{system}\n", ": ", "\n", "\n"),
    "claude": ("{system}\n\n", ": ", "\n\n", "\n\n"),
}


def _segment(mode: str) -> str:
    t = TEMPLATES[mode]
    _, gap, even, odd = STYLES[mode]
    said = "replace(replace(text,chr(13)||chr(10),chr(10)),chr(10)||chr(10),chr(10))" if mode == "rwkv" else "text"
    role = f"case when role='user' then {_quote(t.roles[0])} else {_quote(t.roles[1])} end"
    return f"{role}||{_quote(gap)}||{said}||case when position%2=0 then {_quote(even)} else {_quote(odd)} end"


def _lead(mode: str, own: str = "sys") -> str:
    """SQL of the text before the first role; `own` is the conversation's system text."""
    t = TEMPLATES[mode]
    hello = t.messages[1][1] if mode == "rwkv" else ""
    text = STYLES[mode][0].replace("{hello}", hello)
    rest = _quote(text.removeprefix("{system}"))
    return f"coalesce({own},{_quote(t.system)})||{rest}" if text.startswith("{system}") else rest


def _prompt_sql(mode: str) -> str:
    return f"select conv_id, {_lead(mode, 'min(sys)')}||string_agg({_segment(mode)}, '' order by position) prompt from turns group by conv_id"


def _conversations(spark, sf):
    return conv.collect_turns(table(spark, sf, "conversations"))


for _m in STYLES:
    query("F2,F3,F4", _prompt_sql(_m), ["turns"], name=f"prompt_{_m.replace('.', '_')}")(
        lambda spark, sf, m=_m: _conversations(spark, sf).select(
            "conv_id", prompts.render(m, prompts.to_messages(F.col("conversations"), m), system=F.col("system")).alias("prompt")))

MIXED = ["common", "icl", "koala_v1"]


@query("F4", f"""
with t as (select *, (['vicuna_v1.1','icl_v1.0','koala_v1'])[({rank32(0, 'conv_id')}%3+1)::INT] mode from turns)
select conv_id, mode, coalesce(min(sys), case mode when 'vicuna_v1.1' then {_quote(TEMPLATES['vicuna_v1.1'].system)}
       when 'icl_v1.0' then {_quote(TEMPLATES['icl_v1.0'].system)} else 'BEGINNING OF CONVERSATION:' end)||' '||
       string_agg(case when role='user' then 'USER' when mode='koala_v1' then 'GPT' else 'ASSISTANT' end||': '||text||
       case when position%2=0 then ' ' else '</s>' end, '' order by position) prompt
from t group by conv_id, mode""", ["turns"])
def prompt_by_mode(spark, sf):
    from lumenfold.functions.draws import pick
    from lumenfold.functions.prompt_templates import ALIASES

    df = _conversations(spark, sf).withColumn("mode", pick(F.array(*[F.lit(m) for m in MIXED]), 0, F.col("conv_id")))
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return df.select("conv_id", F.coalesce(names[F.col("mode")], F.col("mode")).alias("mode"),
                     prompts.render_by_mode(F.col("mode"), F.col("conversations"), MIXED, F.col("system")).alias("prompt"))


@query("F3", f"""select conv_id, position, case when position=0 then {_lead('vicuna_v1.1')} else '' end||{_segment('vicuna_v1.1')} segment
       from turns""", ["turns"])
def prompt_segments(spark, sf):
    return conv.prompt_segments(load(spark, sf, "turns"), "vicuna_v1.1", system=F.col("sys"))


@query("F1", """
with t as (select conv_id, count(*) filter (position%2=0 and contains(text,'qu')) q, count(*) filter (position%2=1 and contains(text,'qu')) a,
           count(*) filter (contains(text,'ing')) b, min(sys) sys from turns group by conv_id)
select conv_id, case when q>0 and conv_id%3=0 then 'image placeholder without image' when a>0 then 'image placeholder in an answer'
       when b>0 and conv_id%2=0 then 'box placeholder without boxes' end problem, conv_id%3<>0 and q=0 image_unused, sys from t""", ["turns"])
def validate_items(spark, sf):
    marked = F.transform("conversations", lambda t: t.withField("value", text.swap(text.swap(t["value"], "qu", S.IMAGE), "ing", S.BOXES)))
    null = F.lit(None)
    df = _conversations(spark, sf).select(
        "conv_id", F.when(F.col("conv_id") % 3 != 0, F.lit("x.jpg")).alias("image"),
        F.struct(F.when(F.col("conv_id") % 2 != 0, F.array().cast(S.BOX_LIST)).alias("boxes"), null.cast(S.BOX_LIST).alias("points")).alias("target"),
        marked.alias("conversations"), F.col("system").alias("sys"))
    return conv.validate(df).select("conv_id", "problem", "image_unused", "sys")


@query("F5,F6", """select conv_id, turn, replace(text,'qu','<im_start><im_patch><im_patch><im_patch><im_end>') expanded,
       '<image> USER: '||regexp_replace(replace(text,'qu',''),'^\\s+|\\s+$','','g') fronted from conversations""")
def image_tokens(spark, sf):
    marked = text.swap(F.col("text"), "qu", S.IMAGE)
    return table(spark, sf, "conversations").select("conv_id", "turn", prompts.expand_image(marked, 3).alias("expanded"),
                                           prompts.image_to_front(marked, "vicuna_v1.1").alias("fronted"))


@query("F7", f"""
with t as (select *, max(position) over (partition by conv_id) last from turns),
p as (select conv_id, {_lead('vicuna_v1.1', 'min(sys)')}||string_agg({_segment('vicuna_v1.1')}, '' order by position) target,
      {_lead('vicuna_v1.1', 'min(sys)')}||string_agg(case when position=last then case when role='user' then 'USER:' else 'ASSISTANT:' end else {_segment('vicuna_v1.1')} end, '' order by position) prompt
      from t group by conv_id)
select conv_id, prompt, target from p""", ["turns"])
def prompt_and_target(spark, sf):
    messages = prompts.to_messages(F.col("conversations"), "vicuna_v1.1")
    return _conversations(spark, sf).select("conv_id", prompts.prompt_and_target("vicuna_v1.1", messages, system=F.col("system")).alias("p")).select("conv_id", "p.*")


@query("F8", f"""
with t as (select *, count(*) over (partition by conv_id)%2=0 closed, max(position) over (partition by conv_id) last from turns)
select conv_id, position n, case when position=0 then {_lead('vicuna_v1.1')} else '' end||
       case when role='user' then 'USER: '||text||case when closed or position<last then ' ASSISTANT: ' else ' ' end else text||'</s>' end as "text",
       role<>'user' and closed trainable from t""", ["turns"])
def loss_segments(spark, sf):
    prompt = prompts.render("vicuna_v1.1", prompts.to_messages(F.col("conversations"), "vicuna_v1.1"), system=F.col("system"))
    df = _conversations(spark, sf).select("conv_id", explode_items(prompts.loss_segments(prompt), "n", "s"))
    return df.select("conv_id", F.col("n").cast("bigint").alias("n"), "s.text", "s.trainable")


@query("F13", """
select conv_id, position+1 n, role, text content from turns union all
select distinct conv_id, 0, 'system', coalesce(sys,'You are a helpful assistant.') from turns""", ["turns"])
def openai_messages(spark, sf):
    out = prompts.openai_messages("chatgpt", prompts.to_messages(F.col("conversations"), "chatgpt"), F.col("system"))
    return _conversations(spark, sf).select("conv_id", explode_items(out, "n", "m")).select("conv_id", F.col("n").cast("bigint").alias("n"), "m.role", "m.content")


@query("F14", """select q.conv_id, q.position//2 n, q.text question, a.text answer, q.sys from turns q
       left join turns a on a.conv_id=q.conv_id and a.position=q.position+1 where q.position%2=0""", ["turns"])
def chat_pairs(spark, sf):
    out = prompts.chat_pairs(prompts.to_messages(F.col("conversations"), "common"))
    return _conversations(spark, sf).select("conv_id", F.col("system").alias("sys"), explode_items(out, "n", "m")).select(
        "conv_id", F.col("n").cast("bigint").alias("n"), "m.question", "m.answer", "sys")


@query("F17", """
select conv_id, 'koala_v1' as "name", coalesce(min(sys),'BEGINNING OF CONVERSATION:') as "system", 'USER,GPT' roles, 0 as "offset", count(*) n_messages,
       conv_id::varchar id_text, string_agg(case when role='user' then 'USER' else 'GPT' end||'='||text, '|' order by position) said, null::varchar model_name
from turns group by conv_id""", ["turns"])
def conversation_record(spark, sf):
    rec = prompts.conversation_record("koala_v1", prompts.to_messages(F.col("conversations"), "koala_v1"), F.col("conv_id"), system=F.col("system"))
    ddl = "name string, system string, roles array<string>, messages array<array<string>>, offset int, conv_id string, model_name string"
    df = _conversations(spark, sf).select("conv_id", F.from_json(rec, ddl).alias("r"))
    return df.select("conv_id", "r.name", "r.system", F.array_join("r.roles", ",").alias("roles"), "r.offset",
                     F.size("r.messages").cast("bigint").alias("n_messages"), F.col("r.conv_id").alias("id_text"),
                     F.array_join(F.transform("r.messages", lambda m: F.concat(m[0], F.lit("="), m[1])), "|").alias("said"), "r.model_name")


@query("C21", """select conv_id, turn, replace(replace(replace(replace(replace(replace(text||t,'<image>',''),'<im_start>',''),'<im_end>',''),
       '[BEGIN EXAMPLE]',''),'[END EXAMPLE]',''),'[FINAL QUESTION]','') scrubbed
       from (select *, case when turn%2=0 then '<im<image>age>[END EXAMPLE]x' else '[FINAL [BEGIN EXAMPLE]QUESTION]<im_end>' end t from conversations)""")
def scrub_text(spark, sf):
    dirty = F.concat("text", F.when(F.col("turn") % 2 == 0, F.lit("<im<image>age>[END EXAMPLE]x")).otherwise(F.lit("[FINAL [BEGIN EXAMPLE]QUESTION]<im_end>")))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.scrub(dirty).alias("scrubbed"))


# Token arrays: documents split at spaces, words that start with "th" stand for protected tokens.


def _tokens(spark, sf, limit=None):
    return table(spark, sf, "documents").repartition(spark.sparkContext.defaultParallelism, "doc_id").select("doc_id", F.split("text", " ").alias("tokens"))


_TOK = "(select doc_id, unnest(string_split(text,' ')) tok, generate_subscripts(string_split(text,' '),1)-1 i from documents)"
PROTECTED = ["the", "la", "die"]


@query("F11", f"""
with t as (select *, tok in ('the','la','die') held, count(*) over (partition by doc_id) n from {_TOK}),
c as (select *, count(*) filter (held) over (partition by doc_id) h,
      row_number() over (partition by doc_id, held order by i) k from t)
select doc_id, case when min(n)<=400 or min(h)<=400 then count(*) filter (n<=400 or held or k<=400-h) end::bigint n_kept,
       case when min(n)<=400 or min(h)<=400 then md5(string_agg(tok,' ' order by i) filter (n<=400 or held or k<=400-h)) end kept,
       min(n)>400 and min(h)>400 too_many from c group by doc_id""", name="truncate_protected")
def truncate_protected(spark, sf):
    """Documents whose protected words alone exceed the limit are flagged."""
    kept = tokens.kept_positions(F.col("tokens"), 400, PROTECTED, on_error="flag")
    df = _tokens(spark, sf).select("doc_id", tokens.at_positions(F.col("tokens"), kept).alias("k"))
    size = F.when(F.col("k").isNotNull(), F.size("k").cast("bigint"))
    return df.select("doc_id", size.alias("n_kept"), F.md5(F.array_join("k", " ")).alias("kept"), F.col("k").isNull().alias("too_many"))


# Whole arrays as text, so that order, sides and every value are compared.
_IDS_SQL = "list_transform(string_split(text,' '), lambda x: length(x))"
_show_sql = lambda ids: f"md5(array_to_string({ids},','))"
_show = lambda ids: F.md5(F.array_join(ids.cast("array<string>"), ","))


@query("F12", f"""
with t as (select doc_id, doc_id//16 batch_id, {_IDS_SQL} ids from documents),
w as (select *, max(len(ids)) over (partition by batch_id) width from t),
p as (select *, list_transform(range(width-len(ids)), lambda x: 0) zeros, list_transform(range(width-len(ids)), lambda x: -100) skipped from w)
select doc_id, batch_id, width, {_show_sql("ids||zeros")} input_ids, {_show_sql("list_transform(ids, lambda x: 1)||zeros")} attention_mask,
       {_show_sql("ids||skipped")} labels from p""")
def pad_batches(spark, sf):
    ids = F.transform("tokens", lambda t: F.length(t))
    # Dealt by batch as texts, so that the arrays, which are larger, are not shuffled for the widths.
    docs = table(spark, sf, "documents").repartition(F.floor(F.col("doc_id") / 16).cast("bigint"))
    df = docs.select("doc_id", F.split("text", " ").alias("tokens")).select(
        "doc_id", ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size("tokens")).alias("attention_mask"), ids.alias("labels"))
    out = tokens.pad_batches(df, 16, 0, row_id="doc_id")
    return out.select("doc_id", "batch_id", F.size("input_ids").cast("bigint").alias("width"),
                      *[_show(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query("F9", f"""
with t as (select doc_id//3 ep, doc_id%3 k, {_IDS_SQL} ids, count(*) over (partition by doc_id//3) m from documents),
c as (select ep, k, k=m-1 final, case when k=0 or k=m-1 then ids else ids[:-2] end ids from t),
l as (select *, case when final then ids else list_transform(ids, lambda x: -100) end labels, list_transform(ids, lambda x: x+1000) mask from c)
select ep, sum(len(ids))::bigint n_tokens, {_show_sql("flatten(list(ids order by k))")} input_ids,
       {_show_sql("flatten(list(mask order by k))")} attention_mask, {_show_sql("flatten(list(labels order by k))")} labels
from l group by ep""")
def concat_episode(spark, sf):
    """The mask carries ids plus 1000, to tell it from the ids."""
    ids = F.transform("tokens", lambda t: F.length(t))
    df = _tokens(spark, sf).select(F.floor(F.col("doc_id") / 3).alias("ep"), (F.col("doc_id") % 3).alias("k"), ids.alias("ids"))
    mask = F.transform("ids", lambda x: x + 1000)
    item = F.struct("k", F.col("ids").alias("input_ids"), mask.alias("attention_mask"), F.col("ids").alias("labels"))
    items = df.groupBy("ep").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = items.select("ep", tokens.concat_episode(F.col("items")).alias("s"))
    return out.select("ep", F.size("s.input_ids").cast("bigint").alias("n_tokens"),
                      *[_show(F.col(f"s.{c}")).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query("F10", """select doc_id, string_split(text,' ')[-1]||'|'||string_split(text,' ')[1]||'|'||string_split(text,' ')[-1] images from documents""")
def reorder_images(spark, sf):
    last = F.size("tokens") - 1
    turns = F.array(F.struct(F.array(last).alias("image_seq")), F.struct(F.lit(None).cast("array<int>").alias("image_seq")),
                    F.struct(F.array(F.lit(0), last).alias("image_seq")))
    return _tokens(spark, sf).select("doc_id", F.array_join(tokens.reorder_images(F.col("tokens"), turns), "|").alias("images"))


@query("F15", f"""select doc_id, {_show_sql("list_transform(string_split(text,' '), lambda x: case when length(x)%5=0 then 7 else length(x) end)")} ids
       from documents""")
def negatives_to_pad(spark, sf):
    ids = F.transform("tokens", lambda t: F.when(F.length(t) % 5 == 0, F.lit(-100)).otherwise(F.length(t)))
    return _tokens(spark, sf).select("doc_id", _show(tokens.negatives_to_pad(ids, 7)).alias("ids"))


@query("F16", """select doc_id, case doc_id%4 when 1 then 'end token does not follow the patches' when 2 then 'start and end counts differ' end problem
       from documents""")
def image_span_check(spark, sf):
    """Every document gets an image run, sound or broken in one of two ways; every fourth has none."""
    p = S.IM_PATCH
    runs = {0: f"{S.IM_START} {p} {p} {S.IM_END}", 1: f"{S.IM_START} {p} {S.IM_END}", 2: f"{S.IM_START} {p} {p}", 3: "no image"}
    extra = F.lit(runs[3])
    for k in (0, 1, 2):
        extra = F.when(F.col("doc_id") % 4 == k, F.lit(runs[k])).otherwise(extra)
    df = _tokens(spark, sf).select("doc_id", F.concat("tokens", F.split(extra, " ")).alias("tokens"))
    return df.select("doc_id", tokens.image_span_problem(F.col("tokens"), 2).alias("problem"))


# The same four on runs: turns with an image of 256 patches behind their first word, the plain form at the end only.
_IMAGE_SQL = f"""tk as (select conv_id, turn, case turn%3 when 0 then w[1:1]||['{S.IM_START}']||list_transform(range(256), lambda x: '{S.IM_PATCH}')||['{S.IM_END}']||w[2:]
  when 1 then w[1:1]||['{S.IM_START}']||list_transform(range(255), lambda x: '{S.IM_PATCH}')||['{S.IM_END}']||w[2:] else w end t
  from (select conv_id, turn, string_split(text,' ') w from conversations))"""


def _image_rows(spark, sf):
    words = F.split("text", " ")
    image = lambda n: F.concat(F.slice(words, 1, 1), F.array(F.lit(S.IM_START)), F.array_repeat(F.lit(S.IM_PATCH), n), F.array(F.lit(S.IM_END)),
                               F.slice(words, F.lit(2), F.size(words)))
    with_image = F.when(F.col("turn") % 3 == 0, image(256)).when(F.col("turn") % 3 == 1, image(255)).otherwise(words)
    return table(spark, sf, "conversations").select("conv_id", "turn", with_image.alias("t")).select(
        "conv_id", "turn", token_runs.encode(F.col("t")).alias("r"), token_runs.encode(F.transform("t", lambda x: F.length(x))).alias("ids"))


def _plain(runs):
    return _show(token_runs.decode(runs))


@query("F11", f"""
with {_IMAGE_SQL}, u as (select conv_id, turn, unnest(t) tok, generate_subscripts(t,1) i, len(t) n from tk),
h as (select *, tok in ('{S.IM_PATCH}','{S.IM_START}','{S.IM_END}') held from u),
c as (select *, count(*) filter (held) over (partition by conv_id, turn) k, row_number() over (partition by conv_id, turn, held order by i) j from h)
select conv_id, turn, md5(string_agg(tok,',' order by i)) kept, count(*)::integer n_kept from c where n<=262 or held or j<=262-k group by conv_id, turn""")
def runs_truncate(spark, sf):
    r = F.col("r")
    sample = F.struct(r.alias("input_ids"), r.alias("attention_mask"), r.alias("labels"))
    kept = _image_rows(spark, sf).select("conv_id", "turn", token_runs.truncate(sample, 262).alias("s"))
    return kept.select("conv_id", "turn", _plain(F.col("s.labels")).alias("kept"), token_runs.total(F.col("s.input_ids")).alias("n_kept"))


@query("F12", f"""
with {_IMAGE_SQL}, i as (select conv_id, turn, conv_id//4 batch_id, list_transform(t, lambda x: length(x)) ids from tk),
w as (select *, list_transform(range(max(len(ids)) over (partition by batch_id, turn)-len(ids)), lambda x: 0) zeros from i)
select conv_id, turn, batch_id, {_show_sql("zeros||ids")} input_ids, {_show_sql("zeros||list_transform(ids, lambda x: 1)")} attention_mask,
       {_show_sql("list_transform(zeros, lambda x: -100)||ids")} labels from w""")
def runs_pad(spark, sf):
    """Padded on the left."""
    df = _image_rows(spark, sf)
    mask = token_runs.constant(F.lit(1), token_runs.total(F.col("ids")))
    df = df.select("conv_id", "turn", F.col("ids").alias("input_ids"), mask.alias("attention_mask"), F.col("ids").alias("labels"))
    out = token_runs.pad_batches(df, 4, 0, row_id="conv_id", left=True, partition=["turn"])
    return out.select("conv_id", "turn", "batch_id", *[_plain(F.col(c)).alias(c) for c in token_runs.FIELDS])


@query("F9", f"""
with {_IMAGE_SQL}, i as (select conv_id, turn, list_transform(t, lambda x: length(x)) ids,
  row_number() over (partition by conv_id order by turn) k, count(*) over (partition by conv_id) m from tk),
c as (select conv_id, k, k=m final, case when k=1 or k=m then ids else ids[:-2] end ids from i)
select conv_id, sum(len(ids))::integer n_tokens, {_show_sql("flatten(list(ids order by k))")} input_ids,
       {_show_sql("flatten(list(case when final then ids else list_transform(ids, lambda x: -100) end order by k))")} labels from c group by conv_id""")
def runs_episode(spark, sf):
    ids = F.col("ids")
    item = F.struct("turn", ids.alias("input_ids"), ids.alias("attention_mask"), ids.alias("labels"))
    items = _image_rows(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = items.select("conv_id", token_runs.concat_episode(F.col("items")).alias("s"))
    return out.select("conv_id", token_runs.total(F.col("s.input_ids")).alias("n_tokens"),
                      *[_plain(F.col(f"s.{c}")).alias(c) for c in ("input_ids", "labels")])


@query("F16", """select conv_id, turn, case turn%3 when 1 then 'end token does not follow the patches' end problem from conversations""")
def runs_span_check(spark, sf):
    return _image_rows(spark, sf).select("conv_id", "turn", token_runs.image_span_problem(F.col("r")).alias("problem"))
