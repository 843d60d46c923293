"""The registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.binding import let, let2

from lumenfold.llm import decontaminate, neighbours, packing, quality, rules, runs, scratch, sharding, simhash, substrings, suffixes, tokens, trie, warc

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(scratch.table(spark, sf_dir, "documents"), shards=24)


def op2_count_min_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(scratch.table(spark, sf_dir, "documents"), window=20).drop("kept_text")


def op3_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = tokens.token_lengths(scratch.table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return tokens.context_report(scratch.keep(tokens.length_histogram(lengths)))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.scratch_dir(spark)
    warc.write_warc(warc.page_records(scratch.table(spark, sf_dir, "pages"), min_bytes=0), path, compress="gzip")
    headers = ["record_id", "record_type", "refers_to", "payload_digest", "http_length"]
    # Payloads are read, and checked, of responses alone; a revisit has none.
    whole = warc.read_warc(spark, path, [*headers, "payload"], verify="true").filter("record_type = 'response'")
    short = warc.read_warc(spark, path, headers).filter("record_type = 'revisit'")
    return warc.page_digests(whole.unionByName(short, allowMissingColumns=True))


def op5_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(scratch.table(spark, sf_dir, "documents"), words_per_shingle=3, max_diff=2)


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (scratch.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.quality(docs, labels, threshold=0.3)


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(scratch.table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (scratch.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.contaminated_documents(docs, items, window=10).drop("item_ids", "spans")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(scratch.table(spark, sf_dir, "documents"), length=200).drop("kept")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(scratch.table(spark, sf_dir, "documents"), WORD_TOKENIZER, capacity=4096, end_id=1)


def op11_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (scratch.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return rules.apply_rules(docs, labels)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the documents, drawn by a checksum of their id, end periodically:
    from word a = g % n on, words repeat those of the first p = 1 + (n - a) // (3 + g % 8) words from a."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(crc / 10).cast("long")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return let2(a, p, lambda a, p: F.array_join(F.transform(
            w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " "))

    return docs.select("doc_id", F.when(crc % 10 == 0, let(words, tail)).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run by exact exponent, and checksums of all runs and of what collapsing leaves."""
    ahead = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate(  # runs come by start, then period, and the first of equals stays
        "runs", F.get("runs", 0), lambda best, r: F.when(ahead(r, best), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(scratch.table(spark, sf_dir, "documents"))
    return run_digests(runs.find_runs(docs, min_length=6, min_exponent=4))


def with_shared_heads(lists: DataFrame) -> DataFrame:
    """Turn lists whose first h turns are those of conversation `near`, h from a checksum of the id."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    # At most 39 ids have one `near`, so the window's groups are small.
    head = F.max(F.when(F.col("conv_id") == F.col("near"), F.slice("turns", 1, 3))).over(Window.partitionBy("near"))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    shared = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    return lists.withColumn("head", head).select("conv_id", F.concat(shared, own).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("conv_id").cast("long")
    lists = trie.turn_lists(scratch.table(spark, sf_dir, "conversations"), near=key - key % 20)
    return trie.prefix_trie(with_shared_heads(lists))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lpt_sharding": op1_lpt_sharding,
    "op2_count_min_dedup": op2_count_min_dedup,
    "op3_token_histogram": op3_token_histogram,
    "op4_warc_archive": op4_warc_archive,
    "op5_simhash_pigeonring": op5_simhash_pigeonring,
    "op6_pu_quality": op6_pu_quality,
    "op7_learned_partitions": op7_learned_partitions,
    "op8_positional_decontamination": op8_positional_decontamination,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_decision_list": op11_decision_list,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}
# CRC-32 of an id's decimal digits, bit by bit; prefixes are lists of turns, and each node adds to all its ancestors.
_CRC32 = """xor(list_reduce([4294967295::ubigint] || list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::ubigint),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, step: case when x % 2 = 1 then xor(x // 2, 3988292384::ubigint) else x // 2 end)),
  4294967295::ubigint)"""
_TRIE_SQL = f"""
with own as (select conv_id, list({{'role': coalesce(role, ''), 'words': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) turns
             from conversations where conv_id is not null group by conv_id),
h as (select *, conv_id - conv_id % 20 near, ({_CRC32} % 4)::int h from own),
r as (select a.conv_id, case when b.conv_id is null then a.turns[h + 1:] else b.turns[1:h] || a.turns[h + 1:] end path from h a left join own b on b.conv_id = near),
m as (select conv_id, path, unnest(range(0, len(path) + 1)) d from r),
n as (select path[1:d] node, d, min(conv_id) conv_id, count(*) n_convs,
             coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(path) = d), '') ends from m group by 1, 2),
c as (select node[1:d - 1] node, count(*) n_children from n where d > 0 group by 1),
v as (select n.*, coalesce(n_children, 0) n_children, case when d = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(n.node[d].words, '[^\\x20\\x09-\\x0D]+')) end saved
      from n left join c on c.node = n.node),
s as (select node[1:k] node, sum(saved) saved, sum((n_children = 0)::int) leaves from (select *, unnest(range(0, d + 1)) k from v) group by 1)
select v.conv_id, v.d depth, p.conv_id parent_conv_id, v.n_convs, v.n_children, s.leaves::bigint n_leaves, s.saved::bigint saved_tokens, sha256(v.ends) ends_sha256
from v join s on s.node = v.node left join n p on v.d > 0 and p.node = v.node[1:v.d - 1]"""
ORACLES: dict[str, str] = {"op13_prefix_trie": _TRIE_SQL}
