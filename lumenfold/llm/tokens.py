"""Token ids of whole texts by a public tokenizer, and the exact length histogram.

A tokenizer file is read on the driver and sent to the tasks (its size is fixed: under 10 MB), so
executors need no copy of it. Texts of plain Latin letters are encoded word by word through bounded
caches, which gives the ids of the whole text because the tokenizer lower-cases, drops white space
and merges inside a pre-token only; any other text, and any other tokenizer, is encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm import scratch

CACHE_WORDS = 100_000
# The pre-token pattern of the word-level vocabulary, for lower-cased Latin text.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LATIN_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+"
LATIN_TEXT = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _by_words(spec: dict) -> bool:
    """Whether the file is a tokenizer for which words can be encoded apart."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    norms = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    return (
        steps[0].get("pattern") == {"Regex": WORD_PATTERN} and steps[0].get("behavior") == "Removed"
        and norms == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"
    )


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_str(spec)
        self.model = self.full.model
        self.words = _by_words(json.loads(spec))
        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.pieces = re.compile(LATIN_PATTERN)
        self.by_chunk: dict[str, bytes] = {}
        self.by_word: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        got = self.by_word.get(word)
        if got is None:
            mapped = word if word.isascii() else self.level.pre_tokenize_str(word)[0][0]
            got = np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()
            if len(self.by_word) < CACHE_WORDS:
                self.by_word[word] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        got = self.by_chunk.get(chunk)
        if got is None:
            got = b"".join(map(self._word, self.pieces.findall(chunk)))
            if len(self.by_chunk) < CACHE_WORDS:
                self.by_chunk[chunk] = got
        return got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.words or not LATIN_TEXT.fullmatch(text) or any(t in text for t in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        chunks = text.lower().split(" ")
        known = list(map(self.by_chunk.get, chunks))
        if None in known:
            known = [self._chunk(c) if k is None else k for c, k in zip(chunks, known)]
        return b"".join(known)


@functools.lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    """One encoder, with its caches, for each worker process."""
    return Encoder(spec)


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row with `n_tokens` for each document; null and empty texts have 0 tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array([len(encode(t.as_py())) // 4 for t in batch.column(0)], pa.int64())})

    return docs.select("text").mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Documents by encoded length: (n_tokens, n_docs)."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_report(histogram: DataFrame, lengths_per_range: int = 4096) -> DataFrame:
    """Totals, quantiles and truncated totals for every context limit, from the histogram alone.

    One row for each length that occurs, read as a limit L = `n_tokens`: documents and tokens of
    that length; `docs_over` and `tokens_over` are the suffix sums of longer documents; `docs_upto`
    gives quantiles (`quantile` is the share of documents not longer than L); `kept_tokens` is the
    total after cutting at L and `lost_tokens` the rest. A limit M between two lengths L < M keeps
    kept_tokens(L) + (M - L) * docs_over(L); `limit_total` answers that.

    Sums over lengths go by ranges of lengths, then inside a range: the work follows the number of
    distinct lengths, which is under the square root of twice the token total.
    """
    cut = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn(
        "_range", F.floor(F.col("n_tokens") / lengths_per_range))
    sums = cut.groupBy("_range").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    # One row for a range of lengths: few enough for one window.
    whole = Window.partitionBy(F.lit(0))
    later = whole.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    after = sums.select(
        "_range", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("_d", "_t")],
        F.sum("_d").over(whole).alias("_docs"), F.sum("_t").over(whole).alias("_tokens"))
    longer = Window.partitionBy("_range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c: F.coalesce(F.sum(c).over(longer), F.lit(0))
    return (
        cut.join(after, "_range")
        .select(
            "n_tokens", "n_docs", F.col("tokens").alias("n_tokens_total"),
            (over("n_docs") + F.col("_d_after")).alias("docs_over"), (over("tokens") + F.col("_t_after")).alias("tokens_over"),
            "_docs", "_tokens")
        .select(
            "n_tokens", "n_docs", "n_tokens_total", "docs_over", "tokens_over",
            (F.col("_docs") - F.col("docs_over")).alias("docs_upto"),
            ((F.col("_docs") - F.col("docs_over")) / F.col("_docs")).alias("quantile"),
            (F.col("_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("kept_tokens"),
            (F.col("tokens_over") - F.col("n_tokens") * F.col("docs_over")).alias("lost_tokens"))
    )


def limit_total(report: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, kept_tokens) for any limits of at least 0, from the nearest length not above each."""
    spark = report.sparkSession
    if not limits:
        return spark.createDataFrame([], "limit long, kept_tokens long")
    fields = F.struct("n_tokens", "kept_tokens", "docs_over")
    found = report.agg(
        F.sum("n_docs").alias("all"),
        *[F.max(F.when(F.col("n_tokens") <= m, fields)).alias(f"l{k}") for k, m in enumerate(limits)])
    cell = lambda k, m: F.struct(F.lit(int(m)).cast("long").alias("limit"), F.coalesce(
        F.col(f"l{k}.kept_tokens") + (m - F.col(f"l{k}.n_tokens")) * F.col(f"l{k}.docs_over"),
        m * F.col("all"), F.lit(0)).cast("long").alias("kept_tokens"))
    return found.select(F.inline(F.array(*[cell(k, m) for k, m in enumerate(limits)])))
