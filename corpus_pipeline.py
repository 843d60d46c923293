"""From raw documents to packed training sequences, in five stages of the subpackage `llm`.

Each stage gets the rows its predecessor kept, as a DataFrame with the columns of `documents`, and
is written as Parquet and read again before the next. The last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, packing, quality, scratch, similar, suffixes
from lumenfold.llm.queries import WORD_TOKENIZER

THRESHOLD = 0.3


def _folded(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that no name of theirs meets one of an operator."""
    others = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    every = F.struct(*others) if others else F.lit(None)
    return docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("null_text"), every.alias("columns")).alias("others"))


def _unfolded(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others.columns").getField(c).alias(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts; it is fitted on what it filters.

    Null and empty texts are scored like any other, rows that repeat a doc_id each by its text; an
    empty table stays empty, and without trusted positives every document stays.
    """
    model = quality.fit(docs.select("doc_id", "text"), scratch.table(spark, sf_dir, "labels"))
    scored = quality.score_documents(_folded(docs), model, THRESHOLD).filter("_predicted = 1")
    return _unfolded(scored, docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of texts with a five-word similarity of 0.8 or more.

    One with a null doc_id stays only where its component has no other; null and wordless texts are
    copies of each other. An empty table stays empty.
    """
    return _unfolded(similar.one_of_each(_folded(docs)), docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 200 that stand elsewhere too; a character cut in two goes.

    Every document stays, if with an empty text; a null text stays null. n_chars follows the text.
    """
    found = suffixes.remove_repeats(_folded(docs), length=200, carry=("others",))
    given = ~F.col("rest.others.null_text")
    text = F.when(given, F.expr("try_validate_utf8(cast(kept as string))"))
    # Where a cut left half a character, the halves are taken out.
    whole = F.coalesce(text, F.when(given, F.regexp_replace(F.expr("make_valid_utf8(cast(kept as string))"), "\uFFFD", "")))
    done = _unfolded(found.select("doc_id", whole.alias("text"), F.col("rest.others").alias("others")), docs.columns)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a 10-word window of the benchmark.

    Judged by row: ids can be null or stand on different texts. Null texts have no words and stay.
    """
    rows = scratch.keep(_folded(docs).withColumn("_row", F.monotonically_increasing_id()))
    found = decontaminate.contaminated_documents(
        rows.select(F.col("_row").alias("doc_id"), "text"), scratch.table(spark, sf_dir, "benchmark"), window=10)
    bad = found.filter("contaminated").select(F.col("doc_id").alias("_row"))
    return _unfolded(rows.join(bad, "_row", "left_anti"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset, of every row; a null text is an empty one."""
    return packing.pack(docs, WORD_TOKENIZER, capacity=4096, end_id=1)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("contamination", drop_contaminated),
    ("packing", pack),
]

# The classifier, the suffix array and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
