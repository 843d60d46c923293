"""Entity captions: phrase markup parsing, and joining phrases with their boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.binding import let, let2
from lumenfold.functions.text import words


def parse_phrases(sentence: Column) -> Column:
    """`struct<sentence, phrases array<struct<first_word_index,phrase,phrase_id,phrase_type>>>`.

    Markup is `[/EN#id/type/type words]`; the opening token is no word, the closing bracket goes.
    A phrase opens at a token that starts with `[` and closes at the next token that ends with `]`.
    """
    return let(words(sentence), _parse)


def _parse(tokens: Column) -> Column:
    n = F.size(tokens)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # One pass finds the spans; everything else is read off token positions.
    state = F.struct(
        F.lit(False).alias("inside"), F.lit(0).alias("open"), F.array().cast("array<struct<open:int,close:int>>").alias("spans")
    )

    def step(s, i):
        tok = F.get(tokens, i)
        opens = ~s["inside"] & tok.startswith("[")
        closes = s["inside"] & tok.endswith("]")
        span = F.struct(s["open"].alias("open"), i.alias("close"))
        return F.struct(
            F.when(opens, True).when(closes, False).otherwise(s["inside"]).alias("inside"),
            F.when(opens, i).otherwise(s["open"]).alias("open"),
            F.when(closes, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"),
        )

    return F.aggregate(every, state, step, lambda s: _phrases(tokens, every, s))


def _phrases(tokens: Column, every: Column, s: Column) -> Column:
    closed = F.transform(s["spans"], lambda p: p["open"])
    opens = F.when(s["inside"], F.concat(closed, F.array(s["open"]))).otherwise(closed)
    closes = F.transform(s["spans"], lambda p: p["close"])
    return let2(opens, closes, lambda o, c: _read_spans(tokens, every, s["spans"], o, c))


def _read_spans(tokens: Column, every: Column, spans: Column, opens: Column, closes: Column) -> Column:
    cut = lambda tok: F.substring(tok, F.lit(1), F.length(tok) - 1)
    word = lambda i: F.when(F.array_contains(closes, i), cut(F.get(tokens, i))).otherwise(F.get(tokens, i))
    said = F.transform(F.filter(every, lambda i: ~F.array_contains(opens, i)), word)

    def one(span, k):
        parts = F.split(F.get(tokens, span["open"]), "/")
        text = F.transform(F.sequence(span["open"] + 1, span["close"]), word)
        return F.struct(
            (span["open"] - k).alias("first_word_index"),
            F.array_join(text, " ").alias("phrase"),
            F.substring(parts[1], 4, 1 << 30).alias("phrase_id"),
            F.slice(parts, 3, 1 << 30).alias("phrase_type"),
        )

    return F.struct(F.array_join(said, " ").alias("sentence"), F.transform(spans, one).alias("phrases"))


def flatten_sentences(sentences: DataFrame, objects: DataFrame) -> DataFrame:
    """Entity sentences with the boxes of their phrases: `image_id, sentence_no, boxes, sentence, boxes_seq`.

    `sentences` from `sources.entity_sentences`, `objects` from `sources.entity_objects`. Phrases
    without a box are left as plain words; boxes are listed in order of first mention.
    """
    parsed = sentences.select("image_id", "sentence_no", parse_phrases(F.col("sentence")).alias("p"))
    boxed = objects.where(F.col("box").isNotNull())
    entry = F.struct("object_no", "box")
    per_id = boxed.groupBy("image_id", "box_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["box"]).alias("box_list")
    )
    per_image = per_id.groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct("box_id", "box_list"))).alias("_map")
    )
    joined = parsed.join(per_image, "image_id", "left")
    lookup = F.coalesce(F.col("_map"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<array<int>>>")))
    known = F.filter("p.phrases", lambda f: F.map_contains_key(F.col("_map"), f["phrase_id"]))
    df = joined.withColumn("_map", lookup).withColumn("_known", known)
    ids = F.array_distinct(F.transform("_known", lambda f: f["phrase_id"]))
    df = df.withColumn("_ids", ids)
    count = lambda rid: F.size(F.col("_map")[rid])
    start = lambda rid: F.aggregate(
        F.slice("_ids", 1, (F.array_position("_ids", rid) - 1).cast("int")), F.lit(0), lambda a, r: a + count(r)
    )
    seq = F.transform("_known", lambda f: F.transform(
        F.sequence(F.lit(0), count(f["phrase_id"]) - 1), lambda k: start(f["phrase_id"]) + k
    ))
    boxes = F.flatten(F.transform("_ids", lambda r: F.col("_map")[r]))
    tokens = F.split("p.sentence", " ")
    first = F.transform("_known", lambda f: f["first_word_index"])
    last = F.transform("_known", lambda f: f["first_word_index"] + F.size(F.split(f["phrase"], " ")) - 1)
    tag = lambda at, i, mark: F.when(F.array_contains(at, i), F.lit(mark)).otherwise(F.lit(""))
    wrap = lambda f, l: F.transform(
        tokens, lambda w, i: F.concat(tag(f, i, S.PHRASE_START), w, tag(l, i, S.PHRASE_END))
    )
    marked = let2(first, last, wrap)
    return df.select(
        "image_id", "sentence_no", boxes.cast("array<array<int>>").alias("boxes"),
        F.array_join(marked, " ").alias("sentence"), seq.cast(S.SEQ).alias("boxes_seq"),
    )
