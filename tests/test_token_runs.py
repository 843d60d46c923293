"""Token runs give what the plain arrays give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions import token_runs as tr
from lumenfold.functions import tokens

WORDS = [S.IM_START, S.IM_PATCH, S.IM_PATCH, S.IM_PATCH, S.IM_END, "a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(1)
    texts = [[draw.choice(WORDS) for _ in range(draw.randint(0, 30))] for _ in range(150)]
    image = [S.IM_START] + [S.IM_PATCH] * 256 + [S.IM_END]
    texts += [["a"] * 9 + image + ["b"] * 9, image, image + image + ["x"], image[:-1] + ["x"], []]
    df = spark.createDataFrame([(i, t, [len(w) for w in t]) for i, t in enumerate(texts)], "row_id bigint, t array<string>, ids array<int>")
    return df.select("*", tr.encode(F.col("t")).alias("r")).cache()


def test_encode_and_decode(rows):
    got = rows.select("t", tr.decode(F.col("r")).alias("d"), "r", tr.total(F.col("r")).alias("n")).collect()
    assert all(x.t == x.d and x.n == len(x.t) for x in got)
    assert all(a.value != b.value and a.start + a.length == b.start for x in got for a, b in zip(x.r, x.r[1:]))
    assert [len(x.r) for x in got[150:]] == [5, 3, 7, 3, 0]  # an image is three runs


@pytest.mark.parametrize("limit", [0, 5, 12, 300])
def test_truncation(rows, limit):
    sample = lambda f: F.struct(f(F.col("t")).alias("input_ids"), f(F.transform("t", lambda x: F.lit(1))).alias("attention_mask"), f(F.col("ids")).alias("labels"))
    plain = tokens.truncate(sample(lambda c: c), limit, on_error="flag")
    coded = tr.truncate(sample(tr.encode), limit, on_error="flag")
    got = rows.select("row_id", plain.alias("p"), coded.alias("c")).select(
        "p", *[tr.decode(F.col("c")[f]).alias(f) for f in tr.FIELDS], tr.total(F.col("c.labels")).alias("n")).collect()
    flagged = 0
    for x in got:
        if x.p.input_ids is None:
            flagged += 1
            assert x.input_ids is None
        else:
            assert (x.p.input_ids, x.p.attention_mask, x.p.labels) == (x.input_ids, x.attention_mask, x.labels) and x.n == len(x.labels)
    assert flagged or limit > 258
    if flagged:
        with pytest.raises(Exception, match="protected tokens exceed"):
            rows.select(tr.truncate(sample(tr.encode), limit).alias("c")).collect()


def test_episodes(rows):
    item = lambda f: F.struct("row_id", f(F.col("ids")).alias("input_ids"), f(F.transform("ids", lambda x: x + 100)).alias("attention_mask"), f(F.col("ids")).alias("labels"))
    by = rows.groupBy(F.floor(F.col("row_id") / 4).alias("ep"))
    plain = by.agg(F.array_sort(F.collect_list(item(lambda c: c))).alias("i")).select("ep", tokens.concat_episode(F.col("i")).alias("p"))
    coded = by.agg(F.array_sort(F.collect_list(item(tr.encode))).alias("i")).select("ep", tr.concat_episode(F.col("i")).alias("c"))
    for x in plain.join(coded, "ep").select("p", "c", *[tr.decode(F.col("c")[f]).alias(f) for f in tr.FIELDS]).collect():
        assert (x.p.input_ids, x.p.attention_mask, x.p.labels) == (x.input_ids, x.attention_mask, x.labels)
        for f in tr.FIELDS:
            assert [r.start for r in x.c[f]] == [sum(q.length for q in x.c[f][:k]) for k in range(len(x.c[f]))]


@pytest.mark.parametrize("left", [False, True])
def test_padding(rows, left):
    fields = lambda f: {"input_ids": f(F.col("ids")), "attention_mask": f(F.transform("ids", lambda x: F.lit(1))), "labels": f(F.col("ids"))}
    plain = tokens.pad_batches(rows.withColumns(fields(lambda c: c)), 8, 7, left=left)
    coded = tr.pad_batches(rows.withColumns(fields(tr.encode)), 8, 7, left=left)
    show = lambda df, f: {r.row_id: (r.batch_id, *[r[c] for c in tr.FIELDS]) for r in df.select("row_id", "batch_id", *[f(F.col(c)).alias(c) for c in tr.FIELDS]).collect()}
    assert show(plain, lambda c: c) == show(coded, tr.decode)


@pytest.mark.parametrize("patches, wrap", [(256, True), (1, True), (3, True), (256, False), (2, False)])
def test_span_checks(rows, patches, wrap):
    got = rows.select(tokens.image_span_problem(F.col("t"), patches, wrap).alias("p"), tr.image_span_problem(F.col("r"), patches, wrap).alias("c")).collect()
    assert [x.p for x in got] == [x.c for x in got] and len({x.p for x in got}) > 1
