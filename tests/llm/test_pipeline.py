"""Every stage, and the whole pipeline, on rows that are awkward and columns whose names clash."""

from __future__ import annotations

import pytest

import corpus_pipeline
from lumenfold.llm import scratch

SCHEMA = ("doc_id long, text string, lang string, n_chars int, _row int, _null int, _score double, _predicted int, rest string, spans string, "
          "others string, `no text` string, row string, kept string, content string")
EXTRA = ("en", 3, 1, 2, 0.5, 0, "r", "s", "o", "n", "w", "k", "c")


def _text(k, n=120):
    return " ".join(f"word{(k * 131 + i * i) % 9973}" for i in range(n)) + "."


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    passage = " ".join(f"shared{i}" for i in range(60))
    bench = " ".join(f"bench{i}" for i in range(12))
    rows = [(i, _text(i)) for i in range(60)]
    rows += [(100, _text(1)), (None, _text(2)), (None, _text(70)), (None, _text(71)), (7, _text(72)), (7, _text(73)), (None, None), (8, None), (9, ""), (10, " \n")]
    rows += [(200, f"{_text(80)} {passage}"), (201, f"{_text(81)} {passage}"), (202, f"{_text(82)} {bench} {_text(83)}"), (203, _text(90, 9000))]
    rows += [(300 + i, " ".join(f"###{w}***" for w in _text(200 + i).split())) for i in range(12)]
    spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(300 + i, 0, 0) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_keeps_all_columns(spark, sf_dir):
    docs = scratch.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all((r["_row"], r["_null"], r["_score"], r["rest"], r["others"], r["no text"]) == (1, 2, 0.5, "r", "o", "n") for r in rows), name
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.columns == docs.columns and empty.count() == 0, name


def test_stages_decide_as_they_should(spark, sf_dir):
    docs = scratch.table(spark, sf_dir, "documents")
    near = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()
    ids = [r["doc_id"] for r in near]
    assert 100 not in ids and {1, 2, 200, 201, 203} <= set(ids) and ids.count(7) == 3
    assert sum(not (r["text"] or "").split() for r in near) == 1
    cut = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, docs, sf_dir).collect() if r["doc_id"] in (8, 9, 200, 201, 203)}
    assert cut[8]["text"] is None and cut[9]["text"] == "" and cut[203]["n_chars"] == len(_text(90, 9000))
    assert all("shared30" not in cut[i]["text"] and cut[i]["n_chars"] == len(cut[i]["text"]) for i in (200, 201))
    clean = {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, sf_dir).collect()}
    assert 202 not in clean and {None, 7, 8, 9, 200} <= clean


def test_the_whole_pipeline_packs_what_is_left(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in rows}
    assert {0, 1, 59, 203} <= ids and not {100, 202} & ids and not {300 + i for i in range(12)} & ids
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 4096 for x in by.values())
    assert all(sorted(x)[k][0] == sum(n for _, n in sorted(x)[:k]) for x in by.values() for k in range(len(x)))
