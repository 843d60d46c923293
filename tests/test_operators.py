from __future__ import annotations

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.operators import classes as cls
from lumenfold.operators import convert, detection, episodes, metrics, mixing
from lumenfold.operators.conversations import validate
from lumenfold.operators.entities import flatten_sentences
from lumenfold.operators.ranking import block_range, hash_range, pick_by_rank, rank_by_hash, ranges_for, with_rank
from lumenfold.plans import corpora
from lumenfold.sources import readers, sinks
from lumenfold.streaming.rows import convert_stream, read_record_stream

ASK = ["<image> <question>"]


def records(spark, ddl, *rows):
    lines = spark.createDataFrame([(json.dumps({"row_id": n, **r}),) for n, r in enumerate(rows)], "value string")
    return lines.select(F.from_json("value", f"row_id bigint, {ddl}").alias("r")).select("r.*")


def said(df):
    return [[(t["from"], t["value"], t["boxes_seq"], t["points_seq"]) for t in r.conversations] for r in df.orderBy("row_id").collect()]


# Converters: literal cases.


def test_gqa_spans_and_shared_boxes(spark):
    objects = {"1": {"x": 1, "y": 2, "w": 3, "h": 4}, "2": {"x": 0, "y": 0, "w": 5, "h": 5}, "3": {"x": 1, "y": 2, "w": 3, "h": 4}}
    row = {
        "imageId": "7", "question": "Is the  red cup here?", "answer": "yes", "fullAnswer": "Yes, the cup is here.",
        "semanticStr": "select: cup (1,2)->exist: ? (-) ", "objects": objects,
        "annotations": {"question": {"2:4": "2", "1": "1,3"}, "fullAnswer": {"0:2": "3"}},
    }
    df = records(spark, S.GQA + ", " + S.GQA_SCENE, row)
    (q, a), = said(convert.gqa(df, "qb-bl", ASK))
    assert q[1] == "<image> Is the<boxes> red cup<boxes> here?" and q[2] == [[1], [0, 0]]
    assert a[1] == "thecup<boxes>ishere.The answer is yes." and a[2] == [[0]]
    assert convert.gqa(df, "qb-bl", ASK).first().target.boxes == [[1, 2, 4, 6], [0, 0, 5, 5]]
    (q, a), = said(convert.gqa(df, "q-bs", ASK))
    assert a[1] == "select: cup<boxes>->exist: ?. The answer is yes." and a[2] == [[0, 1]] and q[2] == []
    (_, a), = said(convert.gqa(df, "q-bl", ASK, join_with=" "))
    assert a[1].startswith("the cup<boxes> is here.")
    lost = df.withColumn("objects", F.map_filter("objects", lambda k, v: k != F.lit("2")))
    with pytest.raises(Exception, match="not in the scene"):
        said(convert.gqa(lost, "q-bs", ASK))
    with pytest.raises(ValueError):
        convert.gqa(df, "x-a", ASK)


def test_clevr_empty_answer_list(spark):
    step = lambda f, i, v, a: {"function": f, "inputs": i, "value_inputs": v, "ans": a}
    row = {
        "image_index": 0, "image_filename": "a.png", "question": "q?", "answer": "no",
        "program": [step("scene", [], [], [0, 1]), step("filter_color", [0], ["red"], []), step("exist", [1], None, None),
                    step("unique", [0], None, [1, 0])],
        "objects": [{"pixel_coords": [1, 2, 3]}, {"pixel_coords": [4, 5, 6]}],
    }
    df = records(spark, S.CLEVR + ", " + S.CLEVR_SCENE, row)
    (_, a), = said(convert.clevr(df, "q-bs", ASK))
    assert a[1] == "scene -> filter_color:red[0] Found no object. -> exist[1] -> unique[0]<points> The answer is no."
    assert a[3] == [[0, 1]]
    assert convert.clevr(df, "q-bs", ASK).first().target.points == [[4, 5], [1, 2]]


def test_vcr_choices_are_cut_to_seven_letters(spark):
    choices = [json.dumps([f"c{i}", [i % 2]]) for i in range(8)]
    row = {
        "img_fn": "x.jpg", "boxes": [[1, 2, 3, 4, 0.9], [0, 0, 1, 1, 0.5]], "question": json.dumps(["Why", "[0]", [0, 1], "?"]),
        "answer_choices": choices, "rationale_choices": choices, "answer_label": 1, "rationale_label": 2,
    }
    df = records(spark, S.VCR, row)
    (q, a), = said(convert.vcr(df, "qc-a", ASK))
    assert "QUESTION: Why [0] <boxes> ? \nOPTIONS: (A) c0 <boxes> (B) c1 <boxes>" in q[1] and "(G) c6" in q[1] and "c7" not in q[1]
    assert q[2] == [[0, 1]] + [[i % 2] for i in range(7)]
    assert a[1] == "The answer is (B)." and a[2] == []
    assert convert.vcr(df, "q-a", ASK).first().target.boxes == [[1, 2, 3, 4], [0, 0, 1, 1]]
    pred = convert.vcr_pred(df, "qac-r", ASK)
    assert [r.row_id for r in pred.orderBy("row_id").collect()] == [0, 1, 2, 3]
    assert "ANSWER: c3 <boxes>" in said(pred)[3][0][1] and said(pred)[3][1][1].startswith("The answer is (A).WARNING")


def test_v7w_unknown_answer_raises(spark):
    row = {"file_path": "x", "question": "q", "candidates": [[1, 1, 2, 2], [1, 1, 2, 2]], "point": [1, 1], "answer": [1, 1, 2, 2]}
    df = records(spark, S.V7W, row, {**row, "answer": [9, 9, 9, 9]})
    (q, a), = said(convert.v7w_point(df.where("row_id = 0"), "b", ASK))
    assert a[2] == [[0]] and sorted(q[2]) == [[0], [1]]
    with pytest.raises(Exception, match="not a candidate"):
        said(convert.v7w_point(df, "b", ASK))


def test_validation(spark):
    ok = convert.rec(records(spark, S.EXPRESSION, {"img_path": "a", "expression": "x", "bbox": [0, 0, 1, 1]}), ["<expr> <image>?"])
    assert validate(ok).first().problem is None
    bad = ok.withColumn("target", F.lit(None).cast(S.TARGET))
    assert validate(bad).first().problem == "box placeholder without boxes"
    with pytest.raises(Exception, match="invalid item"):
        validate(bad, "raise").collect()


# Interleaving: the worked cases for lengths 3, 4, 5 (offsets 0, 3, 7).


def three(spark):
    return [spark.range(n).select(F.col("id").alias("row_id")) for n in (3, 4, 5)]


def order_of(df):
    offsets = {0: 0, 1: 3, 2: 7}
    return [offsets[r.source] + r.row_id for r in df.orderBy("mix_id").collect()]


def test_interleave_worked_cases(spark):
    assert order_of(mixing.interleave(three(spark))) == [0, 3, 7, 1, 4, 8, 2, 5, 9]
    assert order_of(mixing.interleave(three(spark), mixing.ALL)) == [0, 3, 7, 1, 4, 8, 2, 5, 9, 0, 6, 10, 1, 3, 11]
    assert order_of(mixing.concat(three(spark))) == list(range(12))


@pytest.mark.parametrize("stopping", [mixing.FIRST, mixing.ALL])
def test_chance_interleave_is_the_sequential_loop(spark, stopping):
    sizes, p = [3, 4, 5], [0.2, 0.3, 0.5]
    plan = mixing.draw_plan(spark, sizes, p, 3, stopping).orderBy("mix_id").collect()
    drawn = [r.source for r in mixing._draws(spark, 500, p, 3).orderBy("mix_id").collect()]
    at, done, want = [0, 0, 0], [False] * 3, []
    for s in drawn:
        if (all if stopping == mixing.ALL else any)(done):
            break
        want.append((s, at[s]))
        at[s] += 1
        if at[s] == sizes[s]:
            at[s], done[s] = 0, True
    assert [(r.source, r.row_id) for r in plan] == want


def test_mixture_checks(spark):
    with pytest.raises(ValueError, match="2 sources but 1"):
        mixing.Mixture(("a", "b"), (1.0,))
    with pytest.raises(ValueError, match="never exhausted"):
        mixing.draw_plan(spark, [1, 1], [1.0, 0.0], 0, mixing.ALL)
    assert len(corpora.GQA) == 21 and len(corpora.VCR) == 9 and len(corpora.POINTS) == 14
    assert len(corpora.MIX_ONE.sources) == 22 and len(corpora.MIX_TWO.sources) == 23
    assert set(corpora.SHARED_SOURCES) <= set(corpora.VARIANTS) | set(corpora.TWENTIETHS)


def test_subset_sizes(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"))
    got = mixing.subset(df, 0.1234, seed=5)
    assert got.count() == 123
    assert sorted(r.row_id for r in got.collect()) == sorted(r.row_id for r in mixing.subset(df.repartition(7), 0.1234, seed=5).collect())
    assert mixing.subset(df, 1.0).count() == 1000
    assert [r.row_id for r in mixing.subset(df, 0.003, shuffle=False).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        mixing.subset(df, 0)


def test_rank_of_a_hot_group(spark):
    from lumenfold.functions.draws import order60

    df = spark.range(3000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 5).alias("g"), order60(F.col("id")).alias("h"), "id")
    got = with_rank(df, ["g"], ["h"], hash_range(F.col("h"), 16)).collect()
    for g in {r.g for r in got}:
        ordered = sorted((r for r in got if r.g == g), key=lambda r: r.h)
        assert [r["rank"] for r in ordered] == list(range(len(ordered)))
    # Ranges follow the largest group.
    by_hash = rank_by_hash(df, ["g"], ["h"], "rank", rows=100).collect()
    assert sorted((r.id, r["rank"]) for r in by_hash) == sorted((r.id, r["rank"]) for r in got)
    assert df.select(ranges_for(df, ["g"], 100).alias("n")).first().n == 26
    total = with_rank(df, [], ["id"], block_range(F.col("id"), 100)).collect()
    assert all(r["rank"] == r.id for r in total)


# Classes and episodes.


def class_records(spark):
    rows = [{"class_id": str(c), "class_name": f"Name {c}", "samples": [f"{c}_{i}" for i in range(4)],
             "neighbors": [{"id": str((c + k) % 6), "name": f"Name {(c + k) % 6}", "img": f"stored_{(c + k) % 6}"} for k in (1, 2, 3)]} for c in range(6)]
    return records(spark, S.CLASS_TRAIN, *rows)


def test_weight_episode_shape(spark):
    df = class_records(spark)
    rows = episodes.two_way_weight(df, ASK, 3, seed=1).collect()
    assert sorted(map(str, rows)) == sorted(map(str, episodes.two_way_weight(df.repartition(5), ASK, 3, seed=1).collect()))
    for r in rows:
        assert len(r["items"]) == 7
        assert [i["mode"] for i in r["items"]] == ["causal_v1.0"] + ["hypnotized_ans_v1.0"] * 5 + ["final_v1.0"]
        own = [i for i in r["items"][:-1] if i["image"].startswith(f"{r.class_id}_")]
        other = [i for i in r["items"][:-1] if i not in own]
        assert len(own) == 3 and len({i["answer"] for i in own}) == 1 and len({i["answer"] for i in other}) == 1
        assert sum(i["image"].startswith("stored_") for i in other) == 1
        query = r["items"][-1]
        assert query["answer"] + " [END EXAMPLE]" in {own[0]["answer"], other[0]["answer"]}
        assert (query["image"].startswith(f"{r.class_id}_")) == (query["answer"] + " [END EXAMPLE]" == own[0]["answer"])


def test_epochs_are_the_single_epochs_together(spark):
    df = class_records(spark).drop("row_id")
    both = episodes.two_way_weight(episodes.over_epochs(df, 2), ASK, 2, epoch=F.col("epoch"))
    each = episodes.two_way_weight(df, ASK, 2, epoch=0).union(episodes.two_way_weight(df, ASK, 2, epoch=1))
    assert sorted(map(str, both.collect())) == sorted(map(str, each.collect())) and both.count() == 12


def test_ref_episode_answers_with_the_right_side(spark):
    for legacy in (False, True):
        for r in episodes.two_way_ref(class_records(spark), 4, seed=2, legacy=legacy).collect():
            *support, query = r["items"]
            name = lambda i: i["answer"].split('"')[1]
            is_own = lambda i: i["image"].startswith(f"{r.class_id}_")
            same = [name(i) for i in support if is_own(i) == (is_own(query) != legacy)]
            word = name(support[0]).split("_")[1]
            assert query["answer"] == str(same) + "._" + word
    with pytest.raises(ValueError):
        episodes.two_way_ref(class_records(spark), 2)


def test_unknown_neighbour_raises(spark):
    with pytest.raises(Exception, match="not a class"):
        episodes.two_way_weight(class_records(spark).where("class_id < 3"), ASK, 2).collect()


def test_tile_plans_cover_the_image_once(spark):
    df = spark.range(60).select(F.col("id").alias("class_id"), F.concat(F.lit("i"), "id").alias("image"), F.lit(101).alias("width"), F.lit(67).alias("height"))
    seen = set()
    for r in episodes.tile_plan(df).collect():
        n = len(r.tiles)
        cols, rows = max(t.col for t in r.tiles) + 1, max(t.row for t in r.tiles) + 1
        seen.add((cols, rows))
        assert n == cols * rows and len({(t.col, t.row) for t in r.tiles}) == n
        assert all(t.x2 - t.x1 == 101 // cols and t.y2 - t.y1 == 67 // rows for t in r.tiles)
        assert r.answer == "The order is: " + str([[t.col, t.row] for t in r.tiles]) + "."
    assert len(seen) == 7


def test_odd_class_count_raises(spark):
    rows = [{"class_id": str(c), "class_name": f"N{c}", "context_samples": ["a", "b"], "test_samples": [f"t{c}"]} for c in range(3)]
    df = records(spark, S.CLASS_TEST, *rows)
    index = episodes.eval_index_from_lists(df)
    assert index.count() == 3
    with pytest.raises(Exception, match="no partner"):
        episodes.eval_two_way(index, df, 2).collect()
    assert len(episodes.eval_two_way(index, df.where("row_id < 2"), 2).collect()) == 2
    with pytest.raises(Exception, match="fewer than 3"):
        episodes.eval_two_way(index, df.where("row_id < 2"), 3).collect()


def test_episode_prompt_drops_inner_end_marks(spark):
    p = episodes.prompts(episodes.two_way_weight(class_records(spark), ASK, 2)).first().prompt
    assert p.startswith("You should find the causal relationship") and p.count("</s>") == 2 and p.endswith("</s>")
    assert "[FINAL QUESTION]:  USER: <image> <question> ASSISTANT: there is" in p


def test_similarity_blocks_agree(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 9, 4))
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(9)], "class_id int, image_vec array<double>, text_vec array<double>")
    u = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    i, t = u(a), u(b)
    want = 0.5 * t @ t.T + 0.8 * (i @ t.T + t @ i.T) + 0.5 * i @ i.T
    for blocks in (1, 3, 4):
        got = {(r.a, r.b): r.score for r in cls.similarity(df, blocks).collect()}
        assert len(got) == 81 and all(abs(got[x, y] - want[x, y]) < 1e-5 for x in range(9) for y in range(9))


def test_train_pair_bins_are_checked(spark):
    ranked = spark.range(1).select(F.lit("0").alias("class_id"), F.lit(0).alias("rank"), F.lit("0").alias("neighbor_id"))
    images = spark.range(1).select(F.lit("0").alias("class_id"), F.lit("n").alias("class_name"), F.lit("i").alias("image"))
    with pytest.raises(ValueError, match="do not fit"):
        cls.train_pairs(ranked, images, 36, 1, n_classes=100)
    with pytest.raises(ValueError, match="first of 36 bins"):
        cls.train_pairs(ranked, images, 36, 1, n_classes=36)


def test_train_pairs_name_classes_without_images(spark):
    ids = ["a", "b", "c", "d"]
    rows = [(x, n, y) for x in ids for n, y in enumerate([x] + [y for y in ids if y != x])]
    ranked = spark.createDataFrame(rows, "class_id string, rank int, neighbor_id string")
    images = spark.createDataFrame([(x, f"name {x}", f"{x}{n}") for x in ids[:3] for n in range(3 if x != "c" else 1)], "class_id string, class_name string, image string")
    got = {r.class_id: r for r in cls.train_pairs(ranked, images, 2, 2, strict=False).collect()}
    assert set(got) == set(ids) and got["d"].problem == "no images" and got["c"].problem == "fewer than 2 images"
    for r in got.values():
        full = sum(n.img is not None for n in r.neighbors) == 2
        assert len(r.neighbors) == 2 and (r.problem is None) == (full and r.class_id in "ab")
    with pytest.raises(Exception, match="class d: no images|fewer than 2"):
        cls.train_pairs(ranked, images, 2, 2).collect()


def test_chunked_class_lists_keep_every_image(spark):
    df = spark.range(25).select(F.lit("c").alias("class_id"), F.lit("n").alias("class_name"), F.col("id").alias("pos"), F.concat(F.lit("i"), "id").alias("image"))
    rows = cls.list_records(df, ["pos"], 10, "images").orderBy("chunk").collect()
    assert [len(r.images) for r in rows] == [10, 10, 5] and sum((r.images for r in rows), []) == [f"i{n}" for n in range(25)]


# Detection.


def detection_tables(spark):
    images = spark.createDataFrame([(n, f"{n}.jpg", 100, 80) for n in range(4)], "id bigint, file_name string, width int, height int")
    marks = [(0, 0, 1, [90.0, 10.0, 30.0, 5.0]), (1, 0, 2, [0.0, 0.0, 5.0, 5.0]), (2, 1, 2, [1.0, 1.0, 2.0, 2.0]), (3, 2, 3, [1.0, 1.0, 2.0, 2.0]), (4, 3, 1, [9.0, 9.0, 1.0, 1.0])]
    ann = spark.createDataFrame(marks, "id bigint, image_id bigint, category_id bigint, bbox array<double>")
    cats = spark.createDataFrame([(c, f"cat {c}") for c in (1, 2, 3, 4)], "id bigint, name string")
    nb = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 2, 4), (2, 0, 3), (3, 0, 4)], "category_id bigint, pos int, neighbor_id bigint")
    expired = spark.createDataFrame([(3,)], "image_id bigint")
    return cats, ann, images, nb, expired


def test_detection_episode(spark):
    cats, ann, images, nb, expired = detection_tables(spark)
    assert [r.id for r in detection.usable_categories(cats, ann).orderBy("id").collect()] == [1, 2, 3]
    chosen = {r.category_id: r.neighbor_id for r in detection.choose_neighbour(cats, ann, nb).collect()}
    # The only neighbour of 3 has no image, so it gets any other usable category.
    assert chosen[1] in (2, 3) and chosen[2] == 3 and chosen[3] in (1, 2)
    assert {r.id for r in detection.without_neighbour(cats, detection.choose_neighbour(cats, ann, nb)).collect()} == {4}
    kinds = set()
    for epoch in range(12):
        for r in detection.episodes(cats, ann, images, nb, expired, ["find <expr>"], 2, epoch=epoch).collect():
            assert r["problem"] is None
            *support, query = r["items"]
            assert len(support) == 4 and support[0]["mode"] == "hypnotized_v1.0" and query["mode"] == "hypnotized_v1.1"
            assert all(i["image"] != "3.jpg" for i in r["items"])
            assert all(len(i["boxes"]) == 1 for i in support)
            if r.category_id == 1:
                assert support[0]["boxes"] == [[90.0, 10.0, 100.0, 15.0]]
            word = support[0]["answer"].split("is ")[1].rstrip(".")
            kinds.add((query["answer"], query["question"] == f"[INFERENCE] find {word}"))
            assert (query["boxes"] is None) == (query["answer"] == "The target object does not exist.")
    assert kinds == {("<boxes>.", True), ("<boxes>.", False), ("The target object does not exist.", True)}


def test_detection_gives_a_row_or_a_reason_for_every_usable_category(spark):
    cats, ann, images, nb, _ = detection_tables(spark)
    expired = spark.createDataFrame([(2,)], "image_id bigint")  # the only image of 3
    full = ann.unionByName(spark.createDataFrame([(9, 1, 1, [1.0, 1.0, 2.0, 2.0]), (10, 1, 3, [1.0, 1.0, 2.0, 2.0])], ann.schema))
    for epoch in range(6):
        made = {r.category_id: r for r in detection.episodes(cats, ann, images, nb, expired, ["find <expr>"], 2, epoch=epoch).collect()}
        assert set(made) == {1, 2, 3} and made[3].problem == made[2].problem == detection.NO_IMAGE and made[3]["items"] is None
        single = {r.category_id: r for r in detection.plain_items(cats, ann, images, nb, expired, epoch=epoch).collect()}
        assert set(single) == {1, 2, 3} and all((r["item"] is None) == (r.problem is not None) for r in single.values())
        # An image that shows every usable category leaves nothing to choose.
        one_image = full.where("image_id = 1")
        none = detection.episodes(cats, one_image, images, nb, expired, ["find <expr>"], 2, epoch=epoch).collect()
        assert {(r.category_id, r.problem) for r in none} == {(c, detection.NO_NEIGHBOUR) for c in (1, 2, 3)}


# Metrics.


def test_iou_zero_boxes_are_not_correct(spark):
    z = "[0.000,0.000,0.000,0.000]"
    df = spark.createDataFrame([(0, "none", z), (1, "[0.1,0.1,0.5,0.5]", "[0.1,0.1,0.5,0.5]"), (2, "x", "bad")], "row_id int, pred string, target string")
    r = metrics.report(metrics.score_iou(df)).first()
    assert (r.n, r.n_correct, r.failed, r.target_failed, r.iou) == (3, 1, 1, 1, 1.0)


def test_containment(spark):
    df = spark.createDataFrame(
        [(0, "there is a cat", 'there is "Cat" in the image.', "dog"), (1, "cat or dog", "cat", "dog"), (2, "Cat", "cat", "dog"), (3, "a catdog", "cat", "dog")],
        "row_id int, pred string, target string, negative string")
    assert [r.correct for r in metrics.score_containment(df).orderBy("row_id").collect()] == [True, False, False, False]


def test_pair_negative_without_match(spark):
    pairs = spark.createDataFrame([(0, "A", "B"), (1, "A", "A")], "row_id bigint, positive_promt string, negative_promt string")
    df = spark.createDataFrame([(0, "b"), (1, "a")], "row_id bigint, target string")
    assert [r.negative for r in metrics.with_own_negative(df, pairs).orderBy("row_id").collect()] == ["a", None]


# Files.


def test_line_numbers_over_blocks_and_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"a{n}\n" for n in range(3000)))
    (tmp_path / "b.txt").write_text("".join(f"b{n}\n" for n in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.value: r.line_no for r in readers.number_lines(spark, str(tmp_path)).collect()}
        each = {r.value: r.line_no for r in readers.number_lines(spark, str(tmp_path), per_file=True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {**{f"a{n}": n for n in range(3000)}, **{f"b{n}": 3000 + n for n in range(500)}}
    assert each == {**{f"a{n}": n for n in range(3000)}, **{f"b{n}": n for n in range(500)}}


def test_flatten_entities_from_files(spark, tmp_path):
    (tmp_path / "s").mkdir(), (tmp_path / "x").mkdir()
    (tmp_path / "s" / "11.txt").write_text("[/EN#5/people A man] and [/EN#7/other a dog] near [/EN#5/people the man] .\n\nNo phrase .\n")
    box = lambda *v: "<bndbox>" + "".join(f"<{k}>{n}</{k}>" for k, n in zip(("xmin", "ymin", "xmax", "ymax"), v)) + "</bndbox>"
    (tmp_path / "x" / "11.xml").write_text(
        "<annotation><size><width>9</width><height>8</height><depth>3</depth></size>"
        f"<object><name>7</name>{box(1, 2, 3, 4)}</object><object><name>5</name><name>6</name>{box(5, 5, 6, 6)}</object>"
        f"<object><name>5</name>{box(2, 2, 4, 4)}</object><object><name>8</name><scene>1</scene><nobndbox>0</nobndbox></object></annotation>")
    objects = readers.entity_objects(spark, str(tmp_path / "x"))
    got = {(r.image_id, r.box_id, str(r.box), r.nobox, r.scene) for r in objects.collect()}
    assert ("11", "6", "[4, 4, 5, 5]", False, False) in got and ("11", "8", "None", False, True) in got and len(got) == 5
    rows = flatten_sentences(readers.entity_sentences(spark, str(tmp_path / "s")), objects).orderBy("sentence_no").collect()
    assert [r.sentence_no for r in rows] == [0, 2]
    assert rows[0].sentence == "<ph_st>A man<ph_ed> and <ph_st>a dog<ph_ed> near <ph_st>the man<ph_ed> ."
    assert rows[0].boxes == [[4, 4, 5, 5], [1, 1, 3, 3], [0, 1, 2, 3]] and rows[0].boxes_seq == [[0, 1], [2], [0, 1]]
    assert rows[1].boxes == [] and rows[1].sentence == "No phrase ."


def _png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + b"\0\0\0" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_sizes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.png").write_bytes(_png(7, 5))
    assert tuple(readers.image_sizes(spark, str(tmp_path / "sub")).select("image_id", "width", "height").first()) == ("a.png", 7, 5)
    assert readers.image_sizes(spark, str(tmp_path / "sub"), folder=str(tmp_path)).first().image_id == "sub/a.png"
    (tmp_path / "sub" / "b.png").write_bytes(b"no image")
    sizes = readers.image_sizes(spark, str(tmp_path / "sub"))
    assert {tuple(r) for r in sizes.select("image_id", "width", "problem").collect()} == {("a.png", 7, None), ("b.png", None, "file cut short")}
    items = spark.createDataFrame([("a.png",), ("b.png",), ("c.png",), (None,)], "image string")
    flagged = {r.image: (r.width, r.size_problem is not None) for r in readers.with_sizes(items, sizes, "flag").collect()}
    assert flagged == {"a.png": (7, False), "b.png": (None, True), "c.png": (None, True), None: (None, False)}
    with pytest.raises(Exception, match="image without a size"):
        readers.with_sizes(items, sizes).collect()


def test_scratch_folder(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from lumenfold.session import scratch_dir

    assert scratch_dir(spark, str(tmp_path)).startswith(str(tmp_path))
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    context = lambda master, folder: SimpleNamespace(master=master, getCheckpointDir=lambda: folder)
    bare = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context(master, folder))
    assert scratch_dir(bare("spark://host:7077", "hdfs:/shared")).startswith("hdfs:/shared/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(bare("spark://host:7077"))


def test_templates(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(["a", "b", "a"]))
    assert readers.load_templates(spark, template_file=str(path), max_dynamic_size=2) == ["a", "b"]
    assert readers.load_templates(spark, template_string="x") == ["x"]
    with pytest.raises(ValueError):
        readers.load_templates(spark)
    with pytest.raises(ValueError):
        readers.load_templates(spark, "a", str(path))
    assert [tuple(r) for r in readers.template_table(spark, str(path)).orderBy("pos").collect()] == [("t", 0, "a"), ("t", 1, "b"), ("t", 2, "a")]


def test_ranked_file_has_the_header(spark, tmp_path):
    df = spark.createDataFrame([("1", 0, "1"), ("1", 1, "2"), ("2", 0, "2"), ("2", 1, "1")], "class_id string, rank int, neighbor_id string")
    sinks.write_ranked(df.coalesce(1), str(tmp_path / "r"))
    lines = [line for f in (tmp_path / "r").glob("part*") for line in f.read_text().splitlines()]
    assert sinks.RANK_HEADER in lines and "1,1,2" in lines and "2,2,1" in lines
    assert readers.ranked_neighbours(spark, str(tmp_path / "r")).count() == 4


def test_scene_arguments(spark):
    with pytest.raises(ValueError):
        readers.scenes_by_index(spark.range(1), spark.range(1), None)


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"row_id": n, "img_path": f"{n}.jpg", "expression": f"thing {n}", "bbox": [0, 0, n, n]} for n in range(20)]
    (tmp_path / "in").mkdir()
    for part in range(4):
        (tmp_path / "in" / f"{part}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[part::4]))
    ddl = f"row_id bigint, {S.EXPRESSION}"
    job = lambda df: convert.rec(df, ["<expr> <image>?", "Find <expr>. <image>"])
    stream = read_record_stream(spark, str(tmp_path / "in"), ddl, files_per_batch=1)
    query = convert_stream(stream, job, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("row_id").collect()
    assert got == job(spark.read.schema(ddl).json(str(tmp_path / "in"))).orderBy("row_id").collect() and len(got) == 20


def test_cycles_in_several_chunks_give_the_same_mixture(spark, monkeypatch):
    sets = [spark.range(n).select(F.col("id").alias("row_id")) for n in (1, 4, 23)]
    want = [(3 * r + n, n, r % size) for r in range(23) for n, size in enumerate((1, 4, 23))]
    for turns in (mixing.TURNS, 5):
        monkeypatch.setattr(mixing, "TURNS", turns)
        got = mixing.interleave(sets, mixing.ALL).select("mix_id", "source", "row_id").collect()
        assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("rule", [mixing.FIRST, mixing.ALL])
def test_chance_mixture_over_several_blocks(spark, rule):
    sizes, p = [70000, 40000], [0.5, 0.5]
    got = [tuple(r) for r in mixing.draw_plan(spark, sizes, p, 3, rule).orderBy("mix_id").collect()]
    taken, want, out = [0, 0], [], [False, False]
    for r in mixing._draws(spark, 200000, p, 3).orderBy("mix_id").collect():
        n = r["source"]
        want.append((r["mix_id"], n, taken[n] % sizes[n]))
        taken[n] += 1
        out[n] |= taken[n] == sizes[n]
        if any(out) if rule == mixing.FIRST else all(out):
            break
    assert got == want and len(got) > 65536


@pytest.mark.parametrize("rows", [65536, 7])
def test_draws_by_rank(spark, rows):
    pool = spark.range(200).select((F.col("id") % 3 * (F.col("id") % 7 > 0).cast("int")).alias("of"), "id", F.xxhash64("id").alias("x"))
    pool = pool.select("of", F.pmod("x", F.lit(1 << 60)).alias("_h"), "id")
    draws = spark.createDataFrame([(n, n % 4 if n % 9 else None) for n in range(60)], "n bigint, of bigint")
    got = {r["n"]: r["id"] for r in pick_by_rank(draws, pool, ["of"], ["_h", "id"], lambda size: F.pmod(F.col("n") * 5, size), rows).collect()}
    groups = {}
    for r in sorted(pool.collect(), key=lambda r: (r["_h"], r["id"])):
        groups.setdefault(r["of"], []).append(r["id"])
    want = {r["n"]: groups[r["of"]][r["n"] * 5 % len(groups[r["of"]])] if r["of"] in groups else None for r in draws.collect()}
    assert got == want and 3 not in groups


def test_scene_index_is_read_in_pieces(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({f"im {n}\"": n for n in range(50)}, indent=1))
    (tmp_path / "b.json").write_text("{}")
    got = {r["imageId"]: r["line"] for r in readers.read_scene_index(spark, f"file://{tmp_path}").collect()}
    assert got == {f'im {n}"': n for n in range(50)}
    (tmp_path / "c.json").write_text('{"a,b": 1}')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.read_scene_index(spark, f"file://{tmp_path}").collect()


def test_empty_neighbour_list_is_named(spark):
    from lumenfold.functions.draws import falling_weight_index

    with pytest.raises(Exception, match="ranked list is empty"):
        spark.range(1).select(falling_weight_index(F.size(F.array()), 1)).collect()
