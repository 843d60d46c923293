"""Decision lists: statistics against brute force, rules found again, held-out accuracy."""

from __future__ import annotations

import re
import zlib
from collections import Counter


from pyspark.sql import functions as F

from lumenfold.llm import rules, scratch

SCHEMA = "doc_id long, text string, bad string, windows int, symbol_share string"
LABELS = "doc_id long, quality int, toxic int, text string"
WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c a b c", "a a a a a", "x y\nx y\n\n \nx y\r\nx y", "ä | ö\x0b& <ü> 😀 😀 😀 😀",
    " ".join(f"w{i % 50}" for i in range(5000)), " ".join(f"w{i}" for i in range(20000)) + "\n" + " ".join(f"w{i}" for i in range(30)),
    "no-break space is part of a word", "ab c ab c abc a bc",
]


def test_statistics_equal_brute_force(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1, "y"), (3, "other text of id 3", "x", 1, "y")]
    got = rules.statistics(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r["doc_id"], *[r[c] for c in rules.BASE]) for r in got) == Counter((i, *brute(t)) for i, t, *_ in rows)


def _planted(n=900):
    rows, labels = [], []
    for i in range(n):
        words = [f"w{(i * 7 + k * k) % 997}x{k}" for k in range(80)]
        bad = i % 4 == 0
        if bad:
            words = [w + "###" for w in words] if i % 8 == 0 else [w.upper() + "Z" for w in words]
        rows.append((i, " ".join(words), "x", 1, "y"))
        labels.append((i, int(not bad), 0, "z"))
    return rows, labels


def test_rules_find_what_was_planted_on_ids_not_seen(spark):
    rows, labels = _planted()
    extra = [(None, 0, 0, "z"), (1, None, 0, "z"), (2, 1, 0, "z"), (2, 0, 0, "z"), (5, 7, 0, "z")]
    got = rules.apply_rules(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + extra, LABELS)).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) == len(rows) and len(held) > 100
    assert not any(r["base_failed"] for r in got)
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in held)


def test_held_out_labels_are_never_read(spark):
    rows, labels = _planted(300)
    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t, x) for i, q, t, x in labels]
    docs = spark.createDataFrame(rows, SCHEMA)
    stats = scratch.keep(rules.statistics(docs))
    one, two = (rules.fit(stats, spark.createDataFrame(x, LABELS)) for x in (labels, wrong))
    assert one == two and one


def test_without_labels_or_documents(spark):
    none, docs = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "w " * 60, "x", 1, "y"), (1, None, "x", 1, "y"),
                                                                          (2, " ".join(map(str, range(50))), "x", 1, "y")], SCHEMA)
    empty = spark.createDataFrame([], LABELS)
    got = sorted(tuple(r) for r in rules.apply_rules(docs, empty).select("doc_id", "n_words", "base_failed", "kept").collect())
    assert got == [(1, 0, True, False), (1, 60, True, False), (2, 50, False, True)]
    assert rules.apply_rules(none, spark.createDataFrame([(1, 0, 0, "z")], LABELS)).count() == 0
    only_good = spark.createDataFrame([(2, 1, 0, "z")], LABELS)
    assert [r["kept"] for r in rules.apply_rules(docs, only_good).filter("doc_id = 2").collect()] == [True]


def test_a_list_is_one_ordered_expression(spark):
    cut = lambda f, above, t: rules.Condition(f, above, t)
    some = [rules.Rule((cut("id", True, 5), cut("id", False, 7))), rules.Rule((cut("id", True, 8),))]
    assert [str(r) for r in some] == ["id > 5 and id <= 7", "id > 8"]
    got = spark.range(10).select("id", rules.decision(some).alias("keep")).filter(~F.col("keep")).collect()
    assert [r["id"] for r in got] == [6, 7, 9]
    assert spark.range(1).select(rules.decision([]).alias("k")).first()["k"] is True



def test_pruning_takes_the_shortest_best_prefix(spark):
    rows = spark.createDataFrame([(1, True, 9, 9), (2, True, 9, 1), (3, False, 1, 9)], "doc_id long, bad boolean, a long, b long")
    grown = [rules.Condition("a", True, 5), rules.Condition("b", True, 5)]
    rule, hits, misses = rules._prune(rows, grown)
    assert (len(rule.conditions), hits, misses) == (1, 2, 0)


def test_the_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1, "y")], SCHEMA)
    plan = rules.statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
