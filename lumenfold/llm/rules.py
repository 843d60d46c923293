"""Learned decision lists over document statistics, by Spark functions alone.

Every statistic is an integer column of built-in functions over the whole text. A list of rules is
learned by sequential covering: a rule grows condition by condition on two thirds of the labelled
rows, is pruned on the other third, and the rows it covers leave before the next one is grown. Each
step is one aggregate over all labelled rows, so that what reaches the driver is a count table of
features x cuts. The list becomes one `CASE WHEN` column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import scratch

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Condition(NamedTuple):
    feature: str
    above: bool
    cut: int

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut}"


class Rule(NamedTuple):
    """A conjunction that rejects; `hits` of the rows it covered were of the class it is for."""

    conditions: tuple[Condition, ...]
    hits: int = 0
    misses: int = 0

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def decision(rules: Sequence[Rule]) -> Column:
    """True where no rule applies; the rules are asked in their order."""
    if not rules:
        return F.lit(True)
    found = F.when(rules[0].column(), False)
    for rule in rules[1:]:
        found = found.when(rule.column(), False)
    return found.otherwise(True)


def _count_of(text: Column, letters: str) -> Column:
    """Characters of a class; removing the runs between them is far cheaper than translating each."""
    return F.length(F.regexp_replace(text, f"[^{letters}]+", "")).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the statistics, the features) of every document; a null text counts as an empty one.

    Words are `[^\\x20\\x09-\\x0D]+`. `n_repeat_words` counts words in three-word windows that the text
    holds twice or more: windows are sorted by 96 bits of hash inside their row, and the positions
    of those with an equal neighbour are swept once. No row leaves its task.
    """
    text = F.col("text")
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counted = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).select(
        "doc_id", words.alias("words"), lines.alias("lines"),
        _count_of(text, SYMBOLS).alias("n_symbols"),
        _count_of(text, "A-Z").alias("n_upper"),
        _count_of(text, "0-9").alias("n_digits"),
        _count_of(text, ".,;:!?").alias("n_marks"))
    window = lambda w, i: F.struct(
        F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("a"),
        F.hash(w, F.get("words", i + 1), F.get("words", i + 2)).alias("b"), i.alias("at"))
    heads = F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    sized = counted.select(
        "doc_id", "n_symbols", "n_upper", "n_digits", "n_marks",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(heads, window)).alias("windows"))
    same = lambda x, i: F.coalesce((F.get("windows", i)["a"] == x["a"]) & (F.get("windows", i)["b"] == x["b"]), F.lit(False))
    again = F.filter("windows", lambda x, i: same(x, i - 1) | same(x, i + 1))
    swept = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["at"])),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"].cast("long"))
    return sized.withColumn("n_repeat_words", swept).drop("windows").select("*", *[v.alias(k) for k, v in features().items()])


def features() -> dict[str, Column]:
    """Thousandths of counts, as integers, so that a threshold reads and compares exactly."""
    share = lambda a, b: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1)))
    return {
        "symbol_share": share("n_symbols", "word_chars"), "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"), "mark_share": share("n_marks", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "line_share": share("n_lines", "n_words"),
        "word_length": share("word_chars", "n_words"), "words": F.least(F.col("n_words"), F.lit(100_000)),
    }


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """`stats` rows with `bad` (label 0 of `quality`), of the ids whose crc32 is not divisible by 5.

    Labels other than 0 and 1 and ids with both count as no label; a document without an id has none.
    """
    ids = F.col("doc_id").cast("long")
    known = (
        labels.select(ids.alias("doc_id"), F.col("quality").cast("int").alias("y"))
        .filter("doc_id is not null and y in (0, 1)")
        .filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z")
        .select("doc_id", (F.col("y") == 0).alias("bad")))
    return stats.withColumn("doc_id", ids).join(known, "doc_id")


def cut_points(rows: DataFrame, names: Sequence[str], cuts: int) -> dict[str, list[int]]:
    """At most `cuts` thresholds a feature: the exact quantiles of either class."""
    at = [(i + 0.5) / cuts for i in range(cuts)]
    one = rows.agg(*[F.percentile(F.when(F.col("bad") == side, F.col(n)), at).alias(f"{n} {side}") for n in names for side in (True, False)]).first()
    found = {n: {math.floor(v) for side in (True, False) for v in one[f"{n} {side}"] or []} for n in names}
    return {n: sorted(found[n]) for n in names}


def with_slots(rows: DataFrame, points: dict[str, list[int]]) -> DataFrame:
    """`rows` with `slots`: for each feature that has cuts, how many of them lie below the row's value."""
    below = lambda n: F.size(F.filter(F.lit(points[n]).cast("array<long>"), lambda c: c < F.col(n)))
    return rows.withColumn("slots", F.array(*[below(n) for n in points if points[n]]).cast("array<int>"))


def _counts(rows: DataFrame, points: dict[str, list[int]]) -> tuple[dict[str, list[list[int]]], int, int]:
    """Bad and good rows in each interval between the cuts of each feature, and in all."""
    names = [n for n in points if points[n]]
    table = rows.select("bad", F.posexplode("slots").alias("f", "s")).groupBy("f", "s").agg(
        F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    found = {n: [[0, 0] for _ in range(len(points[n]) + 1)] for n in names}
    for r in table:
        found[names[r["f"]]][r["s"]] = [r["p"], r["n"]]
    first = next(iter(found.values()), [])
    return found, sum(p for p, _ in first), sum(n for _, n in first)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information that a condition adds about the bad rows it keeps."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(found: dict[str, list[list[int]]], points: dict[str, list[int]], p0: int, n0: int) -> tuple[float, Condition | None]:
    best: tuple[float, Condition | None] = (1e-9, None)
    for name in found:
        p = n = 0
        for k, cut in enumerate(points[name]):
            p, n = p + found[name][k][0], n + found[name][k][1]
            for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                gain = _gain(a, b, p0, n0)
                if gain > best[0]:
                    best = (gain, Condition(name, above, cut))
    return best


def learn(rows: DataFrame, names: Sequence[str], cuts: int = 32, max_rules: int = 12, max_conditions: int = 4,
          precision: float = 0.9, support: int = 5) -> list[Rule]:
    """The ordered rules, from all of `rows` (doc_id, `bad` and the features `names`).

    A rule is kept if, of the pruning rows it covers, `support` or more are bad and the share of bad
    ones, with one added to either side, reaches `precision`; the first that fails ends the list.
    Without rows of both classes there are no rules.
    """
    if not rows.head(1):
        return []
    points = cut_points(rows, names, cuts)
    rows = scratch.keep(with_slots(rows, points))
    grow_side = F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        grown: list[Condition] = []
        inside = left.filter(grow_side)
        while len(grown) < max_conditions:
            found, p0, n0 = _counts(inside, points)
            if not p0 or not n0:
                break
            _, condition = _best(found, points, p0, n0)
            if condition is None:
                break
            grown.append(condition)
            inside = inside.filter(condition.column())
        if not grown:
            break
        rule, hits, misses = _prune(left.filter(~grow_side), grown)
        if hits < support or (hits + 1) / (hits + misses + 2) < precision:
            break
        rules.append(rule)
        left = left.filter(~rule.column())
    return rules


def _prune(rows: DataFrame, grown: list[Condition]) -> tuple[Rule, int, int]:
    """The prefix of the conditions with the best (hits - misses) / (hits + misses), the shortest of equals."""
    sides = []
    for k in range(1, len(grown) + 1):
        covers = Rule(tuple(grown[:k])).column()
        sides += [F.count_if(covers & F.col("bad")).alias(f"p{k}"), F.count_if(covers & ~F.col("bad")).alias(f"n{k}")]
    got = rows.agg(*sides).first()
    worth = lambda k: (got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"])
    k = max(range(1, len(grown) + 1), key=lambda k: (worth(k), -k))
    p, n = got[f"p{k}"], got[f"n{k}"]
    return Rule(tuple(grown[:k]), p, n), p, n


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(stats: DataFrame, labels: DataFrame, **options) -> list[Rule]:
    """Rules for what the base rule lets pass, from all labelled rows of the training fold.

    `stats` should be a written table: a filter on computed statistics would compute them again.
    """
    names = list(features())
    rows = labelled(stats.filter(~base_failed()), labels).select("doc_id", "bad", *names)
    return learn(scratch.keep(rows), names, **options)


def apply_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics of every document, `base_failed` and `kept`.

    Null and empty texts have no words and fail the base rule. Rows that repeat a doc_id, or have
    none, are judged each by its own text. An empty table gives no rows; without labels only the
    base rule decides. Other columns, of any name, are ignored.
    """
    stats = scratch.keep(statistics(docs.select("doc_id", "text")))
    rules = fit(stats, labels.select("doc_id", "quality"), **options)
    return stats.select(
        "doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & decision(rules)).alias("kept"))
