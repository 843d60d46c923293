"""One drawn class per bin of a class's similarity ranking, without the ranking and without the matrix.

A bin's draw is a rank, so what is needed is the class that stands at that rank. Its place is an
integer key, falling score first and class number second, and is found digit by digit: tiles of the
matrix count their keys per class under the digits known so far, the counts of all tiles add up, and
the digit where the rank falls is the next one. After the last digit the key names the class, ties
included. Tiles are computed again for each digit; what they send is at most one row for each class,
bin and value of a digit, never one for each pair of classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.draws import rank32
from lumenfold.session import materialise

TILE = 4096  # classes on a side of a tile
DIGIT = 8  # bits found in a round
PLACES = 1_000_000  # scores are compared to 6 places
# The weights of the four products; the blended score is at most their sum.
TEXT, CROSS, IMAGE = 0.5, 0.8, 0.5
TOP = TEXT + 2 * CROSS + IMAGE


def bin_bounds(n_classes: int, neighbours: int) -> list[tuple[int, int]]:
    """Ranks of each bin, the end left out; rank 0, the class itself, is in none."""
    width = math.ceil(n_classes / neighbours)
    if (neighbours - 1) * width >= n_classes:
        raise ValueError(f"{neighbours} bins of {width} do not fit {n_classes} classes")
    if width < 2:
        raise ValueError(f"{n_classes} classes leave the first of {neighbours} bins empty")
    return [(max(1, k * width), min((k + 1) * width, n_classes)) for k in range(neighbours)]


def drawn_ranks(bounds: list[tuple[int, int]], seed: int, class_id: Column) -> Column:
    """One rank in each bin, as an array in the order of the bins."""
    low, size = (F.array(*[F.lit(x) for x in xs]) for xs in zip(*[(a, b - a) for a, b in bounds]))
    return F.transform(low, lambda a, k: (a + F.pmod(rank32(seed, class_id, k, "bin"), F.get(size, k))).cast("bigint"))


def from_ranking(ranked: DataFrame, neighbours: int, seed: int = 0, n_classes: int | None = None) -> DataFrame:
    """`class_id, bin, neighbor_id` out of a whole ranking (`rank_neighbours`, or a ranked file)."""
    if n_classes is None:
        n_classes = ranked.select("class_id").distinct().count()
    bounds = bin_bounds(n_classes, neighbours)
    ranks = drawn_ranks(bounds, seed, F.col("class_id"))
    slot = (F.array_position(ranks, F.col("rank").cast("bigint")) - 1).cast("int")
    return ranked.select("class_id", slot.alias("bin"), "neighbor_id").where("bin >= 0")


def _numbered(classes: DataFrame, parts: int) -> DataFrame:
    """Adds `_i`, the number of a class in the order of the ids, from counts of id ranges."""
    if parts == 1:  # one range: few enough for one window
        return classes.withColumn("_i", (F.row_number().over(Window.orderBy("class_id")) - 1).cast("bigint"))
    cut = materialise(classes.repartitionByRange(parts, "class_id").withColumn("_part", F.spark_partition_id()))
    # One row a range: few enough for one window.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("class_id")) - 1
    return cut.join(starts, "_part").withColumn("_i", (F.col("_start") + inside).cast("bigint")).drop("_start", "_part")


def _tiles(numbered: DataFrame, states: DataFrame, blocks: int) -> DataFrame:
    """Both sides of every tile: `side` 0 has the classes that ask, with `asked`, 1 those that answer."""
    block = F.pmod(F.col("_i"), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    ready = numbered.select("_i", "vec", block.alias("own"))
    left = ready.join(states, "_i").select("_i", "vec", "asked", F.lit(0).alias("side"), F.col("own").alias("i"), every.alias("j"))
    right = ready.select("_i", "vec", F.lit(None).cast("array<bigint>").alias("asked"), F.lit(1).alias("side"), every.alias("i"), F.col("own").alias("j"))
    return left.unionByName(right)


def _keys():
    """Keys of one tile in slabs of rows, as a function that travels to the workers by value."""
    import numpy as np

    text, cross, image, top, places = TEXT, CROSS, IMAGE, TOP, PLACES

    def keys(pdf, n: int, slab: int = 256) -> Iterator[tuple]:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(left) or not len(right):
            return
        a, b = np.array(left["vec"].tolist()), np.array(right["vec"].tolist())
        half = a.shape[1] // 2
        # Image part and text part of one class, each blended for the parts of the other.
        a = np.concatenate([image * a[:, :half] + cross * a[:, half:], cross * a[:, :half] + text * a[:, half:]], axis=1)
        of, asked, index = left["_i"].to_numpy(), left["asked"].tolist(), right["_i"].to_numpy()
        for at in range(0, len(a), slab):
            score = a[at : at + slab] @ b.T
            down = np.clip(np.rint(top * places) - np.rint(score * places), 0, None).astype(np.int64)
            yield of[at : at + slab], asked[at : at + slab], down * n + index

    return keys


def _ranked_tile(n: int):
    """For a tile that holds whole rows of the matrix: the classes at the ranks asked for."""
    import numpy as np
    import pandas as pd

    keys = _keys()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"_i": [], "bin": [], "_of": []}, dtype="int64")]
        for of, asked, key in keys(pdf, n):
            key.sort(axis=1)
            ranks = np.array([np.asarray(x) for x in asked])
            at = np.take_along_axis(key, ranks, axis=1) % n
            found.append(pd.DataFrame({"_i": np.repeat(of, ranks.shape[1]), "bin": np.tile(np.arange(ranks.shape[1]), len(of)), "_of": at.ravel()}))
        return pd.concat(found)

    return pick


def _counted_tile(n: int, shift: int, digit: int):
    """Counts of the next digit under each prefix asked for: `_i, value, n`, value with the digit."""
    import numpy as np
    import pandas as pd

    keys = _keys()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"_i": [], "value": [], "n": []}, dtype="int64")]
        for of, asked, key in keys(pdf, n):
            key >>= shift
            for i, wanted, row in zip(of, asked, key):
                value, times = np.unique(row[np.isin(row >> digit, np.asarray(wanted))], return_counts=True)
                found.append(pd.DataFrame({"_i": i, "value": value, "n": times}))
        return pd.concat(found)

    return count


def drawn_neighbours(classes: DataFrame, neighbours: int, seed: int = 0, blocks: int | None = None) -> DataFrame:
    """`class_id, bin, neighbor_id`: for each class and bin of its ranking the class at the drawn rank.

    `classes`: class_id, image_vec, text_vec, one row a class. The ranking is by falling blended score
    (6 places), equal scores by class id. Equals `from_ranking` of the whole ranking.
    """
    n = classes.count()
    bounds = bin_bounds(n, neighbours)
    if blocks is None:
        blocks = math.ceil(n / TILE)
    norms = classes.select("class_id", *[_unit(c).alias(c) for c in ("image_vec", "text_vec")])
    numbered = materialise(_numbered(norms.select("class_id", F.concat("image_vec", "text_vec").alias("vec")), max(1, n // 65536)))
    draws = numbered.select("_i", drawn_ranks(bounds, seed, F.col("class_id")).alias("asked"))
    if blocks == 1:
        found = _tiles(numbered, draws, 1).groupBy("i", "j").applyInPandas(_ranked_tile(n), "_i bigint, bin int, _of bigint")
    else:
        found = _by_digits(numbered, draws, n, blocks)
    ids = numbered.select("_i", "class_id")
    named = ids.select(F.col("_i").alias("_of"), F.col("class_id").alias("neighbor_id"))
    return found.join(ids, "_i").join(named, "_of").select("class_id", "bin", "neighbor_id")


def _unit(name: str) -> Column:
    wide = F.col(name).cast("array<double>")
    both = F.struct(wide.alias("v"), F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)).alias("n"))
    return F.transform(F.array(both), lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0]


def _by_digits(numbered: DataFrame, draws: DataFrame, n: int, blocks: int) -> DataFrame:
    """The key at each drawn rank, a digit a round."""
    bits = (int(2 * TOP * PLACES + 2) * n).bit_length()
    states = draws.select("_i", F.posexplode("asked").alias("bin", "rest")).withColumn("prefix", F.lit(0).cast("bigint"))
    shift = bits
    while shift > 0:
        digit = min(DIGIT, shift)
        shift -= digit
        asked = states.groupBy("_i").agg(F.collect_set("prefix").alias("asked"))
        counts = _tiles(numbered, asked, blocks).groupBy("i", "j").applyInPandas(
            _counted_tile(n, shift, digit), "_i bigint, value bigint, n bigint")
        sums = counts.groupBy("_i", "value").agg(F.sum("n").alias("n"))
        listed = sums.groupBy("_i", F.shiftright("value", digit).alias("prefix")).agg(
            F.array_sort(F.collect_list(F.struct("value", "n"))).alias("values"))  # at most 2**digit
        fall = F.aggregate(
            "values", F.struct(F.col("rest").alias("rest"), F.lit(None).cast("bigint").alias("value")),
            lambda s, x: F.when(s["value"].isNotNull(), s)
            .when(s["rest"] < x["n"], F.struct(s["rest"].alias("rest"), x["value"].alias("value")))
            .otherwise(F.struct((s["rest"] - x["n"]).alias("rest"), s["value"].alias("value"))))
        states = materialise(states.join(listed, ["_i", "prefix"]).select("_i", "bin", fall.alias("at")).select(
            "_i", "bin", F.col("at.rest").alias("rest"), F.col("at.value").alias("prefix")))
    return states.select("_i", "bin", F.pmod("prefix", F.lit(n)).alias("_of"))
