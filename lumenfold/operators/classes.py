"""Class sets: image lists, splits, embeddings, similarity, neighbour ranking, pair records.

Images stay in long form, one row per image; arrays are built only where their size is bounded by
a parameter (36 samples, 36 neighbours, 32 context images, one vector).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.draws import order60, rank32
from lumenfold.operators.neighbour_bins import from_ranking
from lumenfold.operators.ranking import first_by_hash, pick_by_rank, rank_by_hash, top_n

NEIGHBOURS = 36
SAMPLES = 36
CONTEXT = 32
VECTORS = 100
BLOCK = 1024


def class_images(
    folders: DataFrame,
    train: DataFrame,
    val: DataFrame,
    train_prefix: str = "train/",
    val_prefix: str = "val/",
    suffix: str = ".JPEG",
    blocked: DataFrame | None = None,
) -> DataFrame:
    """All images of all classes: `class_id, class_name, part, line_no, image`.

    `folders`: folder, class_id, class_name (first entry of a folder wins, see `sources.class_map`).
    `train`: line_no, folder, path. `val`: line_no, path, class_id. Train images come before
    validation images, each in line order. `blocked`: line numbers of `val` to leave out.
    """
    if blocked is not None:
        val = val.join(blocked, "line_no", "left_anti")
    names = folders.groupBy("class_id").agg(F.min_by("class_name", "line_no").alias("class_name"))
    from_train = train.join(folders.select("folder", "class_id"), "folder", "left").select(
        _known(F.col("class_id"), F.col("folder")).alias("class_id"), F.lit(0).alias("part"), "line_no",
        F.concat(F.lit(train_prefix), "path", F.lit(suffix)).alias("image"),
    )
    from_val = val.select(
        "class_id", F.lit(1).alias("part"), "line_no", F.concat(F.lit(val_prefix), "path", F.lit(suffix)).alias("image")
    )
    return from_train.unionByName(from_val).join(names, "class_id").select(
        "class_id", "class_name", "part", "line_no", "image"
    )


def _known(value: Column, key: Column) -> Column:
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("unknown folder: "), key)).cast("string")).otherwise(value)


def first_per_class(classes: DataFrame) -> DataFrame:
    """The first record per class id; later ones are dropped (see `duplicate_classes`)."""
    fields = F.struct(*[F.col(c) for c in classes.columns])
    return classes.groupBy("class_id").agg(F.min_by(fields, "row_id").alias("_r")).select("_r.*")


def duplicate_classes(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def split_classes(classes: DataFrame, n_test: int, seed: int = 0) -> DataFrame:
    """Adds `split`: n_test classes by hash go to test, the others to train."""
    names = classes.select("class_id").distinct().withColumn("_h", order60(seed, F.col("class_id"), "split"))
    test = first_by_hash(names, F.least(F.lit(n_test), F.col("n")), "_h").select("class_id", F.lit(True).alias("_t"))
    out = classes.join(test, "class_id", "left")
    return out.withColumn("split", F.when(F.col("_t"), F.lit("test")).otherwise(F.lit("train"))).drop("_t")


def _partial_sums():
    """The task function: sums and counts of each component over the rows of a class, by value as below."""
    import numpy as np
    import pyarrow as pa

    def flush(held: dict, schema: pa.Schema) -> pa.RecordBatch:
        sums, counts = zip(*held.values()) if held else ((), ())
        return pa.RecordBatch.from_arrays([
            pa.array(list(held), schema.field(0).type), pa.array([x.tolist() for x in sums], schema.field(1).type),
            pa.array([x.tolist() for x in counts], schema.field(2).type)], schema=schema)

    def add(batches, classes_held: int = 4096):
        held: dict = {}
        schema = None
        for batch in batches:
            schema = pa.schema([("class_id", batch.schema.field(0).type), ("sums", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64()))])
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = vector.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
                known = ~np.isnan(x)
                sums, counts = held.get(key, (np.zeros(0), np.zeros(0, np.int64)))
                if len(sums) < len(x):
                    sums, counts = (np.concatenate([o, np.zeros(len(x) - len(o), o.dtype)]) for o in (sums, counts))
                sums[: len(x)] += np.where(known, x, 0)
                counts[: len(x)] += known
                held[key] = (sums, counts)
            if len(held) >= classes_held:
                yield flush(held, schema)
                held = {}
        if schema is not None:
            yield flush(held, schema)

    return add


def class_embedding(
    vectors: DataFrame, n: int = VECTORS, seed: int = 0, vector: str = "embedding", image: str = "image"
) -> DataFrame:
    """Mean of up to n hash-sampled vectors per class; null vectors (unreadable images) do not count.

    The n-th hash of each class is found without the vectors; each task then adds up the vectors up to
    it, so that what is shuffled is one sum a class and task. Null components do not count either.
    """
    key = order60(seed, F.col("class_id"), F.col(image))
    named = vectors.select("class_id", F.col(image).alias("_image"), key.alias("_h"))
    cut = top_n(named, ["class_id"], ["_h", "_image"], n).groupBy("class_id").agg(F.max(F.struct("_h", "_image")).alias("_last"))
    chosen = (
        vectors.select("class_id", F.struct(key.alias("_h"), F.col(image).alias("_image")).alias("_at"), F.col(vector).alias("_v"))
        .join(cut, "class_id").where((F.col("_at") <= F.col("_last")) & F.col("_v").isNotNull()))
    id_type = vectors.schema["class_id"].dataType.simpleString()
    sums = chosen.select("class_id", F.transform("_v", lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias("v")).mapInArrow(
        _partial_sums(), f"class_id {id_type}, sums array<double>, counts array<bigint>")
    # At most n rows a class, and one a task.
    total = lambda c, zero: F.aggregate(
        F.collect_list(c), F.array().cast(f"array<{zero}>"),
        lambda s, x: F.zip_with(s, x, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))
    return sums.groupBy("class_id").agg(total("sums", "double").alias("s"), total("counts", "bigint").alias("c")).select(
        "class_id", F.zip_with("s", "c", lambda s, c: F.when(c > 0, s / c)).alias("embedding"))


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: x / norm)


def _tile_product():
    """The task function, made locally so that it travels by value: workers need no copy of this package."""
    import numpy as np
    import pandas as pd

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": left["class_id"][:0], "b": left["class_id"][:0], "score": np.empty(0)})
        it, tt = np.array(left["image_vec"].tolist()), np.array(left["text_vec"].tolist())
        ji, jt = np.array(right["image_vec"].tolist()), np.array(right["text_vec"].tolist())
        blend = 0.5 * (tt @ jt.T) + 0.8 * (it @ jt.T + tt @ ji.T) + 0.5 * (it @ ji.T)
        return pd.DataFrame(
            {
                "a": np.repeat(left["class_id"].to_numpy(), len(right)),
                "b": np.tile(right["class_id"].to_numpy(), len(left)),
                "score": np.round(blend.ravel(), 6),
            }
        )

    return score


def similarity(classes: DataFrame, blocks: int | None = None) -> DataFrame:
    """The blended similarity matrix in long form: `a, b, score` (6 places).

    `classes`: class_id, image_vec, text_vec. The matrix itself is the result, so its size is the
    square of the class count; it is computed as blocks x blocks tiles of about 1024 classes, each
    a small matrix product in one task, with every vector sent once per tile row and tile column.
    """
    if blocks is None:
        blocks = max(1, math.ceil(classes.count() / BLOCK))
    ready = classes.select(
        "class_id",
        unit(F.col("image_vec").cast("array<double>")).alias("image_vec"),
        unit(F.col("text_vec").cast("array<double>")).alias("text_vec"),
        F.pmod(rank32("block", F.col("class_id")), F.lit(blocks)).alias("_own"),
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
    spread = ready.select("*", every)
    left = spread.select("class_id", "image_vec", "text_vec", F.lit(0).alias("side"), F.col("_own").alias("i"), F.col("_other").cast("bigint").alias("j"))
    right = spread.select("class_id", "image_vec", "text_vec", F.lit(1).alias("side"), F.col("_other").cast("bigint").alias("i"), F.col("_own").alias("j"))
    id_type = classes.schema["class_id"].dataType.simpleString()
    return left.unionByName(right).groupBy("i", "j").applyInPandas(_tile_product(), f"a {id_type}, b {id_type}, score double")


def rank_neighbours(matrix: DataFrame) -> DataFrame:
    """`class_id, rank, neighbor_id, score`: all classes by falling score, rank 0 is the class itself in practice."""
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return matrix.select(
        F.col("a").alias("class_id"),
        (F.row_number().over(w) - 1).alias("rank"),
        F.col("b").alias("neighbor_id"),
        "score",
    )


def _draw_images(images: DataFrame, keys: list[str], n: int, seed: int, tag: str) -> DataFrame:
    """n images per key by hash, as `pos, image`."""
    hashed = images.withColumn("_h", order60(seed, *[F.col(k) for k in keys], F.col("image"), tag))
    w = Window.partitionBy(*keys).orderBy("_h", "image")
    # The filter is on the bare row number, so that Spark cuts groups before the shuffle.
    first = hashed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return first.withColumn("pos", F.col("_r") - 1).drop("_h", "_r")


def train_pairs(
    ranked: DataFrame, images: DataFrame, neighbours: int = NEIGHBOURS, samples: int = SAMPLES, seed: int = 0,
    n_classes: int | None = None, strict: bool = True,
) -> DataFrame:
    """`pair_records` of a whole ranking, from `rank_neighbours` or a ranked file."""
    return pair_records(from_ranking(ranked, neighbours, seed, n_classes), images, neighbours, samples, seed, strict)


def pair_records(
    chosen: DataFrame, images: DataFrame, neighbours: int = NEIGHBOURS, samples: int = SAMPLES, seed: int = 0, strict: bool = True,
) -> DataFrame:
    """Train records: own samples, and one random class with one random image per similarity bin.

    `chosen` (class_id, bin, neighbor_id) from `neighbour_bins`, `images`: class_id, class_name, image.
    Every class gives a row. One without images, with fewer than `samples`, or with a chosen neighbour
    that has no image is an error; with `strict=False` the column `problem` names it, and is null elsewhere.
    """
    named = images.groupBy("class_id").agg(F.min("class_name").alias("class_name")).select(
        "class_id", F.replace(F.col("class_name"), F.lit("_"), F.lit(" ")).alias("class_name")
    )
    # The image is drawn by its rank in the neighbour class. Neighbours without images stay, with a
    # null image, and are counted as a problem below.
    pool = images.select(
        F.col("class_id").alias("neighbor_id"), "image", order60(seed, F.col("class_id"), F.col("image"), "pool").alias("_h"))
    turn = rank32(seed, F.col("class_id"), F.col("bin"), F.col("neighbor_id"), "img")
    wanted = chosen.join(named.select(F.col("class_id").alias("neighbor_id"), F.col("class_name").alias("_name")), "neighbor_id", "left")
    drawn = pick_by_rank(wanted, pool, ["neighbor_id"], ["_h", "image"], lambda size: F.pmod(turn, size)).drop("_h")
    one = F.struct(
        F.col("bin").alias("bin"), F.col("neighbor_id").cast("string").alias("id"),
        F.col("_name").alias("name"), F.col("image").alias("img"),
    )
    plain = lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"), s["img"].alias("img"))
    neighbor = drawn.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(one)), plain).alias("neighbors"))
    own = _draw_images(images.select("class_id", "image"), ["class_id"], samples, seed, "own")
    own = own.groupBy("class_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "image"))), lambda s: s["image"]).alias("samples")
    )
    paired = F.filter("neighbors", lambda s: s["img"].isNotNull())
    problem = (
        F.when(F.col("samples").isNull(), F.lit("no images"))
        .when(F.size("samples") < samples, F.lit(f"fewer than {samples} images"))
        .when(F.size(paired) < neighbours, F.lit(f"fewer than {neighbours} neighbours with images"))
    )
    # From the neighbours on: a class without images must not vanish.
    records = neighbor.join(named, "class_id", "left").join(own, "class_id", "left").withColumn("problem", problem)
    columns = ["class_id", "class_name", "samples", "neighbors"]
    if not strict:
        return records.select(*columns, "problem")
    stop = F.raise_error(F.concat(F.lit("class "), F.col("class_id").cast("string"), F.lit(": "), F.col("problem")))
    held = F.when(F.col("problem").isNotNull(), stop.cast("array<string>")).otherwise(F.col("samples"))
    return records.withColumn("samples", held).select(*columns)


def context_split(images: DataFrame, n_context: int = CONTEXT, seed: int = 0) -> DataFrame:
    """Adds `split` (context / test) and `pos` inside it, per class in hash order.

    Ranks are taken per hash range, so that one huge class is spread over many tasks.
    """
    hashed = images.withColumn("_h", order60(seed, F.col("class_id"), F.col("image"), "context"))
    ranked = rank_by_hash(hashed, ["class_id"], ["_h", "image"], "_rank")
    in_context = F.col("_rank") < n_context
    return ranked.withColumns(
        {
            "split": F.when(in_context, F.lit("context")).otherwise(F.lit("test")),
            "pos": F.when(in_context, F.col("_rank")).otherwise(F.col("_rank") - n_context),
        }
    ).drop("_h", "_rank")


def context_lists(split: DataFrame, n_context: int = CONTEXT) -> DataFrame:
    """Context images per class as an array of at most n_context."""
    kept = split.where((F.col("split") == "context") & (F.col("pos") < n_context))
    listed = F.array_sort(F.collect_list(F.struct("pos", "image")))
    return kept.groupBy("class_id", "class_name").agg(F.transform(listed, lambda s: s["image"]).alias("context_samples"))


def list_records(images: DataFrame, order: list[str], chunk: int, name: str, position: str = "pos") -> DataFrame:
    """Long image rows to records with arrays of at most `chunk`: `class_id, class_name, chunk, <name>`.

    A class with more images than `chunk` has several records; reading them back in chunk order
    gives the whole list.
    """
    parts = images.withColumn("chunk", F.floor(F.col(position) / chunk).cast("bigint"))
    listed = F.array_sort(F.collect_list(F.struct(*order, "image")))
    return parts.groupBy("class_id", "class_name", "chunk").agg(F.transform(listed, lambda s: s["image"]).alias(name))
