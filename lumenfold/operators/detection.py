"""Detection episodes: positive items, hard negatives from neighbouring categories, queries.

Tables: `annotations` (id, image_id, category_id, bbox x,y,w,h), `images` (id, file_name, width,
height), `categories` (id, name), `neighbors` (category_id, pos, neighbor_id), `expired`
(image_id). An episode belongs to one category; an item is
`struct<image,width,height,boxes,question,answer,mode>` and its boxes are clean x1,y1,x2,y2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.draws import chance, order60, rank32, random_word, shuffled
from lumenfold.functions.geometry import clean_box, xywh_to_xyxy
from lumenfold.functions.text import swap, template
from lumenfold.operators.ranking import pick_by_rank, rank_by_hash
from lumenfold.session import materialise

# Texts and modes (fixed values).
LEARN = "[INSTRUCTION] Please learn from the following sentence about the image <image>."
INFER = "[INFERENCE] "
ABSENT = "The target object does not exist."
FIRST_MODE = "hypnotized_v1.0"
SUPPORT_MODE = "hypnotized_ans_v1.0"
QUERY_MODE = "hypnotized_v1.1"
HARD = 5
POOL_ROWS = 4096  # images that one range of the largest category holds, about

# Why an item or an episode could not be built.
NO_NEIGHBOUR = "no category that is not in the image"
NO_IMAGE = "no image left for a drawn category"


def usable_categories(categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """Categories with at least one image.

    Each task hands on a category's id once: few categories can have all annotations of a large set.
    """
    return categories.join(annotations.select(F.col("category_id").alias("id")).distinct(), "id", "left_semi")


def choose_neighbour(
    categories: DataFrame, annotations: DataFrame, neighbors: DataFrame, seed: int = 0, epoch: int = 0
) -> DataFrame:
    """One confusable category per category: `category_id, neighbor_id`.

    Candidates are neighbours that are usable and not present in one random image of the category;
    for half of the categories only the five most similar count. A category without candidates gets
    any usable category that is not in that image. One whose image shows every category there is
    has none and is left out (`without_neighbour` lists it).
    """
    cat, img = F.col("category_id"), F.col("image_id")
    seen = annotations.groupBy("category_id").agg(F.min_by("image_id", order60(seed, epoch, cat, img, "seen")).alias("image_id"))
    present = annotations.select("image_id", F.col("category_id").alias("neighbor_id"))
    usable = usable_categories(categories, annotations).select(F.col("id").alias("neighbor_id")).distinct()
    candidates = (
        neighbors.join(usable, "neighbor_id", "left_semi")
        .join(seen, "category_id")
        .join(present, ["image_id", "neighbor_id"], "left_anti")
    )
    near = F.row_number().over(Window.partitionBy("category_id").orderBy("pos"))
    coin = chance(0.5, seed, epoch, cat, "hard")
    eligible = candidates.withColumn("_near", near).where(~coin | (F.col("_near") <= HARD))
    draw = order60(seed, epoch, cat, F.col("neighbor_id"), "neighbour")
    near_by = eligible.groupBy("category_id").agg(F.min_by("neighbor_id", draw).alias("neighbor_id"))
    lacking = usable.select(F.col("neighbor_id").alias("category_id")).join(near_by, "category_id", "left_anti")
    return near_by.unionByName(_any_other(lacking.join(seen, "category_id"), usable, present, seed, epoch))


def _any_other(lacking: DataFrame, usable: DataFrame, present: DataFrame, seed: int, epoch: int) -> DataFrame:
    """For `category_id, image_id`: a usable category that is not in the image, from a random place on.

    Usable categories are numbered. An image with m categories is left behind after m + 1 numbers in
    a row, so that many are tried, whatever the number of categories.
    """
    numbered = rank_by_hash(usable.withColumn("_h", order60(seed, F.col("neighbor_id"), "any")), [], ["_h", "neighbor_id"], "_at")
    total = usable.agg(F.count(F.lit(1)).alias("n")).scalar()
    shown = present.groupBy("image_id").agg(F.count_distinct("neighbor_id").alias("_m"))
    start = rank32(seed, epoch, F.col("category_id"), "any")
    tries = lacking.join(shown, "image_id").select(
        "category_id", "image_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m"))).alias("_try")
    )
    found = (
        tries.withColumn("_at", F.pmod(start + F.col("_try"), total))
        .join(numbered.select("_at", "neighbor_id"), "_at")
        .join(present, ["image_id", "neighbor_id"], "left_anti")
    )
    return found.groupBy("category_id").agg(F.min_by("neighbor_id", "_try").alias("neighbor_id"))


def without_neighbour(categories: DataFrame, chosen: DataFrame) -> DataFrame:
    return categories.join(chosen.select(F.col("category_id").alias("id")), "id", "left_anti")


def draw_images(draws: DataFrame, annotations: DataFrame, expired: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """A random image that is not expired per draw (`category_id, side, slot, of`; `of` = category drawn from).

    The images of a category are numbered by hash and a draw is a number. The pool is kept once; counts
    per hash range tell into which range a draw falls, and only ranges that are hit are ranked, for all
    sides and slots together. Draws from categories without images are not among the result; the
    callers give such an item or episode its `problem`.
    """
    pool = annotations.select("category_id", "image_id").distinct().join(expired, "image_id", "left_anti")
    pool = pool.select(F.col("category_id").alias("of"), "image_id")
    kept = materialise(pool.withColumn("_h", order60(seed, F.col("of"), F.col("image_id"), "pool")))
    at = rank32(seed, epoch, F.col("category_id"), F.col("side"), F.col("slot"), "image")
    drawn = pick_by_rank(draws, kept, ["of"], ["_h", "image_id"], lambda size: F.pmod(at, size), POOL_ROWS)
    return drawn.where("image_id is not null").drop("_h")


def with_boxes(drawn: DataFrame, annotations: DataFrame, images: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Adds file name, size and boxes of the drawn category. Query draws get all boxes of that image, others one."""
    marks = annotations.select(F.col("category_id").alias("of"), "image_id", F.col("id").alias("_ann"), "bbox")
    sized = images.select(F.col("id").alias("image_id"), "file_name", "width", "height")
    keys = ["category_id", "side", "slot", "of", "image_id", "file_name", "width", "height"]
    boxed = (
        drawn.join(marks, ["of", "image_id"])
        .join(sized, "image_id")
        .withColumn("_box", clean_box(xywh_to_xyxy(F.col("bbox")), F.col("width"), F.col("height")))
    )
    entry = F.struct("_ann", "_box")
    draw = order60(seed, epoch, F.col("category_id"), F.col("side"), F.col("slot"), F.col("_ann"), "box")
    is_query = F.col("slot") < 0
    grouped = boxed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(is_query, entry))).alias("_all"),
        F.min_by(F.col("_box"), F.when(~is_query, draw)).alias("_one"),
    )
    boxes = F.when(is_query, F.transform("_all", lambda e: e["_box"])).otherwise(F.array("_one"))
    return grouped.select(*keys, boxes.alias("boxes"))


def _item(boxes: Column, question: Column, answer: Column, mode: Column) -> Column:
    return F.struct(
        F.col("file_name").alias("image"), "width", "height", boxes.alias("boxes"),
        question.alias("question"), answer.alias("answer"), mode.alias("mode"),
    )


def _learn(label: Column) -> Column:
    return F.concat(F.lit(f"The {S.BOXES} in the image is "), label, F.lit("."))


def _names(categories: DataFrame, key: str, name: str) -> DataFrame:
    return categories.select(F.col("id").alias(key), F.col("name").alias(name))


def plain_items(
    categories: DataFrame, annotations: DataFrame, images: DataFrame, neighbors: DataFrame, expired: DataFrame,
    seed: int = 0, epoch: int = 0,
) -> DataFrame:
    """One item per usable category: by a coin, of the category itself or of a confusable one.

    Where it cannot be drawn `item` is null and `problem` says why; `problem` is null elsewhere.
    """
    chosen = materialise(choose_neighbour(categories, annotations, neighbors, seed, epoch))
    usable = usable_categories(categories, annotations).select(F.col("id").alias("category_id"))
    positive = chance(0.5, seed, epoch, F.col("category_id"), "positive")
    draws = usable.join(chosen, "category_id", "left").select(
        "category_id",
        F.when(positive, F.lit("pos")).otherwise(F.lit("neg")).alias("side"),
        F.lit(0).alias("slot"),
        F.when(positive, F.col("category_id")).otherwise(F.col("neighbor_id")).alias("of"),
    )
    drawn = draw_images(draws.where("of is not null"), annotations, expired, seed, epoch)
    boxed = with_boxes(drawn, annotations, images, seed, epoch).join(_names(categories, "of", "label"), "of")
    one = _item(F.col("boxes"), F.lit(LEARN), _learn(F.col("label")), F.lit("common"))
    made = boxed.select("category_id", one.alias("item"))
    return draws.join(made, "category_id", "left").select(
        "category_id", "side", "item",
        F.when(F.col("of").isNull(), F.lit(NO_NEIGHBOUR)).when(F.col("item").isNull(), F.lit(NO_IMAGE)).alias("problem"),
    )


def episodes(
    categories: DataFrame, annotations: DataFrame, images: DataFrame, neighbors: DataFrame, expired: DataFrame,
    templates: Sequence[str], shot: int, seed: int = 0, epoch: int = 0,
) -> DataFrame:
    """`category_id, items`: a word of 4 to 10 letters stands for the category.

    A positive, a negative, 2 x (shot - 1) shuffled ones, then the query: half of the time the
    category under its word, a quarter the word on an image of the neighbour (absent), a quarter
    the neighbour by its own name. Every usable category gives a row; where a part cannot be drawn
    `items` is null and `problem` says why.
    """
    key = [seed, epoch, F.col("category_id")]
    # One row a category, read by the draws and by the rows with a problem.
    chosen = materialise(choose_neighbour(categories, annotations, neighbors, seed, epoch))
    kind = F.pmod(rank32(*key, "query"), F.lit(4))
    slots = F.sequence(F.lit(0), F.lit(shot - 1))
    side = lambda name, of: F.transform(slots, lambda s: F.struct(F.lit(name).alias("side"), s.alias("slot"), of.alias("of")))
    query_of = F.when(kind < 2, F.col("category_id")).otherwise(F.col("neighbor_id"))
    query = F.array(F.struct(F.lit("query").alias("side"), F.lit(-1).alias("slot"), query_of.alias("of")))
    wanted = F.concat(side("pos", F.col("category_id")), side("neg", F.col("neighbor_id")), query)
    draws = chosen.select("category_id", F.explode(wanted).alias("d")).select("category_id", "d.*")
    drawn = draw_images(draws, annotations, expired, seed, epoch)
    boxed = with_boxes(drawn, annotations, images, seed, epoch).join(_names(categories, "of", "label"), "of")

    word = random_word(4, 10, *key)
    is_query, is_pos = F.col("side") == "query", F.col("side") == "pos"
    named = F.when(is_query & (kind == 3), F.col("label")).when(is_query | is_pos, word).otherwise(F.col("label"))
    absent = is_query & (kind == 2)
    asked = F.concat(F.lit(INFER), swap(template(templates, *key), S.EXPR, named))
    answer = F.when(absent, F.lit(ABSENT)).when(is_query, F.lit(f"{S.BOXES}.")).otherwise(_learn(named))
    mode = (
        F.when(is_query, F.lit(QUERY_MODE))
        .when(is_pos & (F.col("slot") == 0), F.lit(FIRST_MODE))
        .otherwise(F.lit(SUPPORT_MODE))
    )
    one = _item(
        F.when(~absent, F.col("boxes")), F.when(is_query, asked).otherwise(F.lit(LEARN)), answer, mode
    )
    # 2 x shot + 1 items per category.
    entry = F.struct(
        F.when(is_query, 2).when(F.col("slot") == 0, 0).otherwise(1).alias("part"),
        F.when(is_pos, 0).otherwise(1).alias("order"),
        "slot",
        one.alias("item"),
    )
    listed = boxed.groupBy("category_id").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    part = lambda n: F.transform(F.filter("_e", lambda e: e["part"] == n), lambda e: e["item"])
    items = F.concat(part(0), shuffled(part(1), *key, "order"), part(2))
    whole = listed.where(F.size("_e") == 2 * shot + 1).select("category_id", items.alias("items"))
    every = usable_categories(categories, annotations).select(F.col("id").alias("category_id"))
    return every.join(chosen, "category_id", "left").join(whole, "category_id", "left").select(
        "category_id", "items",
        F.when(F.col("neighbor_id").isNull(), F.lit(NO_NEIGHBOUR)).when(F.col("items").isNull(), F.lit(NO_IMAGE)).alias("problem"),
    )
