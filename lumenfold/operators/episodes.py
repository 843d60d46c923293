"""Few-shot episodes from class records: one row per episode, `items` in order.

A class record is `class_id, class_name, samples, neighbors`; an episode is keyed by
`(seed, epoch, class_id)` and every draw adds its slot to that key, so episodes can be built in
any order and on any number of tasks. Items are `struct<image,question,answer,mode>`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold import schema as S
from lumenfold.functions.binding import explode_items as explode_array
from lumenfold.functions.binding import let
from lumenfold.functions.draws import falling_weight_index, pick, rank32, random_word, shuffled, weighted_choice
from lumenfold.functions.prompts import render_by_mode
from lumenfold.functions.text import template
from lumenfold.operators.classes import first_per_class

FIRST_MODE = "causal_v1.0"
SUPPORT_MODE = "hypnotized_ans_v1.0"
QUERY_MODE = "final_v1.0"
EPISODE_MODES = [FIRST_MODE, SUPPORT_MODE, QUERY_MODE]
# Texts of the episodes (fixed values).
SHOWN_QUESTION = "[BEGIN EXAMPLE] What is in the image <image>?"
NAMED_QUESTION = "[BEGIN EXAMPLE] Tell me something about this image <image>."
TILE_QUESTION = "[BEGIN EXAMPLE] This image <image> is a puzzle piece."
SAME_QUESTION = (
    "Which images in the previous example are in the same category as this image <image>? "
    "(Provide the answer in order as list)"
)
TILE_QUERY = (
    "Using the puzzle pieces provided above to piece together this image <image>, "
    "and provide the coordinates of each piece on the image coordinate system in order."
)
EVAL_QUESTION = "Based on the previous examples, what is in the image <image>?"
END = " [END EXAMPLE]"
THERE_IS = 'there is "<label>" in the image.'
GRIDS = {4: [(2, 2)], 6: [(2, 3), (3, 2)], 9: [(3, 3)], 12: [(3, 4), (4, 3)], 16: [(4, 4)]}


def item(image, question, answer, mode=None) -> Column:
    col = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(
        col(image).alias("image"), col(question).alias("question"), col(answer).alias("answer"), col(mode).alias("mode")
    )


def there_is(label: Column, end: str = END) -> Column:
    return F.replace(F.lit(THERE_IS + end), F.lit(S.LABEL), label)


def slots(n) -> Column:
    """0..n-1, empty for n = 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_modes(support: Column) -> Column:
    """First support item opens the prompt, the others continue it."""
    return F.transform(
        support, lambda x, i: x.withField("mode", F.when(i == 0, F.lit(FIRST_MODE)).otherwise(F.lit(SUPPORT_MODE)))
    )


def _key(seed: int, epoch) -> list:
    return [seed, epoch, F.col("class_id")]


def with_neighbour(classes: DataFrame, seed: int = 0, epoch=0) -> DataFrame:
    """One neighbour per episode, the nearer the likelier; adds `nb` and its own images `nb_samples`.

    The ranked list of n neighbours has weights n..1. A neighbour that is no class is an error.
    """
    index = falling_weight_index(F.size("neighbors"), *_key(seed, epoch), "neighbour").cast("int")
    drawn = classes.withColumn("nb", F.get("neighbors", index))
    # Records read from a file may repeat a class, and epochs repeat all; built records do neither.
    known = classes
    if "row_id" in classes.columns:
        known = first_per_class(classes)
    elif isinstance(epoch, Column):
        known = classes.dropDuplicates(["class_id"])
    pool = known.select(F.col("class_id").cast("string").alias("_nb_id"), F.col("samples").alias("nb_samples"))
    joined = drawn.join(pool, drawn["nb"]["id"] == pool["_nb_id"], "left")
    missing = F.raise_error(F.concat(F.lit("neighbour is not a class: "), F.col("nb")["id"])).cast("array<string>")
    return joined.withColumn("nb_samples", F.when(F.col("_nb_id").isNull(), missing).otherwise(F.col("nb_samples"))).drop("_nb_id")


def over_epochs(classes: DataFrame, epochs: int) -> DataFrame:
    """Class records repeated for epochs 0..n-1; pass `epoch=F.col("epoch")` to the builders."""
    return classes.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))


def negative_draws(classes: DataFrame, n: int, seed: int = 0, epoch=0) -> DataFrame:
    """n images of the class, all labelled with the name of one random neighbour."""
    key = _key(seed, epoch)
    label = F.lower(pick(F.col("neighbors"), *key, "label")["name"])
    return classes.select(
        "class_id",
        explode_array(F.transform(slots(n), lambda s: pick(F.col("samples"), *key, "own", s)), "pos", "image"),
        label.alias("label"),
    )


def _own_image(key: list, slot) -> Column:
    return pick(F.col("samples"), *key, "own", slot)


def _neighbour_image(key: list, slot: Column) -> Column:
    """The stored image on the first draw, later any image of the neighbour's class."""
    return F.when(slot == 0, F.col("nb")["img"]).otherwise(pick(F.col("nb_samples"), *key, "nb", slot))


def _query_side(key: list) -> Column:
    return F.pmod(rank32(*key, "side"), F.lit(2)) == 0


def _weight_items(templates: Sequence[str], shot: Column, key: list) -> Column:
    return let(random_word(1, 10, *key), lambda word: _weight_list(templates, shot, key, word))


def _weight_list(templates: Sequence[str], shot: Column, key: list, word: Column) -> Column:
    name = F.lower(F.col("nb")["name"])
    own = F.transform(slots(shot), lambda s: item(_own_image(key, s), SHOWN_QUESTION, there_is(word)))
    other = F.transform(slots(shot), lambda s: item(_neighbour_image(key, s), SHOWN_QUESTION, there_is(name)))
    support = with_modes(shuffled(F.concat(own, other), *key, "order"))
    is_own = _query_side(key)
    query = item(
        F.when(is_own, _own_image(key, "query")).otherwise(pick(F.col("nb_samples"), *key, "nb", "query")),
        template(templates, *key),
        there_is(F.when(is_own, word).otherwise(name), ""),
        QUERY_MODE,
    )
    return F.concat(support, F.array(query))


def _out(df: DataFrame, items: Column, epoch) -> DataFrame:
    epoch = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return df.select("class_id", epoch.cast("int").alias("epoch"), items.alias("items"))


def two_way_weight(classes: DataFrame, templates: Sequence[str], shot: int, seed: int = 0, epoch=0) -> DataFrame:
    """`shot` own images under an invented word, `shot` neighbour images under their name, one query."""
    return _out(with_neighbour(classes, seed, epoch), _weight_items(templates, F.lit(shot), _key(seed, epoch)), epoch)


def random_shot(shot: int, *key) -> Column:
    """1..shot, weight exp(i / 2)."""
    return weighted_choice([math.exp(i / 2) for i in range(1, shot + 1)], *key, "shot").cast("int") + 1


def two_way_random_shot(classes: DataFrame, templates: Sequence[str], shot: int, seed: int = 0, epoch=0) -> DataFrame:
    key = _key(seed, epoch)
    df = with_neighbour(classes, seed, epoch).withColumn("_shot", random_shot(shot, *key))
    return _out(df, _weight_items(templates, F.col("_shot"), key), epoch)


def _ref_items(key: list, legacy: bool) -> Column:
    return let(random_word(1, 10, *key), lambda word: _ref_list(key, word, legacy))


def _ref_list(key: list, word: Column, legacy: bool) -> Column:
    own_side, shot = F.lit(0), F.col("_shot")

    def named(side: int):
        def one(s):
            image = _own_image(key, s) if side == 0 else _neighbour_image(key, s)
            name = F.concat(random_word(1, 10, *key, "name", side, s), F.lit("_"), word)
            return F.struct(image.alias("image"), name.alias("name"), F.lit(side).alias("side"))

        return F.transform(slots(shot), one)

    return let(shuffled(F.concat(named(0), named(1)), *key, "order"), lambda mixed: _ref_shown(key, word, mixed, own_side, legacy))


def _ref_shown(key: list, word: Column, mixed: Column, own_side: Column, legacy: bool) -> Column:
    support = F.transform(
        mixed,
        lambda x: item(
            x["image"], NAMED_QUESTION, F.concat(F.lit('The reference name of this image is "'), x["name"], F.lit('".' + END))
        ),
    )
    is_own = _query_side(key)
    wanted = F.when(is_own, own_side).otherwise(F.lit(1))
    if legacy:
        wanted = F.lit(1) - wanted
    names = F.transform(F.filter(mixed, lambda x: x["side"] == wanted), lambda x: F.concat(F.lit("'"), x["name"], F.lit("'")))
    answer = F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]._"), word)
    image = F.when(is_own, _own_image(key, "query")).otherwise(pick(F.col("nb_samples"), *key, "nb", "query"))
    return F.concat(with_modes(support), F.array(item(image, SAME_QUESTION, answer, QUERY_MODE)))


def two_way_ref(classes: DataFrame, shot: int, seed: int = 0, epoch=0, legacy: bool = False) -> DataFrame:
    """Support images get names; the query asks which of them share its class.

    3..shot images per side. `legacy=True` answers with the names of the other side.
    """
    if shot < 3:
        raise ValueError("needs at least 3 shots")
    key = _key(seed, epoch)
    df = with_neighbour(classes, seed, epoch).withColumn("_shot", _ref_shot(shot, key))
    return _out(df, _ref_items(key, legacy), epoch)


def _ref_shot(shot: int, key: list) -> Column:
    return (F.lit(3) + F.pmod(rank32(*key, "refshot"), F.lit(shot - 2))).cast("int")


def two_way_ref_or_weight(
    classes: DataFrame, templates: Sequence[str], shot: int, seed: int = 0, epoch=0, legacy: bool = False
) -> DataFrame:
    """Either kind, by a coin per episode."""
    if shot < 3:
        raise ValueError("needs at least 3 shots")
    key = _key(seed, epoch)
    df = with_neighbour(classes, seed, epoch).withColumn("_shot", _ref_shot(shot, key))
    coin = F.pmod(rank32(*key, "kind"), F.lit(2)) == 1
    items = F.when(coin, _weight_items(templates, F.lit(shot), key)).otherwise(_ref_items(key, legacy))
    return _out(df, items, epoch)


def tile_plan(images: DataFrame, seed: int = 0, epoch=0) -> DataFrame:
    """Puzzle plans over `class_id, image, width, height`: tiles in shown order and the answer text.

    4, 6, 9, 12 or 16 tiles; a tile is `struct<col,row,x1,y1,x2,y2>` with whole-pixel sides.
    """
    key = [*_key(seed, epoch), F.col("image")]
    counts = list(GRIDS)
    at = F.pmod(rank32(*key, "tiles"), F.lit(len(counts))).cast("int")
    grid = None
    for n, count in enumerate(counts):
        options = F.array(*[F.struct(F.lit(c).alias("cols"), F.lit(r).alias("rows")) for c, r in GRIDS[count]])
        value = pick(options, *key, "grid")
        grid = F.when(at == n, value) if grid is None else grid.when(at == n, value)
    df = images.withColumn("_grid", grid)
    cols, rows = F.col("_grid.cols"), F.col("_grid.rows")
    tw, th = F.floor(F.col("width") / cols).cast("int"), F.floor(F.col("height") / rows).cast("int")

    def tile(i):
        c, r = F.floor(i / rows).cast("int"), (i % rows).cast("int")
        return F.struct(
            c.alias("col"), r.alias("row"), (c * tw).alias("x1"), (r * th).alias("y1"),
            ((c + 1) * tw).alias("x2"), ((r + 1) * th).alias("y2"),
        )

    tiles = shuffled(F.transform(F.sequence(F.lit(0), cols * rows - 1), tile), *key, "shown")
    shown = df.withColumn("tiles", tiles)
    pairs = F.transform(
        "tiles", lambda t: F.concat(F.lit("["), t["col"].cast("string"), F.lit(", "), t["row"].cast("string"), F.lit("]"))
    )
    answer = F.concat(F.lit("The order is: ["), F.array_join(pairs, ", "), F.lit("]."))
    return shown.select("class_id", "image", "tiles", answer.alias("answer"))


def jigsaw(images: DataFrame, seed: int = 0, epoch=0) -> DataFrame:
    """Puzzle episodes: one item per tile (`image#x1,y1,x2,y2`), then the whole image."""
    plan = tile_plan(images, seed, epoch)
    place = lambda t: F.concat(
        F.col("image"), F.lit("#"), F.array_join(F.array(t["x1"], t["y1"], t["x2"], t["y2"]).cast("array<string>"), ",")
    )
    support = F.transform("tiles", lambda t: item(place(t), TILE_QUESTION, END.strip()))
    query = item(F.col("image"), TILE_QUERY, F.col("answer"), QUERY_MODE)
    return _out(plan, F.concat(with_modes(support), F.array(query)), epoch)


# Evaluation episodes over test classes in long form (class_id, class_name, pos, image).


def eval_index(test_images: DataFrame, sample_per_class: int = 0) -> DataFrame:
    """One row per class and test image; the first n per class, or all of them for 0."""
    kept = test_images if sample_per_class == 0 else test_images.where(F.col("pos") < sample_per_class)
    return kept.select("class_id", "pos", "image")


def eval_index_from_lists(classes: DataFrame, sample_per_class: int = 0) -> DataFrame:
    """The same from class records with `test_samples` arrays."""
    long = classes.select("class_id", F.posexplode("test_samples").alias("pos", "image"))
    return eval_index(long, sample_per_class)


def eval_single(index: DataFrame, classes: DataFrame, shot: int) -> DataFrame:
    """Class name, its first `shot` context images and the test image; fewer images are an error."""
    known = classes.select("class_id", F.lower("class_name").alias("label"), _enough(F.col("context_samples"), shot).alias("context"))
    return index.join(known, "class_id")


def _two_way(own, other, own_name: Column, other_name: Column, query_image: Column, query_name: Column, key: list) -> Column:
    show = lambda images, name: F.transform(images, lambda x: item(x, SHOWN_QUESTION, there_is(name)))
    support = with_modes(shuffled(F.concat(show(own, own_name), show(other, other_name)), *key, "order"))
    return F.concat(support, F.array(item(query_image, EVAL_QUESTION, there_is(query_name, ""), QUERY_MODE)))


def _enough(images: Column, shot: int) -> Column:
    short = F.raise_error(F.lit(f"fewer than {shot} context images")).cast("array<string>")
    return F.when(F.size(images) < shot, short).otherwise(F.slice(images, 1, shot))


def eval_two_way(index: DataFrame, classes: DataFrame, shot: int, seed: int = 0) -> DataFrame:
    """Each test image against its class and the paired one (line 0 with 1, 2 with 3, ...).

    `classes`: row_id, class_id, class_name, context_samples, with an even row count.
    """
    side = classes.select(
        F.col("row_id").alias("_line"), F.lower("class_name").alias("nb_name"), _enough(F.col("context_samples"), shot).alias("nb_context")
    )
    alone = F.raise_error(F.lit("a class has no partner: the class count must be even")).cast("string")
    paired = (
        classes.select(
            "class_id", F.lower("class_name").alias("name"), _enough(F.col("context_samples"), shot).alias("context"),
            F.col("row_id").bitwiseXOR(F.lit(1)).alias("_line"),
        )
        .join(side, "_line", "left")
        .withColumn("nb_name", F.when(F.col("nb_name").isNull(), alone).otherwise(F.col("nb_name")))
    )
    rows = index.join(paired, "class_id")
    key = [seed, F.col("class_id"), F.col("pos")]
    items = _two_way(F.col("context"), F.col("nb_context"), F.col("name"), F.col("nb_name"), F.col("image"), F.col("name"), key)
    return rows.select("class_id", "pos", items.alias("items"))


def pair_two_way(pairs: DataFrame, shot: int, seed: int = 0) -> DataFrame:
    """Episodes from pair records, which carry both image lists and prompts; `row_id` is kept."""
    key = [seed, F.col("row_id")]
    items = _two_way(
        _enough(F.col("positive_list"), shot), _enough(F.col("negative_list"), shot),
        F.col("positive_promt"), F.col("negative_promt"), F.col("image_name"), F.col("label_name"), key,
    )
    return pairs.select("row_id", items.alias("items"))


def repeat_item(items: DataFrame, shot: int) -> DataFrame:
    """Converter output as an episode of the same item 2 x shot times."""
    one = F.struct("image", "target", "conversations")
    return items.select("row_id", F.array_repeat(one, 2 * shot).alias("items"))


def ad_hoc(sessions: DataFrame, mode: str = "examples") -> DataFrame:
    """Episodes from user sessions: `session, pos_images, pos_answer, neg_images, neg_answer, image, question`.

    `examples` shows both lists in the given order, then asks; `vqa` only asks.
    """
    if mode not in ("examples", "vqa"):
        raise ValueError(f"unknown mode: {mode}")
    asked = F.concat("question", F.lit(S.IMAGE))
    query = item(F.col("image"), asked, "", QUERY_MODE if mode == "examples" else "vicuna_v1.1")
    items = F.array(query)
    if mode == "examples":
        show = lambda images, answer: F.transform(images, lambda x: item(x, SHOWN_QUESTION, F.concat(answer, F.lit(END))))
        support = F.concat(show(F.col("pos_images"), F.col("pos_answer")), show(F.col("neg_images"), F.col("neg_answer")))
        items = F.concat(with_modes(support), items)
    return sessions.select("session", items.alias("items"))


def prompts(episodes: DataFrame, modes: Sequence[str] = EPISODE_MODES) -> DataFrame:
    """Adds `prompt`, the texts of all items one after the other, each under its own mode.

    Items after the first lose the end mark of their text unless they are last, as when token
    arrays are joined (`tokens.concat_episode`).
    """
    turns = lambda x: F.array(
        F.struct(F.lit("human").alias("from"), x["question"].alias("value")),
        F.struct(F.lit("gpt").alias("from"), x["answer"].alias("value")),
    )

    def text(x, at_edge):
        full = render_by_mode(x["mode"], turns(x), modes)
        return let(full, lambda f: F.when(at_edge, f).otherwise(F.regexp_replace(f, r"</s>$", "")))

    every = lambda items: F.transform(items, lambda x, i: text(x, (i == 0) | (i == F.size(items) - 1)))
    return episodes.withColumn("prompt", F.array_join(let(F.col("items"), every), ""))


def explode_items(episodes: DataFrame) -> DataFrame:
    """Long form: one row per item with its position."""
    others = [c for c in episodes.columns if c != "items"]
    return episodes.select(*others, explode_array(F.col("items"))).select(*others, "pos", "item.*")
