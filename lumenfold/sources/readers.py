"""Annotation files to DataFrames.

Where a file has no key and its order is meaning, lines get a dense number that is computed per
file block on the JVM: no pass over the data on one task, no Python rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenfold import schema as S
from lumenfold.session import scratch_dir
from lumenfold.sources import image_headers, json_object


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; unused fields are not parsed."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def number_lines(spark: SparkSession, path: str, per_file: bool = False) -> DataFrame:
    """Text lines with `file` and a dense 0-based `line_no`.

    A folder of part files counts as one file, its parts in name order; `per_file` starts over in
    each. Lines are numbered inside each file block; blocks are counted and their offsets joined
    back, one small row per block.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # Without partitions the window sees one row per file block, never the lines.
    order = Window.partitionBy("file").orderBy("_block") if per_file else Window.orderBy("file", "_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return lines.join(offsets, ["file", "_block"]).select(
        "file", (F.col("_offset") + F.col("_id") - F.col("_first")).alias("line_no"), "value"
    )


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with `row_id`, the line number that other files refer to."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return number_lines(spark, path).select(F.col("line_no").alias("row_id"), parsed.alias("r")).select("row_id", "r.*")


def base_name(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def entity_sentences(spark: SparkSession, path: str, id_pattern: str | None = None) -> DataFrame:
    """`image_id, sentence_no, sentence`: one file per image, one sentence per line, empty lines dropped.

    The image id is the file's base name, or group 1 of `id_pattern` on its path.
    """
    image = F.regexp_extract("file", id_pattern, 1) if id_pattern else base_name(F.col("file"))
    lines = number_lines(spark, path, per_file=True).where(F.length("value") > 0)
    return lines.select(image.alias("image_id"), F.col("line_no").alias("sentence_no"), F.col("value").alias("sentence"))


def entity_objects(spark: SparkSession, path: str, id_pattern: str | None = None) -> DataFrame:
    """XML annotations, one row per image and object name.

    `image_id, width, height, depth, object_no, box_id, box, nobox, scene`: `box` is null where
    the object has none, then the two flags say why. Coordinates are shifted by -1.
    """
    rows = (
        spark.read.format("xml").option("rowTag", "annotation").schema(S.ENTITY_XML).load(path)
        .withColumn("_file", F.input_file_name())
    )
    image = F.regexp_extract("_file", id_pattern, 1) if id_pattern else base_name(F.col("_file"))
    box = F.array(*[F.col(f"o.bndbox.{side}") - 1 for side in ("xmin", "ymin", "xmax", "ymax")])
    return (
        rows.select(image.alias("image_id"), "size.*", F.posexplode("object").alias("object_no", "o"))
        .select("*", F.explode("o.name").alias("box_id"))
        .select(
            "image_id", "width", "height", "depth", "object_no", "box_id",
            F.when(F.col("o.bndbox").isNotNull(), box).alias("box"),
            (F.col("o.bndbox").isNull() & (F.coalesce(F.col("o.nobndbox"), F.lit(0)) > 0)).alias("nobox"),
            (F.col("o.bndbox").isNull() & (F.coalesce(F.col("o.scene"), F.lit(0)) > 0)).alias("scene"),
        )
    )


def detection_tables(
    spark: SparkSession, path: str, range_bytes: int = json_object.RANGE_BYTES, root: str | None = None
) -> dict[str, DataFrame]:
    """Detection JSON as five tables.

    The object is cut into byte ranges, which are read once, side by side, and kept in the shared
    folder by member (`root`, else the session's); the tables are parsed from there.
    """
    whole = StructType.fromDDL(S.DETECTION)
    kept = scratch_dir(spark, root)
    members = json_object.read_members(spark, path, whole.names, range_bytes)
    members.write.partitionBy("tbl").parquet(kept)
    raw = spark.read.schema("key string, record string, tbl string").parquet(kept)

    def rows(name: str) -> DataFrame:
        kind = whole[name].dataType.elementType.simpleString()
        parsed = F.from_json("record", kind, {"mode": "FAILFAST"})
        return raw.where(F.col("tbl") == name).select(parsed.alias("r")).select("r.*")

    of = lambda name: raw.where(F.col("tbl") == name)
    neighbors = of("neighbors").select(
        F.col("key").cast("bigint").alias("category_id"), F.posexplode(F.from_json("record", "array<bigint>")).alias("pos", "neighbor_id"))
    return {
        "images": rows("images"), "annotations": rows("annotations"), "categories": rows("categories"),
        "neighbors": neighbors, "expired": of("expired_imgs").select(F.col("key").cast("bigint").alias("image_id")),
    }


def scenes_by_index(questions: DataFrame, scenes: DataFrame | None, index: DataFrame | None) -> DataFrame:
    """Question records with their scene's `objects`: image id to scene line to scene.

    Scenes (`row_id, objects`) and index (`imageId, line`) come together or not at all.
    """
    if (scenes is None) != (index is None):
        raise ValueError("scenes and index must be given together")
    if scenes is None:
        return questions.withColumn("objects", F.lit(None).cast("map<string,struct<x:int,y:int,w:int,h:int>>"))
    keyed = index.join(scenes.withColumnRenamed("row_id", "line"), "line").select("imageId", "objects")
    return questions.join(keyed, "imageId", "left")


def read_scene_index(spark: SparkSession, path: str) -> DataFrame:
    """`{imageId: line}` in one JSON object, read in pieces between commas, so that a large file is many tasks.

    A piece that is not one pair, as a key with a comma gives, is an error.
    """
    pieces = spark.read.text(path, lineSep=",")
    pair = F.concat(F.lit("{"), F.regexp_replace("value", r"^\s*\{|\}\s*$", ""), F.lit("}"))
    parsed = F.from_json(pair, "map<string,bigint>", {"mode": "FAILFAST"})
    return pieces.select(F.explode(parsed).alias("imageId", "line"))


def scenes_by_line(questions: DataFrame, scenes: DataFrame | None) -> DataFrame:
    """Question records with the scene at line `image_index`; null objects without a scene file."""
    if scenes is None:
        return questions.withColumn("objects", F.lit(None).cast("array<struct<pixel_coords:array<double>>>"))
    return questions.join(scenes.withColumnRenamed("row_id", "image_index"), "image_index", "left")


def load_templates(
    spark: SparkSession, template_string: str | None = None, template_file: str | None = None,
    max_dynamic_size: int | None = None,
) -> list[str]:
    """Template texts for the converters: a single text, or a JSON list of texts (first n if asked).

    A template file is configuration of some hundred lines, so it may pass through the driver.
    """
    if (template_string is None) == (template_file is None):
        raise ValueError("give either template_string or template_file")
    if template_string is not None:
        texts = [template_string]
    else:
        texts = json.loads(spark.read.text(template_file, wholetext=True).first()[0])
    return texts[:max_dynamic_size] if max_dynamic_size is not None else texts


def template_table(
    spark: SparkSession, path: str, max_dynamic_size: int | None = None, set_pattern: str | None = None
) -> DataFrame:
    """Template files as a table `set, pos, text`; repeats are kept, since they are weights.

    A set is named by its file, or by group 1 of `set_pattern` on the path.
    """
    file = F.col("_metadata.file_path")
    name = F.regexp_extract(file, set_pattern, 1) if set_pattern else base_name(file)
    whole = spark.read.text(path, wholetext=True).select(name.alias("set"), "value")
    out = whole.select("set", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "text"))
    return out if max_dynamic_size is None else out.where(F.col("pos") < max_dynamic_size)


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """`folder id name` lines; the first entry of a folder wins."""
    p = F.split("value", " ")
    lines = number_lines(spark, path).select(
        "line_no", p[0].alias("folder"), p[1].alias("class_id"), p[2].alias("class_name")
    )
    first = F.min_by(F.struct("class_id", "class_name"), "line_no").alias("c")
    return lines.groupBy("folder").agg(first, F.min("line_no").alias("line_no")).select("line_no", "folder", "c.*")


def train_list(spark: SparkSession, path: str) -> DataFrame:
    """`folder/image n` lines as `line_no, folder, path`."""
    image = F.split("value", " ")[0]
    return number_lines(spark, path).select("line_no", F.split(image, "/")[0].alias("folder"), image.alias("path"))


def val_list(spark: SparkSession, path: str, labels_path: str) -> DataFrame:
    """Validation images with the class id on the same line of the label file."""
    images = number_lines(spark, path).select("line_no", F.split("value", " ")[0].alias("path"))
    labels = number_lines(spark, labels_path).select("line_no", F.col("value").alias("class_id"))
    return images.join(labels, "line_no")


def ranked_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """Ranked-neighbour CSV in long form: `class_id, rank, neighbor_id`; the header line is skipped."""
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    lines = number_lines(spark, path, per_file=True).where(F.col("line_no") > 0).select(cells.alias("c"))
    return lines.select(
        F.col("c")[0].alias("class_id"), F.posexplode(F.slice("c", 2, 1 << 30)).alias("rank", "neighbor_id")
    )


def image_sizes(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """`image_id, path, width, height, bytes_read, problem` of image files; `folder` names the prefix that records omit.

    Sizes come from file headers; pixels are not read. A file that is no readable image keeps its row:
    its sizes are null and `problem` says why.
    """
    name = F.element_at(F.split("path", "/"), -1) if folder is None else F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    return image_headers.read_headers(spark, path).select(name.alias("image_id"), "path", "width", "height", "bytes_read", "problem")


def image_path(folder: str | None, path: Column) -> Column:
    return path if folder is None else F.concat_ws("/", F.lit(folder.rstrip("/")), path)


def with_sizes(items: DataFrame, sizes: DataFrame, on_error: str = "raise") -> DataFrame:
    """Items with the width and height of their image.

    An item that names an image without a size is an error; with `on_error="flag"` the column
    `size_problem` tells it from the others.
    """
    if on_error not in ("raise", "flag"):
        raise ValueError(f"on_error is 'raise' or 'flag': {on_error}")
    known = sizes.select(F.col("image_id").alias("image"), "width", "height")
    joined = items.join(known, "image", "left")
    missing = F.col("image").isNotNull() & F.col("width").isNull()
    if on_error == "flag":
        return joined.withColumn("size_problem", F.when(missing, F.lit("image without a size")))
    stop = F.raise_error(F.concat(F.lit("image without a size: "), F.col("image"))).cast("int")
    return joined.withColumn("width", F.when(missing, stop).otherwise(F.col("width")))
