"""Files written from the driver tables and read back by the package's readers."""

from __future__ import annotations

import functools
import sys

from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import load, query, show_boxes, show_seq, table
from checks.classes import RANKED_SQL, ranked
from checks.detection import tables as detection
from checks.metrics import _split
from lumenfold import schema as S
from lumenfold.operators.entities import flatten_sentences, parse_phrases
from lumenfold.session import scratch_dir
from lumenfold.sources import readers, sinks
from lumenfold.sources.json_object import open_store


@query("A1,A11", "select row_id, word, st, ax1 from records", ["records"])
def jsonl_round_trip(spark, sf):
    path = scratch_dir(spark)
    sinks.write_records(load(spark, sf, "records").select("row_id", "word", "st", "ax1"), path, ["st"])
    return readers.read_jsonl(spark, path, "row_id bigint, word string, st string, ax1 bigint")


@query("A1,A2", """select event_id row_id, event_id key, concat('{"k": ',json_extract(props,'$.k'),'}') raw from events""")
def numbered_records(spark, sf):
    """Line numbers over several part files must equal the order they were written in."""
    path = scratch_dir(spark)
    df = table(spark, sf, "events").select(F.col("event_id").alias("key"), F.col("props").alias("raw"))
    df.repartitionByRange(4, "key").sortWithinPartitions("key").write.json(path)
    return readers.read_records(spark, path, "key bigint, raw string")


@query("A3,G8", """
select c_custkey key, case when c_custkey%3=0 then 2 else 0 end n_phrases,
       case when c_custkey%3=0 then 'Two men ride a '||lower(c_mktsegment)||' bike .' else c_name||' stands [alone .' end sentence,
       case when c_custkey%3=0 then '0:Two men:1:people;3:a '||lower(c_mktsegment)||' bike:22:vehicles+other' else '' end phrases
from customer where c_custkey%3<>2""")
def entity_sentences(spark, sf):
    """One folder of sentence lines per nation; the id is cut from the path. Every third line is empty and dropped."""
    path = scratch_dir(spark)
    df = table(spark, sf, "customer")
    kind = F.col("c_custkey") % 3
    line = F.when(kind == 0, F.concat(F.lit("[/EN#1/people Two men] ride [/EN#22/vehicles/other a "), F.lower("c_mktsegment"), F.lit(" bike] . #"), "c_custkey")).when(
        kind == 1, F.concat("c_name", F.lit(" stands [alone . #"), "c_custkey")).otherwise(F.lit(""))
    df.select("c_nationkey", line.alias("value")).write.partitionBy("c_nationkey").text(path)
    got = readers.entity_sentences(spark, path, r"c_nationkey=(\d+)/")
    # The customer key travels as a last word that is cut off again before parsing.
    parts = F.split("sentence", " #")
    parsed = got.select(parts[1].cast("bigint").alias("key"), F.when(F.contains(parts[0], F.lit(" stands ")),
                        F.regexp_replace(parts[0], r"\[alone", "~alone")).otherwise(parts[0]).alias("s")).select("key", parse_phrases(F.col("s")).alias("p"))
    one = lambda p: F.concat_ws(":", p["first_word_index"].cast("string"), p["phrase"], p["phrase_id"], F.array_join(p["phrase_type"], "+"))
    return parsed.select("key", F.size("p.phrases").alias("n_phrases"), F.replace(F.col("p.sentence"), F.lit("~"), F.lit("[")).alias("sentence"),
                         F.array_join(F.transform("p.phrases", one), ";").alias("phrases"))


def _objects(spark, sf):
    """Per image (part number mod 500): each part is an object with two names, every fourth without a box."""
    box = F.struct((F.col("p_partkey") % 90 + 1).alias("xmin"), (F.col("p_partkey") % 70 + 1).alias("ymin"),
                   (F.col("p_partkey") % 90 + 31).alias("xmax"), (F.col("p_partkey") % 70 + 21).alias("ymax"))
    none = F.col("p_partkey") % 4 == 3
    obj = F.struct("p_partkey", F.array(F.col("p_size").cast("string"), (F.col("p_size") + 200).cast("string")).alias("name"),
                   F.when(~none, box).alias("bndbox"), F.when(none, F.floor(F.col("p_partkey") % 8 / 4)).alias("scene"),
                   F.when(none, F.lit(1)).alias("nobndbox"))
    plain = lambda o: F.struct(o["name"].alias("name"), o["bndbox"].alias("bndbox"), o["scene"].alias("scene"), o["nobndbox"].alias("nobndbox"))
    df = table(spark, sf, "part").groupBy((F.col("p_partkey") % 500).alias("image_id")).agg(F.array_sort(F.collect_list(obj)).alias("o"))
    return df.select("image_id", F.struct(F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit(3).alias("depth")).alias("size"),
                     F.transform("o", plain).alias("object"))


def _xml(spark, sf):
    path = scratch_dir(spark)
    _objects(spark, sf).write.partitionBy("image_id").format("xml").option("rowTag", "annotation").option("rootTag", "annotations").save(path)
    return readers.entity_objects(spark, path, r"image_id=(\d+)/")


_OBJ = """
o as (select p_partkey k, (p_partkey%500)::varchar image_id, dense_rank() over (partition by p_partkey%500 order by p_partkey)-1 object_no, p_size, d
      from part, (values (0),(200)) v(d)),
b as (select *, k%90||','||k%70||','||(k%90+30)||','||(k%70+20) bx from o)"""


@query("A4", f"""with {_OBJ} select image_id, object_no::integer object_no, (p_size+d)::varchar box_id, case when k%4<>3 then bx end box, k%4=3 nobox, k%8=7 scene, 640 width from b""")
def entity_objects(spark, sf):
    return _xml(spark, sf).select("image_id", "object_no", "box_id", F.array_join(F.col("box").cast("array<string>"), ",").alias("box"), "nobox", "scene", "width")


# Ids per image in the order phrases mention them: first p_size, then p_size + 100 (never boxed) and p_size + 200.


@query("G9", f"""with {_OBJ},
ids as (select image_id, p_size+d id, string_agg(bx,';' order by object_no) boxes, count(*) n from b where k%4<>3 group by image_id, p_size+d),
s as (select p_partkey row_id, (p_partkey%500)::varchar image_id, p_size, p_name, lower(p_brand) br, lower(p_type) ty from part)
select row_id, coalesce(i.boxes,'') boxes, case when i.n is null then '' else (select string_agg(g::varchar,',' order by g) from range(i.n) t(g)) end seq,
       case when i.n is null then 'A '||p_name else '<ph_st>A '||p_name||'<ph_ed>' end||' lies near '||
       case when j.n is null then 'the '||ty||' thing' else '<ph_st>the '||ty||' thing<ph_ed>' end||' in sunlight .' sentence
from s left join ids i on i.image_id=s.image_id and i.id=p_size left join ids j on j.image_id=s.image_id and j.id=p_size+100""")
def flatten_entities(spark, sf):
    """Sizes are below 100, so that the second phrase never has a box here; tests cover several boxed phrases."""
    sentences = load(spark, sf, "sentences").select("image_id", F.col("row_id").alias("sentence_no"), "sentence")
    df = flatten_sentences(sentences, _xml(spark, sf))
    return df.select(F.col("sentence_no").alias("row_id"), show_boxes(F.col("boxes")).alias("boxes"), show_seq(F.col("boxes_seq")).alias("seq"), "sentence")


def _write_objects(path: str, members: dict, ids: int = 20000) -> None:
    """A file with one JSON object for every `ids` ids; members: name to (rows, id, brackets, JSON text of a row).

    Rows are sorted into their object and written one by one: no task holds an object, however many rows it has.
    """
    parts = [df.select(F.floor(F.col(key) / ids).alias("chunk"), F.lit(m).alias("m"), text.alias("text")) for m, (df, key, _, text) in enumerate(members.values())]
    rows = functools.reduce(lambda a, b: a.union(b), parts)
    order = Window.partitionBy("chunk").orderBy("m")
    rows = rows.select("*", F.row_number().over(order).alias("n"), F.lag("m").over(order).alias("before"), F.lead("m").over(order).alias("after"))
    opens = F.array(*[F.lit(f'"{name}":{brackets[0]}') for name, (_, _, brackets, _) in members.items()])
    closes = F.array(*[F.lit(brackets[1]) for _, _, brackets, _ in members.values()])
    start = F.when(F.col("before").isNull(), F.concat(F.lit("{"), opens[F.col("m")])).when(F.col("before") == F.col("m"), F.lit(",")).otherwise(
        F.concat(closes[F.col("before")], F.lit(","), opens[F.col("m")]))
    end = F.when(F.col("after").isNull(), F.concat(closes[F.col("m")], F.lit("}"))).otherwise(F.lit(""))
    placed = rows.select("chunk", "n", F.concat(start, "text", end).alias("value")).sortWithinPartitions("chunk", "n")
    placed.select("chunk", "value").write.partitionBy("chunk").text(path)


@query("A5", """select 'images' "table", id key, width::varchar "value" from detection_images union all
select 'annotations', id, image_id||':'||category_id||':'||x||','||y||','||w||','||h from annotations union all
select 'categories', id, "name" from categories union all
select 'neighbors', id, pos||':'||(case when id%5=0 then 26 else (id+pos*3)%27+1 end) from categories, range(8) p(pos) union all
select 'expired', image_id, null from expired""", ["annotations", "categories", "detection_images", "expired"])
def detection_json(spark, sf):
    """JSON objects of 20,000 images and annotations each, as such files are, every one read in ranges of 256 KB."""
    cats, ann, images, neighbors, expired = detection(spark, sf)
    path = scratch_dir(spark)
    nb = neighbors.groupBy("category_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "neighbor_id"))), lambda s: s["neighbor_id"]).alias("ids"))
    record = lambda *cols: F.to_json(F.struct(*cols))

    def entry(key, value):  # an object of one entry, without its braces
        one = F.to_json(F.create_map(F.col(key).cast("string"), value))
        return F.substr(one, F.lit(2), F.length(one) - 2)

    _write_objects(path, {
        "images": (images, "id", "[]", record("id", "file_name", "width", "height")),
        "annotations": (ann, "image_id", "[]", record("id", "image_id", "category_id", "bbox")),
        "categories": (cats, "id", "[]", record("id", "name")),
        "neighbors": (nb, "category_id", "{}", entry("category_id", F.col("ids"))),
        "expired_imgs": (expired, "image_id", "{}", entry("image_id", F.lit("x"))),
    })
    get = readers.detection_tables(spark, path, range_bytes=1 << 18)
    rows = lambda name, key, value: get[name].select(F.lit(name).alias("table"), F.col(key).alias("key"), value.alias("value"))
    nums = lambda c: F.array_join(F.col(c).cast("array<bigint>").cast("array<string>"), ",")
    return (
        rows("images", "id", F.col("width").cast("string"))
        .union(rows("annotations", "id", F.concat_ws(":", F.col("image_id").cast("string"), F.col("category_id").cast("string"), nums("bbox"))))
        .union(rows("categories", "id", F.col("name")))
        .union(rows("neighbors", "category_id", F.concat_ws(":", F.col("pos").cast("string"), F.col("neighbor_id").cast("string"))))
        .union(rows("expired", "image_id", F.lit(None).cast("string")))
    )


@query("A6", """select c_custkey row_id, 'im'||c_custkey image_id, case when c_custkey%7<>6 then c_nationkey end x from customer""")
def scenes_by_index(spark, sf):
    """Scenes in reverse line order behind an index; every seventh image has no scene."""
    df = table(spark, sf, "customer")
    path = scratch_dir(spark)
    image = F.concat(F.lit("im"), "c_custkey")
    scene = F.create_map(F.lit("1"), F.struct(F.col("c_nationkey").alias("x"), F.lit(0).alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h")))
    with_scene = df.where("c_custkey % 7 <> 6")
    with_scene.select(F.col("c_custkey").alias("key"), scene.alias("objects")).repartitionByRange(4, F.desc("key")).sortWithinPartitions(F.desc("key")).write.json(path)
    scenes = readers.read_records(spark, path, S.GQA_SCENE)
    keys = readers.read_records(spark, path, "key bigint")
    # The index is a file too, an object per 100,000 keys.
    pairs = keys.groupBy(F.floor(F.col("key") / 100000).alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("im"), "key"), "row_id"))).alias("m"))
    index_path = scratch_dir(spark)
    pairs.select("block", F.to_json("m").alias("value")).write.partitionBy("block").text(index_path)
    index = readers.read_scene_index(spark, index_path).select("imageId", "line")
    questions = df.select(F.col("c_custkey").alias("row_id"), image.alias("imageId"))
    out = readers.scenes_by_index(questions, scenes, index)
    return out.select("row_id", F.col("imageId").alias("image_id"), F.col("objects")["1"]["x"].alias("x"))


@query("A8", """
with t as (select (item_id//20)::varchar as "set", item_id%20 pos, text from benchmark) select * from t where pos<10""")
def template_table(spark, sf):
    """Sets of twenty texts, one JSON list each; the first ten of every set are kept."""
    path = scratch_dir(spark)
    df = table(spark, sf, "benchmark").withColumn("set", F.floor(F.col("item_id") / 20))
    texts = df.groupBy("set").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("t"))
    texts.select("set", F.to_json(F.transform("t", lambda t: t["text"])).alias("value")).write.partitionBy("set").text(path)
    out = readers.template_table(spark, path, 10, r"set=(\d+)/")
    return out.select("set", F.col("pos").cast("bigint").alias("pos"), "text")


@query("A9", """
select line_no, 'train' part, class_id, path from (
  select row_number() over (order by vec_id)-1 line_no, label::varchar class_id, 'n'||label||'/v'||vec_id path from embeddings where vec_id%5<>0) union all
select line_no, 'val', class_id, path from (
  select row_number() over (order by vec_id)-1 line_no, label::varchar class_id, 'v'||vec_id path from embeddings where vec_id%5=0)""")
def class_list_files(spark, sf):
    """Folder map with a repeated folder, train list, validation list and labels as text files."""
    df = table(spark, sf, "embeddings")

    def write(rows, line):
        path = scratch_dir(spark)
        rows.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").select(line.alias("value")).write.text(path)
        return path

    first = df.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    again = first.select("label", (F.col("vec_id") + 1000000).alias("vec_id"))
    entry = F.concat(F.lit("n"), "label", F.lit(" "), F.when(F.col("vec_id") < 1000000, F.col("label")).otherwise(F.lit(99)), F.lit(" name_"), "label")
    folders = readers.class_map(spark, write(first.union(again), entry))
    train = readers.train_list(spark, write(df.where("vec_id % 5 <> 0"), F.concat(F.lit("n"), "label", F.lit("/v"), "vec_id", F.lit(" 1"))))
    v = df.where("vec_id % 5 = 0")
    val = readers.val_list(spark, write(v, F.concat(F.lit("v"), "vec_id", F.lit(" 1"))), write(v, F.col("label").cast("string")))
    return train.join(folders.drop("line_no"), "folder").select("line_no", F.lit("train").alias("part"), "class_id", "path").union(
        val.select("line_no", F.lit("val").alias("part"), "class_id", "path"))


@query("A10", f"with {RANKED_SQL} select class_id::varchar class_id, rank::integer rank, neighbor_id::varchar neighbor_id from rk", ["vectors"])
def ranked_csv(spark, sf):
    path = scratch_dir(spark)
    sinks.write_ranked(ranked(spark, sf), path)
    return readers.ranked_neighbours(spark, path)


@query("A12", "select test_set, row_id, pred, target from predictions", ["predictions"])
def prediction_sink(spark, sf):
    """Two batches, one per half of the rows; both are written twice, and a third attempt breaks off before its commit."""
    path = scratch_dir(spark)
    preds, targets = _split(spark, sf)
    rows = targets.join(preds, "row_id")
    for half in (0, 1, 0, 1):
        sinks.write_predictions(rows.where(F.col("row_id") % 2 == half), path, f"run 7/half {half}")
    rows.write.partitionBy("test_set").json(f"{path}/batch=broken")
    return sinks.read_predictions(spark, path)


# One image for each priority, status and month: all orders make its size. A ninth of the files are no images
# or cut short; the formats take turns.
_IMAGES = """
select concat(replace(lower(o_orderpriority),' ','_'),'_',o_orderstatus,'_',ym) image, width, height, (width+height)%9 fate,
       case (width*7+height)%4 when 0 then 'png' when 1 then 'jpeg' when 2 then 'gif' else 'webp' end kind
from (select o_orderpriority, o_orderstatus, substr(cast(o_orderdate as string),1,7) ym,
             cast(1+count(*) as int) width, cast(1+sum(o_custkey)%4000 as int) height from {orders} group by 1, 2, 3) t"""


def _image_bytes(kind: str, width: int, height: int) -> bytes:
    """A header of the format, with a long thumbnail segment in JPEG, and a body that no reader needs."""
    big, little = (lambda n, k: n.to_bytes(k, "big")), (lambda n, k: n.to_bytes(k, "little"))
    body = bytes(20_000)
    if kind == "png":
        return b"\x89PNG\r\n\x1a\n" + big(13, 4) + b"IHDR" + big(width, 4) + big(height, 4) + body
    if kind == "gif":
        return b"GIF89a" + little(width, 2) + little(height, 2) + body
    if kind == "webp":
        return b"RIFF" + little(len(body), 4) + b"WEBPVP8X" + little(10, 4) + bytes(4) + little(width - 1, 3) + little(height - 1, 3) + body
    exif = b"\xff\xe1" + big(8002, 2) + bytes(8000)
    return b"\xff\xd8\xff\xe0" + big(16, 2) + bytes(14) + exif + b"\xff\xff\xc2" + big(17, 2) + b"\x08" + big(height, 2) + big(width, 2) + body


def _write_images(rows, path: str) -> None:
    """Files of `image, kind, width, height, fate` by the tasks that hold the rows; 0 writes no image, 1 stops inside the header."""

    def write(some):
        fs, root = open_store(path)
        fs.create_dir(root, recursive=True)
        for r in some:
            data = _image_bytes(r["kind"], r["width"], r["height"])
            with fs.open_output_stream(f"{root}/{r['image']}") as out:
                out.write(b"not an image, but a text" if r["fate"] == 0 else data[:9] if r["fate"] == 1 else data)

    rows.foreachPartition(write)


@query("A13", f"""with i as ({_IMAGES.format(orders='orders')})
select image, case when fate>1 then width end width, case when fate>1 then height end height, fate<2 unsized, 'folder/'||image path, true few_bytes,
       case fate when 0 then 'unknown kind of image' when 1 then 'file cut short' end problem from i""")
def image_size_join(spark, sf):
    """Sizes read off the headers of image files and joined to the items that name them."""
    images = spark.sql(_IMAGES, orders=table(spark, sf, "orders"))
    path = scratch_dir(spark)
    _write_images(images, path)
    sizes = readers.image_sizes(spark, path)
    out = readers.with_sizes(images.select("image"), sizes, on_error="flag")
    read = sizes.select(F.col("image_id").alias("image"), (F.col("bytes_read") <= 2048).alias("few_bytes"), "problem")
    return out.join(read, "image").select(
        "image", "width", "height", F.col("size_problem").isNotNull().alias("unsized"),
        readers.image_path("folder/", F.col("image")).alias("path"), "few_bytes", "problem")


# The tasks that write images need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
