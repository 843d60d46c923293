"""Boxes, points and coordinate text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import box, load, query, show_seq
from lumenfold import schema as S
from lumenfold.functions.binding import explode_items
from lumenfold.functions import coords, geometry

CORNERS = ("x1", "y1", "x2", "y2")


def _corners(df, expr, *keep):
    return df.withColumn("_b", expr).select(*keep, *[F.col("_b")[i].cast("double").alias(c) for i, c in enumerate(CORNERS)])


def norm(v: str, size: str) -> str:
    return f"printf('%.3f',greatest(0.0,least({v}/{size},1.0)))::double"


def plain(p: str, w: str = "width", h: str = "height") -> str:
    parts = [norm(f"{p}x1", w), norm(f"{p}y1", h), norm(f"{p}x2", w), norm(f"{p}y2", h)]
    return "'['||" + "||','||".join(f"printf('%.3f',{e})" for e in parts) + "||']'"


def point(x: str, y: str) -> str:
    return f"'['||printf('%.3f',{norm(x, 'width')})||','||printf('%.3f',{norm(y, 'height')})||']'"


@query("E1", f"""select image_id, pos, {norm('x1','width')} x1, {norm('y1','height')} y1, {norm('x2','width')} x2,
       {norm('y2','height')} y2 from boxes""", ["boxes"])
def norm_box(spark, sf):
    df = load(spark, sf, "boxes")
    return _corners(df, geometry.norm_box(box(""), F.col("width"), F.col("height")), "image_id", "pos")


@query("E2", """select image_id, pos, greatest(0.0,least(x2/width,1.0)) x, greatest(0.0,least(y2/height,1.0)) y
       from boxes""", ["boxes"])
def norm_point(spark, sf):
    p = geometry.norm_point(F.array("x2", "y2"), F.col("width"), F.col("height"))
    return load(spark, sf, "boxes").select("image_id", "pos", p[0].alias("x"), p[1].alias("y"))


@query("E3", f"""select image_id, pos, {norm('x1','width')}*width x1, {norm('y1','height')}*height y1,
       {norm('x2','width')}*width x2, {norm('y2','height')}*height y2 from boxes""", ["boxes"])
def denorm_box(spark, sf):
    w, h = F.col("width"), F.col("height")
    return _corners(load(spark, sf, "boxes"), geometry.denorm_box(geometry.norm_box(box(""), w, h), w, h), "image_id", "pos")


@query("E4", """select image_id, pos, x1::double x1, y1::double y1, least(x1+x2,width)::double x2,
       least(y1+y2,height)::double y2 from boxes""", ["boxes"])
def xywh_to_xyxy(spark, sf):
    return _corners(load(spark, sf, "boxes"), geometry.xywh_to_xyxy(box(""), F.col("width"), F.col("height")), "image_id", "pos")


@query("E5", """
with t as (select image_id, pos, width, height, x1-30 ax, y1-30 ay,
                  x1-30+x2%50-25 bx, y1-30+y2%50-25 cy from boxes)
select image_id, pos, greatest(ax,0)::double x1, greatest(ay,0)::double y1,
       least(case when ax>bx then ax+1 else bx end,width)::double x2,
       least(case when ay>cy then ay+1 else cy end,height)::double y2 from t""", ["boxes"])
def clean_box(spark, sf):
    df = load(spark, sf, "boxes")
    raw = F.array(*[F.expr(e).cast("double") for e in ("x1-30", "y1-30", "x2%50-25", "y2%50-25")])
    return _corners(df, geometry.clean_box(geometry.xywh_to_xyxy(raw), F.col("width"), F.col("height")), "image_id", "pos")


@query("E6,E7,E8", """
with t as (select *, case when height>width then (height-width)//2 else 0 end l,
                  case when width>height then (width-height)//2 else 0 end t from boxes)
select image_id, pos, (x1+l)::double x1, (y1+t)::double y1, (x2+l)::double x2, (y2+t)::double y2,
       (x1+l)::double px, (y2+t)::double py, greatest(width,height) side from t""", ["boxes"])
def expand_to_square(spark, sf):
    df = load(spark, sf, "boxes")
    aim = F.struct(
        F.array(box("")).alias("boxes"), F.array(F.array(F.col("x1").cast("double"), F.col("y2").cast("double"))).alias("points")
    )
    out = df.withColumn("t", geometry.expand_target(aim, F.col("width"), F.col("height")))
    return out.select(
        "image_id", "pos", *[F.col("t.boxes")[0][i].alias(c) for i, c in enumerate(CORNERS)],
        F.col("t.points")[0][0].alias("px"), F.col("t.points")[0][1].alias("py"),
        geometry.square_side(F.col("width"), F.col("height")).alias("side"),
    )


@query("E9,E10", f"""select row_id, '['||substr({plain('b')},2,23)||';'||substr({plain('a')},2,23)||']'||{plain('a')} shown
       from records""", ["records"])
def format_boxes(spark, sf):
    w, h = F.col("width"), F.col("height")
    values = F.array(geometry.norm_box(box("a"), w, h), geometry.norm_box(box("b"), w, h))
    groups = coords.take_all(values, F.expr("array(array(1,0),array(0))"))
    return load(spark, sf, "records").select(
        "row_id", F.array_join(F.transform(groups, lambda g: coords.format_plain(g)), "").alias("shown")
    )


@query("E11", f"""
select row_id, n, {norm('ax1','width')} x1, {norm('ay1','height')} y1, {norm('ax2','width')} x2, {norm('ay2','height')} y2
from records, (values (0),(1)) v(n)
""", ["records"])
def parse_boxes(spark, sf):
    w, h = F.col("width"), F.col("height")
    shown = coords.format_plain(F.array(geometry.norm_box(box("a"), w, h)))
    text = F.concat(F.lit("it is "), shown, F.lit(" or "), shown, F.lit(", not [1,2] or [12.0,1,1,1]."))
    df = load(spark, sf, "records").select("row_id", explode_items(coords.parse_plain_boxes(text), "n", "g"))
    return df.select("row_id", "n", *[F.col("g")[0][i].alias(c) for i, c in enumerate(CORNERS)])


@query("E12", f"select row_id, {norm('ax1','width')} x, {norm('ay1','height')} y from records", ["records"])
def parse_points(spark, sf):
    w, h = F.col("width"), F.col("height")
    p = geometry.norm_point(F.array(F.col("ax1"), F.col("ay1")), w, h)
    text = F.concat(F.lit("at "), coords.format_plain(F.array(p)), F.lit(" ."))
    got = coords.parse_plain_points(text)
    return load(spark, sf, "records").select("row_id", got[0][0][0].alias("x"), got[0][0][1].alias("y"))


def _bin(e: str) -> str:
    return f"round_even({e}*1000,0)::bigint"


_TOKENS = "'<b_st>'||" + "||' '||".join(
    f"'<bin_'||{_bin(norm('a' + c, 'width' if c[0] == 'x' else 'height'))}||'>'" for c in CORNERS) + "||'<b_ed>'"


@query("E13", f"""select row_id, {_TOKENS} shown, {_bin(norm('ax2','width'))}/1000 x2,
       {_bin(norm('by1','height'))}/1000 py from records""", ["records"])
def bin_tokens(spark, sf):
    w, h = F.col("width"), F.col("height")
    shown = coords.format_box_tokens(F.array(geometry.norm_box(box("a"), w, h)))
    rounded = F.transform(geometry.norm_point(F.array(F.col("bx1"), F.col("by1")), w, h), lambda x: geometry.round_exact(x))
    points = coords.format_point_tokens(F.array(rounded))
    return load(spark, sf, "records").select(
        "row_id", shown.alias("shown"), coords.parse_box_tokens(shown)[0][0][2].alias("x2"),
        coords.parse_point_tokens(points)[0][0][1].alias("py"),
    )


@query("E14", "select row_id, 'a '||word||' {} near '||st||'!' filled from records", ["records"])
def fill_placeholders(spark, sf):
    text = F.lit("a <boxes> {} near <boxes>!")
    return load(spark, sf, "records").select("row_id", coords.fill(text, S.BOXES, F.array("word", "st")).alias("filled"))


def _turns(*turns):
    from lumenfold.operators.convert.base import turn

    return F.array(*[turn(*t) for t in turns])


def _seq(text: str):
    return F.expr(text).cast(S.SEQ)


@query("E15", f"""
select row_id, 0 turn, 'where is '||word||' <boxes>?' as "value", null raw_value from records union all
select row_id, 1, 'at '||{plain('a')}||' and ['||substr({plain('b')},2,23)||';'||substr({plain('a')},2,23)||'] or '||{point('ax1','by2')},
       'at <boxes> and <boxes> or <points>' from records union all
select row_id, 2, 'fine', 'fine' from records""", ["records"])
def fill_conversation(spark, sf):
    aim = F.struct(F.array(box("a"), box("b")).alias("boxes"),
                   F.array(F.array(F.col("ax1").cast("double"), F.col("by2").cast("double"))).alias("points"))
    turns = _turns(
        ("human", F.concat(F.lit("where is "), "word", F.lit(" <boxes>?"))),
        ("gpt", "at <boxes> and <boxes> or <points>", _seq("array(array(0),array(1,0))"), _seq("array(array(0))")),
        ("human", "fine", _seq("array()")),
    )
    df = load(spark, sf, "records")
    out = coords.fill_conversation(turns, aim, F.col("width"), F.col("height"))
    return df.select("row_id", explode_items(out, "turn", "t")).select("row_id", "turn", "t.value", "t.raw_value")


@query("E16", f"""select row_id, {plain("b", "(2*width)", "(2*height)")}||' then '||{plain('a')}||' at '||
       '['||printf('%.3f',{norm('bx1','(2*width)')})||','||printf('%.3f',{norm('by1','(2*height)')})||']' as "value"
       from records""", ["records"])
def fill_multi_image(spark, sf):
    one = lambda p, k: F.struct(
        F.array(box(p)).alias("boxes"),
        F.array(F.array(F.col(f"{p}x1").cast("double"), F.col(f"{p}y1").cast("double"))).alias("points"),
        (F.col("width") * k).alias("width"), (F.col("height") * k).alias("height"),
    )
    targets = F.array(one("a", 1), one("b", 2))
    pair = lambda i: F.expr(f"named_struct('img',{i},'box',0)")
    turns = F.array(F.struct(
        F.lit("human").alias("from"), F.lit("<boxes> then <boxes> at <points>").alias("value"),
        F.array(F.array(pair(1)), F.array(pair(0))).alias("boxes_seq"), F.array(F.array(pair(1))).alias("points_seq"),
    ))
    return load(spark, sf, "records").select("row_id", coords.fill_multi_image(turns, targets)[0]["value"].alias("value"))


@query("E17", """
select row_id, case when bx1%2=0 then 2 else 3 end n_boxes, case when bx1%2=0 then '0;1,0;1' else '0;1,0;2' end seq
from records""", ["records"])
def dedup_boxes(spark, sf):
    last = F.when(F.col("bx1") % 2 == 0, box("b")).otherwise(F.transform(box("b"), lambda x: x + 0.5))
    groups = F.array(F.array(box("a")), F.array(box("b"), box("a")), F.array(last))
    values = geometry.first_seen(F.flatten(groups))
    return load(spark, sf, "records").select(
        "row_id", F.size(values).alias("n_boxes"), show_seq(geometry.positions_in(values, groups)).alias("seq")
    )
