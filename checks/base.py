"""Queries over the driver tables and the SQL that must give the same rows.

A query reads an input (a table, or a derivation whose SQL runs unchanged on both engines),
applies operators of the package and returns flat columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}

INPUTS = {
    "images": """
        select o_orderkey image_id, cast(320+o_custkey%321 as int) width, cast(240+o_custkey%241 as int) height
        from {orders}""",
    "boxes": """
        select l_orderkey image_id, l_linenumber pos,
               cast(least(x,width-1) as int) x1, cast(least(y,height-1) as int) y1,
               cast(least(least(x,width-1)+bw,width+40) as int) x2,
               cast(least(least(y,height-1)+bh,height+40) as int) y2,
               cast(width as int) width, cast(height as int) height
        from (select l_orderkey, l_linenumber, l_partkey%640 x, (l_suppkey*7)%480 y,
                     20+l_partkey%200 bw, 20+l_suppkey%150 bh,
                     320+o_custkey%321 width, 240+o_custkey%241 height
              from {lineitem} join {orders} on l_orderkey=o_orderkey) t""",
    "predictions": """
        select event_id row_id, concat('The answer is ',event_type,'.') target,
               case when event_id%10=0 then 'no idea' when event_id%5=1 then 'The answer is other.'
                    else concat('So the answer is ',event_type,'.') end pred,
               case when event_id%3=0 then 'set_a' when event_id%3=1 then 'set_b' else 'set_c' end test_set
        from {events}""",
    "box_predictions": """
        select o_orderkey row_id, o_custkey%300 tx1, (o_custkey*7)%200 ty1,
               o_custkey%300+20+o_orderkey%50 tx2, (o_custkey*7)%200+10+o_orderkey%30 ty2,
               o_orderkey%13 dx, o_orderkey%7 dy, o_orderkey%20 miss
        from {orders}""",
    "vectors": """
        select vec_id, label class_id, concat('class_',cast(label as string)) class_name,
               concat('img_',cast(vec_id as string),'.jpg') image, vec_id%2 modality, embedding
        from {embeddings}""",
    "class_images": """
        select vec_id, label class_id, concat('class_',cast(label as string)) class_name,
               concat('img_',cast(vec_id as string),'.jpg') image
        from {embeddings}""",
    "records": """
        select o_orderkey row_id, cast(o_orderkey as string) id_text,
               cast(320+o_custkey%321 as int) width, cast(240+o_custkey%241 as int) height,
               replace(lower(o_orderpriority),' ','_') word, lower(o_orderstatus) st,
               case when o_orderkey%2=0 then 'yes' else 'no' end answer,
               o_custkey%300 ax1, (o_custkey*7)%200 ay1,
               o_custkey%300+20+o_orderkey%50 ax2, (o_custkey*7)%200+10+o_orderkey%30 ay2,
               400+o_orderkey%200 bx1, (o_orderkey*3)%150 by1,
               440+o_orderkey%200+o_custkey%60 bx2, (o_orderkey*3)%150+30+o_custkey%40 by2,
               o_custkey%4 r_label, o_orderkey%4 a_label
        from {orders}""",
    "questions": """
        select event_id row_id, event_id%(select count(*) from {customer}) image_index,
               concat('scene_',cast(event_id as string),'.png') image, user_id, event_type
        from {events}""",
    "scenes": """
        select c_custkey row_id, cast(c_custkey%480 as double) x0, cast(c_nationkey*3 as double) y0 from {customer}""",
    "annotations": """
        select ((l_orderkey*1000003+l_partkey)*100003+l_suppkey)*8+l_linenumber id,
               l_orderkey image_id, cast(substr(p_brand,7) as bigint) category_id,
               l_partkey%640-5 x, (l_suppkey*7)%480-5 y, 20+l_partkey%200 w, 20+l_suppkey%150 h
        from {lineitem} join {part} on l_partkey=p_partkey""",
    "categories": """
        select cast(substr(p_brand,7) as bigint) id, concat('brand ',min(substr(p_brand,7))) name from {part}
        group by cast(substr(p_brand,7) as bigint)""",
    "detection_images": """
        select o_orderkey id, concat('img_',cast(o_orderkey as string),'.jpg') file_name,
               cast(320+o_custkey%321 as int) width, cast(240+o_custkey%241 as int) height from {orders}""",
    # Every image of one category is expired.
    "expired": """
        select o_orderkey image_id from {orders} where o_orderstatus='P' and o_custkey%5=0 union
        select l_orderkey from {lineitem} join {part} on l_partkey=p_partkey where cast(substr(p_brand,7) as bigint)=13""",
    "turns": """
        select conv_id, cast(row_number() over (partition by conv_id order by turn)-1 as bigint) position, role, text, sys
        from (select *, min_by(case when role='system' then text end, case when role='system' then turn end)
                        over (partition by conv_id) sys from {conversations}) c
        where role<>'system'""",
    "sentences": """
        select p_partkey row_id, cast(p_partkey%500 as string) image_id,
               concat('[/EN#',cast(p_size as string),'/',lower(p_type),' A ',p_name,'] lies near [/EN#',
                      cast(p_size+100 as string),'/other/',lower(p_brand),' the ',lower(p_type),' thing] in sunlight .') sentence,
               p_size, p_type, p_name, p_brand
        from {part}""",
}

# Inputs of converters, which do much work per row. The driver tables are files of one row group, which
# Spark cannot split, so these rows are dealt out once; tables of many files need no such step.
WIDE = {"records", "questions", "sentences", "box_predictions"}


def _fields(sql: str) -> list[str]:
    return sorted({f for _, f, _, _ in Formatter().parse(sql) if f})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    sql = INPUTS[name]
    df = spark.sql(sql, **{t: table(spark, sf, t) for t in _fields(sql)})
    # A number, so that adaptive execution does not join small partitions of rows that are slow to convert.
    return df.repartition(spark.sparkContext.defaultParallelism, "row_id") if name in WIDE else df


def query(ids: str, sql: str | None = None, inputs: Sequence[str] = (), name: str | None = None):
    """Register a query under its function name; `ids` are the operators it covers."""

    def add(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise KeyError(f"query registered twice: {key}")
        QUERIES[key] = fn
        OPERATORS[key] = ids
        if sql is not None:
            ORACLES[key] = with_inputs(inputs, sql)
        return fn

    return add


def with_inputs(inputs: Sequence[str], sql: str) -> str:
    parts = [f"{n} as ({INPUTS[n].format(**{t: t for t in _fields(INPUTS[n])})})" for n in inputs]
    if not parts:
        return sql.strip()
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join(parts) + ", " + body[5:]
    return "with " + ", ".join(parts) + " " + body


# Texts of DuckDB expressions.


def _key(parts) -> str:
    return ",".join(f"'{p[1:]}'" if isinstance(p, str) and p.startswith("=") else str(p) for p in parts)


def digest(*parts) -> str:
    """md5 of key parts; numbers are literals, `=x` is the text x, anything else an expression."""
    return f"md5(concat_ws('|',{_key(parts)}))"


def rank32(*parts) -> str:
    return f"('0x'||substr({digest(*parts)},1,8))::BIGINT"


def order60(*parts) -> str:
    return f"('0x'||substr({digest(*parts)},1,15))::BIGINT"


def text_list(texts: Sequence[str]) -> str:
    return "[" + ",".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


def pick(array: str, size, *parts) -> str:
    return f"({array})[(1+{rank32(*parts)}%{size})::INT]"


def template_sql(texts: Sequence[str], *parts) -> str:
    return pick(text_list(texts), len(texts), *parts, "=template")


def word_sql(low: int, high: int, *parts) -> str:
    size = f"({low}+{rank32(*parts, '=len')}%{high - low + 1})"
    return (
        f"array_to_string(list_transform(range(1,({size}+1)::BIGINT), "
        f"lambda q: chr((97+(('0x'||substr({digest(*parts, '=word')},(2*q-1)::INT,2))::BIGINT%26))::INT)),'')"
    )


# Flat views of nested columns.


def show_boxes(boxes: Column) -> Column:
    one = lambda b: F.array_join(F.transform(b, lambda x: x.cast("bigint").cast("string")), ",")
    return F.array_join(F.transform(boxes, one), ";")


def show_seq(seq: Column) -> Column:
    return F.array_join(F.transform(seq, lambda g: F.array_join(g.cast("array<string>"), ",")), ";")


def flat_items(items: DataFrame) -> DataFrame:
    """Two-turn items as scalars."""
    q, a = F.col("conversations")[0], F.col("conversations")[1]
    return items.select(
        "row_id", "image",
        show_boxes(F.col("target.boxes")).alias("boxes"), show_boxes(F.col("target.points")).alias("points"),
        q["value"].alias("q"), show_seq(q["boxes_seq"]).alias("q_boxes"), show_seq(q["points_seq"]).alias("q_points"),
        a["value"].alias("a"), show_seq(a["boxes_seq"]).alias("a_boxes"), show_seq(a["points_seq"]).alias("a_points"),
    )


def flat_sql(source: str, image: str, q: str, a: str, boxes="null", points="null", q_boxes="null", q_points="null",
             a_boxes="null", a_points="null") -> str:
    s = lambda e: f"cast({e} as varchar)"
    return (
        f"select row_id, {s(image)} image, {s(boxes)} boxes, {s(points)} points, {s(q)} q, {s(q_boxes)} q_boxes, "
        f"{s(q_points)} q_points, {s(a)} a, {s(a_boxes)} a_boxes, {s(a_points)} a_points from {source}"
    )


def box(prefix: str) -> Column:
    return F.array(*[F.col(f"{prefix}{c}").cast("double") for c in ("x1", "y1", "x2", "y2")])


def box_sql(prefix: str) -> str:
    return "concat_ws(','," + ",".join(f"{prefix}{c}" for c in ("x1", "y1", "x2", "y2")) + ")"
