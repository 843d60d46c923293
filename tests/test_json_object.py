"""JSON objects by byte ranges: equal to parsing them whole, wherever the ranges are cut."""

from __future__ import annotations

import io
import json
import random
from pathlib import Path

import duckdb
import pytest

import checks.catalog  # noqa: F401
from checks import compare
from lumenfold.sources import json_object as jo
from lumenfold.sources import readers

WORDS = ["plain", 'quo"te', "back\\", "\\\\\"", "{", "}", "[", "]", ",", ":", '","', '":[', "ünï ", "\\u0041", "", " ", '{"a": 1}', "x" * 90]


def _object(seed, n=60):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(WORDS) for _ in range(draw.randint(0, 4)))
    record = lambda k: {"id": k, word() or "w": word(), "bbox": [draw.random(), -1], "deep": {"a": [{"b": word()}, []]}}
    return {
        "images": [record(k) for k in range(n)], "version": word(), "empty": [], "nothing": {}, 'odd"name\\': [word() for _ in range(n)],
        "neighbors": {f"{k}{word()}": list(range(k % 5)) for k in range(n)}, "number": 3, "expired_imgs": {str(k): word() for k in range(n)},
    }


def _want(obj):
    rows = []
    for name, member in obj.items():
        if isinstance(member, list):
            rows += [(name, None, x) for x in member]
        elif isinstance(member, dict):
            rows += [(name, k, x) for k, x in member.items()]
    return rows


def _by_ranges(data, cut):
    state, found = jo.Start(), []
    stream = io.BytesIO(data)
    for a in range(0, len(data), cut):
        b = min(len(data), a + cut)
        found += [(m, k, json.loads(t)) for m, k, t in jo.elements(stream, a, b, len(data), state, None)]
        state = state.after(jo.scan_range(*jo._read(stream, a, b)))
    return found


@pytest.mark.parametrize("cut", [7, 64, 1000, 10**9])
def test_any_cut_gives_every_element_once(cut):
    for seed in range(4):
        obj = _object(seed)
        for text in (json.dumps(obj), json.dumps(obj, indent=1, ensure_ascii=False), json.dumps(obj, separators=(" ,", " : "))):
            assert _by_ranges(text.encode(), cut) == _want(obj)


def test_several_objects_and_a_file_cut_short():
    one, two = _object(1, 9), _object(2, 5)
    text = json.dumps(one) + "\n" + json.dumps(two) + "\n"
    assert _by_ranges(text.encode(), 50) == _want(one) + _want(two)
    with pytest.raises(ValueError, match="ends inside"):
        _by_ranges(json.dumps(one).encode()[:300], 100)


def test_the_source_reads_one_object_with_many_tasks(spark, tmp_path):
    obj = _object(3, 3000)
    path = tmp_path / "one.json"
    path.write_text(json.dumps(obj))
    df = jo.read_members(spark, str(path), range_bytes=1 << 16)
    assert df.rdd.getNumPartitions() == -(-path.stat().st_size // (1 << 16)) > 5
    key = lambda r: (r[0], r[1] or "", json.dumps(r[2], sort_keys=True))
    got = sorted(((r["tbl"], r["key"], json.loads(r["record"])) for r in df.collect()), key=key)
    assert got == sorted(_want(obj), key=key)
    only = jo.read_members(spark, str(path), ["neighbors"], range_bytes=1 << 16)
    assert only.count() == len(obj["neighbors"]) and {r["tbl"] for r in only.select("tbl").distinct().collect()} == {"neighbors"}
    assert df.where("tbl = 'images'").count() == 3000


def test_detection_tables_of_one_object(spark, tmp_path):
    obj = {
        "categories": [{"id": k, "name": f"c{k}"} for k in range(3)],
        "images": [{"id": k, "file_name": f'a"{k},}}', "width": 5, "height": 6, "extra": {"x": [1]}} for k in range(400)],
        "annotations": [{"id": k, "image_id": k % 400, "category_id": k % 3, "bbox": [0, 1.5, 2, 3]} for k in range(900)],
        "neighbors": {"0": [1, 2], "1": [], "2": [0]}, "expired_imgs": {"7": "x", "9": ""}, "info": {"year": 2023},
    }
    path = tmp_path / "v.json"
    path.write_text(json.dumps(obj))
    got = readers.detection_tables(spark, str(path), range_bytes=2000)
    assert got["images"].orderBy("id").first().asDict() == {"id": 0, "file_name": 'a"0,}', "width": 5, "height": 6}
    assert (got["images"].count(), got["annotations"].count(), got["categories"].count()) == (400, 900, 3)
    assert sorted(map(tuple, got["neighbors"].collect())) == [(0, 0, 1), (0, 1, 2), (2, 0, 0)]
    assert sorted(r.image_id for r in got["expired"].collect()) == [7, 9]
    with pytest.raises(FileNotFoundError):
        readers.detection_tables(spark, str(tmp_path / "none.json"))


def test_a_task_reads_many_short_ranges(spark, tmp_path):
    rows = [{"id": i, "text": 'a "b" { [' * (i % 5)} for i in range(4000)]
    for n in range(2):
        with open(f"{tmp_path}/{n}.json", "w") as f:
            json.dump({"first": rows, "second": {str(i): i for i in range(2000)}}, f)
    found = jo.read_members(spark, str(tmp_path), range_bytes=1 << 10)
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    got = found.collect()
    assert sorted(json.loads(r["record"])["id"] for r in got if r["tbl"] == "first") == sorted([*range(4000)] * 2)
    assert sorted(int(r["key"]) for r in got if r["tbl"] == "second") == sorted([*range(2000)] * 2)


def test_an_object_is_written_row_by_row(spark, tmp_path, monkeypatch):
    """However many annotations an object has, no row of the tasks that write it has more than one."""
    tables = {
        "orders": ([(k * 11, k, "PO"[k % 2]) for k in range(3000)], "o_orderkey long, o_custkey long, o_orderstatus string"),
        "part": ([(k, f"Brand#{k % 25}") for k in range(200)], "p_partkey long, p_brand string"),
        # Most lie on one image, some on images without a row of their own.
        "lineitem": ([(77 if k % 3 else k * 13, k % 200, k % 10, k % 7) for k in range(7000)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
    }
    con, paths, read = duckdb.connect(), [], readers.detection_tables
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    monkeypatch.setattr(readers, "detection_tables", lambda spark, path, **k: (paths.append(path), read(spark, path, **k))[1])
    assert compare.compare(spark, con, str(tmp_path), "detection_json") is None
    texts = [f.read_text() for f in Path(paths[0]).rglob("part-*")]
    objects = sorted((json.loads(t) for t in texts), key=lambda o: min(a["image_id"] for a in o["annotations"]))
    few = ["annotations", "expired_imgs"]
    assert [sorted(o) for o in objects] == [["annotations", "categories", "expired_imgs", "images", "neighbors"], [*few, "images"], few, few, few]
    assert len(objects[0]["annotations"]) > 5000 and sum(len(o["annotations"]) for o in objects) == 7000
    assert max(len(line) for t in texts for line in t.splitlines()) < 500
