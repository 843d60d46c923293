"""Run queries on both engines and compare rows: `python -m checks.compare <sf_dir> [name ...]`."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

from checks.base import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def _type(name: str) -> str:
    name = name.lower()
    known = {"int": "integer", "bigint": "bigint", "string": "varchar", "double": "double", "boolean": "boolean"}
    return known.get(name, name)


def compare(spark, con, sf: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(_cell(r[c]) for c in cols) for r in df.collect()]
    if name not in ORACLES:
        return None if got else "no rows (no oracle)"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).lower() for d in cur.description}
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(_cell(r[i]) for i in at) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got.sort(key=key), want.sort(key=key)
    for g, w in zip(got, want):
        if g != w:
            bad = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b]
            return f"row differs: {[(c, str(a)[:300], str(b)[:300]) for c, a, b in bad]}"
    spark_types = {c: _type(t) for c, t in df.dtypes}
    odd = {c: (spark_types[c], types[c]) for c in cols if spark_types[c] != types[c] and types[c] not in ("number", "string")}
    if odd:
        return f"types differ: {odd}"
    return None if got else "no rows"


def main(argv: list[str]) -> int:
    import checks.catalog  # noqa: F401
    from lumenfold.session import build_session

    sf, names = argv[0], argv[1:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf, name)
        except Exception as e:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(e))[:1500]
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s"
              + (" (rows only)" if name not in ORACLES else "") + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{len(names) - bad} of {len(names)} equal", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) and 1)
