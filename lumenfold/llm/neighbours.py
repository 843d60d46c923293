"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts, a small classifier learns to tell
a vector's part, and every vector is indexed under its most probable one. A query goes to the parts
the classifier finds most probable, enough of them for the recall asked for on the sample, and is
reranked there by exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm import scratch

SAMPLE = 6000
SEEN = 32  # sample vectors whose parts a query is sent to
GRAPH = 10
CELL_VECTORS = 4096
CELL_QUERIES = 1024


class Router(NamedTuple):
    """A network of one hidden layer over unit vectors, and how many parts a query goes to."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    seen: np.ndarray | None = None  # the sample's unit vectors, and the part of each
    home: np.ndarray | None = None

    def scores(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def homes_near(self, unit: np.ndarray, parts: int, m: int = SEEN) -> np.ndarray:
        """For each row and part whether one of the row's `m` nearest sample vectors lies there."""
        out = np.zeros((len(unit), parts), dtype=bool)
        m = min(m, len(self.seen))
        for a in range(0, len(unit), 256):
            near = np.argpartition(-(unit[a : a + 256] @ self.seen.T), m - 1, axis=1)[:, :m]
            out[np.repeat(np.arange(a, a + len(near)), m), self.home[near].ravel()] = True
        return out


def neighbour_graph(unit: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Indexes of each row's k nearest others by cosine, nearest first."""
    k = min(k, len(unit) - 1)
    out = np.empty((len(unit), k), dtype=np.int64)
    for a in range(0, len(unit), block):
        near = unit[a : a + block] @ unit.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        if k:
            some = np.argpartition(-near, k - 1, axis=1)[:, :k]
            by = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
            out[a : a + block] = np.take_along_axis(some, by, axis=1)
    return out


def _halve(graph: np.ndarray, nodes: np.ndarray, total: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two equal halves of `nodes` with few graph edges between them: a spectral order, then swaps of
    the nodes that gain most, while both sides have some to swap."""
    place = np.full(total, -1)
    place[nodes] = np.arange(len(nodes))
    a = np.repeat(np.arange(len(nodes)), graph.shape[1])
    b = place[graph[nodes].ravel()]
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=len(nodes)) + 1.0
    x = rng.standard_normal(len(nodes))
    for _ in range(60):
        x = (x + np.bincount(a, x[b], len(nodes))) / degree
        x = x - (x * degree).sum() / degree.sum()
        x = x / max(1e-12, float(np.abs(x).max()))
    side = np.zeros(len(nodes), dtype=bool)
    side[np.argsort(x, kind="stable")[len(nodes) // 2 :]] = True
    for _ in range(20):
        same = np.bincount(a, side[a] == side[b], len(nodes))
        gain = np.bincount(a, minlength=len(nodes)) - 2 * same
        left, right = (np.flatnonzero((side == s) & (gain > 0)) for s in (False, True))
        n = min(len(left), len(right)) // 2
        if not n:
            break
        side[left[np.argsort(-gain[left], kind="stable")[:n]]] = True
        side[right[np.argsort(-gain[right], kind="stable")[:n]]] = False
    return nodes[~side], nodes[side]


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """A part from 0 for each node; sizes differ by a few nodes at most. `parts` is a power of two."""
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [half for g in groups for half in _halve(graph, g, len(graph), rng)]
    out = np.zeros(len(graph), dtype=np.int64)
    for i, g in enumerate(groups):
        out[g] = i
    return out


def learn(sample: np.ndarray, parts: int, recall: float, seed: int = 0, hidden: int = 128, epochs: int = 30) -> Router:
    """Cuts the sample's graph, fits the classifier to the parts of each vector and its neighbours, and
    finds how many parts to probe, by the recall of held-out sample vectors among the sample."""
    unit = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    graph = neighbour_graph(unit, GRAPH)
    part = balanced_parts(graph, parts, seed)
    target = np.zeros((len(unit), parts), dtype=np.float32)
    target[np.arange(len(unit)), part] += 1
    for column in graph.T:
        target[np.arange(len(unit)), part[column]] += 1
    target /= target.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    shapes = [(unit.shape[1], hidden), (hidden,), (hidden, parts), (parts,)]
    net = [rng.standard_normal(s).astype(np.float32) * (2 / s[0]) ** 0.5 if len(s) == 2 else np.zeros(s, np.float32) for s in shapes]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net]
    held = np.arange(len(unit)) % 10 == 0
    train = np.flatnonzero(~held) if (~held).sum() else np.arange(len(unit))
    step = 0
    for _ in range(epochs):
        rng.shuffle(train)
        for a in range(0, len(train), 256):
            at = train[a : a + 256]
            x = unit[at]
            h = np.maximum(x @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[at]) / len(at)
            dh = (d @ net[2].T) * (h > 0)
            step += 1
            for p, (m, v), g in zip(net, moments, (x.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    router = Router(*net, parts)
    scores = router.scores(unit)
    home = scores.argmax(axis=1)
    rank = np.empty_like(scores, dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-scores, axis=1, kind="stable"), np.arange(parts)[None, :], axis=1)
    near = graph[held][:, :5] if graph.shape[1] else graph[held]
    needed = rank[np.flatnonzero(held)[:, None], home[near]] if near.size else np.zeros((1, 1), np.int64)
    found = [(needed < p).mean() for p in range(1, parts + 1)]
    return router._replace(seen=unit.astype(np.float32), home=home, probes=1 + next((i for i, r in enumerate(found) if r >= recall), parts - 1))


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors in double precision without null, zero or non-finite ones, of any length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _route(rows: DataFrame, shared, probes: int | None, sizes: dict[int, int] | None = None, least: int = 0) -> DataFrame:
    """One row for each vector and part: its best part, or its `probes` best and as many more, by
    probability, as hold `least` vectors together (all parts, if fewer do), with the parts of its nearest
    vectors in the sample: those keep the recall of a query that lies apart from what the router learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            scale = np.abs(x).max(axis=1, keepdims=True)
            unit = x / scale / np.linalg.norm(x / scale, axis=1, keepdims=True)
            s = shared.value.scores(unit.astype(np.float32))
            best = np.argsort(-s, axis=1, kind="stable")
            if sizes is None:
                taken = np.arange(best.shape[1]) < np.full((len(x), 1), probes or 1)
            else:
                held = np.array([sizes.get(p, 0) for p in range(best.shape[1])])[best].cumsum(axis=1)
                taken = np.arange(best.shape[1]) < np.maximum(probes or 1, (held < least).sum(axis=1) + 1)[:, None]
                taken |= np.take_along_axis(shared.value.homes_near(unit.astype(np.float32), best.shape[1]), best, axis=1)
            row, place = np.nonzero(taken)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), pa.array(best[row, place].astype(np.int32)), batch.column("v").take(at)], ["vec_id", "part", "v"])

    return rows.mapInArrow(run, "vec_id long, part int, v array<double>")


def exact_cosine(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector to each row, summed in one order for all, so that equal rows get equal values."""
    return (rows * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((rows * rows).sum(axis=1)))


def _best(ids: np.ndarray, vecs: np.ndarray, queries: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    out = []
    norms = np.linalg.norm(vecs, axis=1)
    near = (q @ vecs.T) / norms / np.linalg.norm(q, axis=1)[:, None]
    for i, query in enumerate(queries.tolist()):
        sims = np.where(ids == query, -np.inf, near[i])
        if len(sims) > k:
            cut = np.partition(sims, len(sims) - k)[len(sims) - k]
            at = np.flatnonzero((sims >= cut - 1e-9) & np.isfinite(sims))
        else:
            at = np.flatnonzero(np.isfinite(sims))
        score = exact_cosine(q[i], vecs[at])
        top = np.lexsort((ids[at], -score))[:k]
        out += [(query, int(ids[at][j]), float(score[j])) for j in top]
    return out


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = 0.97, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found of each row whose vec_id is divisible by `every`.

    Every valid vector is indexed; the sample for the graph is bounded by `sample`. Candidates are
    all rows but the query's own vec_id. Score is the cosine in double precision; ties go to the
    smaller vec_id. Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do those of another length than most valid vectors share (the shorter of two as frequent). Rows
    that repeat a vec_id are taken once. A part with many vectors is cut into cells, so a vector that a third of the rows repeat is
    spread; queries meet each cell in blocks. Other columns are ignored.
    """
    spark = vectors.sparkSession
    valid = scratch.keep(valid_vectors(vectors).groupBy("vec_id").agg(F.min("v").alias("v")))
    lengths = valid.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    width = lengths["width"] if lengths else 0
    valid = valid.filter(F.size("v") == width)
    # Bounded by `sample` rows; distinct vectors, drawn by a hash of their content.
    drawn = valid.select("v").distinct().orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(sample).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not drawn:
        return spark.createDataFrame([], schema)
    x = np.array([r["v"] for r in drawn])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    total = valid.count()
    parts = 1 << max(0, min(round(math.log2(max(1, math.sqrt(total) / 8))), int(math.log2(max(1, len(x) / 64)))))
    router = learn(x, parts, recall, seed)
    shared = spark.sparkContext.broadcast(router)
    indexed = scratch.keep(_route(valid, shared, None))
    # Counts of at most `parts` rows; cells, blocks and further probes follow them.
    sizes = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = _route(valid.filter(F.col("vec_id") % every == 0), shared, router.probes, sizes, k + 1)
    blocks = max(1, math.ceil(total / every * router.probes / parts / CELL_QUERIES))
    cells = F.element_at(F.create_map(*[F.lit(e) for p in range(parts) for e in (p, max(1, math.ceil(sizes.get(p, 0) / CELL_VECTORS)))]), F.col("part"))
    stored = indexed.select("part", F.pmod(F.xxhash64("vec_id"), cells).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    sent = asked.select("part", F.explode(F.sequence(F.lit(0).cast("long"), cells - F.lit(1).cast("long"))).alias("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            ids, queries = (t.column("vec_id").to_numpy() for t in (left, right))
            a, b = (_matrix(t.column("v").combine_chunks()) for t in (left, right))
            for start in range(0, len(queries), 256):
                rows += _best(ids, a, queries[start : start + 256], b[start : start + 256], k)
        return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64())})

    keys = ["part", "cell", "block"]
    found = stored.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
