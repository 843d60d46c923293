"""A quality classifier by positive-unlabelled learning.

Positives are trusted, everything else is unlabelled. A linear model over hashed byte trigrams and
word shapes minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with an estimated class prior, and is then calibrated to probabilities on labelled rows of the
training fold. Labels, language, source and doc_id are no features.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import scratch

DIM = 2048
SHAPES = 64
PIECE = 1 << 20


def _classes() -> np.ndarray:
    """Byte classes for shapes: lower, upper, digit, space, line end, common marks, other marks, above ASCII."""
    c = np.full(256, 6, dtype=np.uint8)
    c[ord("a") : ord("z") + 1] = 0
    c[ord("A") : ord("Z") + 1] = 1
    c[ord("0") : ord("9") + 1] = 2
    c[[9, 32]] = 3
    c[[10, 13]] = 4
    c[[ord(x) for x in ".,;:'\"-!?"]] = 5
    c[128:] = 7
    return c


CLASS = _classes()


def _add_counts(data: np.ndarray, out: np.ndarray) -> None:
    """Adds trigram buckets and byte-class pairs of one piece of a text."""
    if len(data) > 1:
        c = CLASS[data]
        out[DIM : DIM + SHAPES] += np.bincount(c[:-1] * 8 + c[1:], minlength=SHAPES)
    if len(data) > 2:
        wide = data.astype(np.uint32)
        gram = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - (DIM - 1).bit_length())
        out[:DIM] += np.bincount(bucket, minlength=DIM)


def features(texts: list[str | None]) -> np.ndarray:
    """Rows of square roots of trigram and shape shares, a repeat share, the log length and a constant.

    Texts are taken whole, in pieces that overlap by two bytes.
    """
    out = np.zeros((len(texts), DIM + SHAPES + 3), dtype=np.float32)
    counts = np.zeros(DIM + SHAPES, dtype=np.int64)
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        counts[:] = 0
        for start in range(0, max(1, len(data)), PIECE):
            _add_counts(data[start : start + PIECE + 2 * (start + PIECE < len(data))], counts)
        for a, b in ((0, DIM), (DIM, DIM + SHAPES)):
            total = counts[a:b].sum()
            if total:
                out[i, a:b] = np.sqrt(counts[a:b] / total)
        lines = (text or "").split("\n")
        out[i, -3] = 1 - len(set(lines)) / len(lines)
        out[i, -2] = np.log1p(len(data)) / 10
        out[i, -1] = 1
    return out


class Model(NamedTuple):
    weights: np.ndarray
    slope: float
    offset: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights).astype(np.float64) + self.offset, -500, 500)))


def _nn_pu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative risk with the logistic loss, by Adam on the whole sample."""
    w = np.zeros(pos.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        half = w.astype(np.float32)
        of_pos, of_unl = pos @ half, unl @ half
        p, u = (1 / (1 + np.exp(-np.clip(f, -60, 60))) for f in (of_pos, of_unl))
        negative = (u / len(unl)) @ unl - prior * ((p / len(pos)) @ pos)
        rest = np.logaddexp(0, of_unl).mean() - prior * np.logaddexp(0, of_pos).mean()
        # Below zero the negative part has overfitted: step back on it.
        g = prior * (((p - 1) / len(pos)) @ pos) + negative if rest >= 0 else -negative
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def prior_cuts(pos: np.ndarray, least: float = 0.05) -> np.ndarray:
    """Thresholds between scores of positives, rising, that keep at least `least` of them."""
    return np.unique(np.quantile(pos, np.linspace(0, 1 - least, 200)))


def estimate_prior(pos: np.ndarray, cuts: np.ndarray, counts: np.ndarray) -> float:
    """Share of positives among all documents: the smallest ratio of the shares above a threshold.

    `counts` are of documents by how many of `cuts` their score reaches."""
    above_p = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    total = max(1, int(counts.sum()))
    above_u = counts[::-1].cumsum()[::-1][1:] / total
    slack = np.sqrt(1 / len(pos) + 1 / total)
    return float(np.clip(np.min((above_u + slack) / np.maximum(above_p, 1e-9)), 0.01, 0.99))


def score_counts(docs: DataFrame, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Documents by how many of `cuts` their score under `weights` reaches: one aggregate over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, edges = shared.value
        total = np.zeros(len(edges) + 1, dtype=np.int64)
        for batch in scratch.text_slices(batches):
            f = features(batch.column("text").to_pylist()) @ w
            total += np.bincount(np.searchsorted(edges, f, side="right"), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])

    found = np.zeros(len(cuts) + 1, dtype=np.int64)
    for r in docs.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        found[r["bin"]] = r["n"]
    return found


def _calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a rising logistic curve through labelled scores, by Newton steps that are
    halved until they help, with a small ridge."""
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    x = np.stack([f, np.ones_like(f)], axis=1)
    start = np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 5e-4 * ((w - start) ** 2).sum())

    w = start
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        slope = x.T @ (y - p) - 1e-3 * (w - start)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), slope)
        while np.abs(step).max() > 1e-7 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _sampled(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and kinds of the documents in `ids` (a bounded table with _i and kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scratch.text_slices(batches):
            x = features(batch.column("text").to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("_i"), batch.column("kind"), pa.array([r.tobytes() for r in x], pa.binary())], ["_i", "kind", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_i"), "text").join(F.broadcast(ids), "_i")
    found = sorted(rows.mapInArrow(run, "_i long, kind int, x binary").toLocalIterator(), key=lambda r: (r["_i"], r["kind"], r["x"]))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.float16).reshape(len(found), -1)
    return x, np.array([r["kind"] for r in found])


def fit(docs: DataFrame, labels: DataFrame, per_kind: int = 2500, steps: int = 250, seed: str = "pu") -> Model | None:
    """The model, from at most `per_kind` trusted positives, as many unlabelled documents and as many
    labelled ones for the calibration; None without positives.

    Rows are drawn by a hash of their id, from the training fold alone for labels. The unlabelled
    are drawn from all documents. Conflicting labels of a document count as no label.
    """
    draw = lambda tag: F.xxhash64(F.lit(f"{seed}-{tag}"), "_i")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("_i"), F.col("quality").cast("int").alias("y"))
        .filter("_i is not null and y in (0, 1)").filter(~held_out(F.col("_i")))
        .groupBy("_i").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z")
        .join(docs.select(F.col("doc_id").cast("long").alias("_i")).distinct(), "_i", "left_semi"))
    every = docs.select(F.col("doc_id").cast("long").alias("_i")).filter("_i is not null").distinct()
    take = lambda df, tag, kind: df.orderBy(draw(tag), "_i").limit(per_kind).select("_i", F.lit(kind).alias("kind"))
    # Calibration rows are no positives of the fit.
    half = F.pmod(draw("half"), F.lit(4)) == 0
    ids = take(known.filter(~half & (F.col("y") == 1)), "p", 1).union(take(every, "u", 2)).union(
        take(known.filter(half & (F.col("y") == 0)), "n", 3)).union(take(known.filter(half & (F.col("y") == 1)), "c", 4))
    # What is sent on is at most 4 * per_kind ids.
    rows = [(r["_i"], r["kind"]) for r in ids.collect()]
    share = known.filter(half).agg(F.avg("y")).first()[0]
    if not any(k == 1 for _, k in rows):
        return None
    x, kind = _sampled(docs, docs.sparkSession.createDataFrame(rows, "_i long, kind int"))
    pos, unl = x[kind == 1].astype(np.float32), x[kind == 2].astype(np.float32)
    # A first model, under which every document is scored to estimate the prior; then the model.
    first = _nn_pu(pos, unl, 0.5, steps)
    of_pos = pos @ first.astype(np.float32)
    cuts = prior_cuts(of_pos)
    prior = estimate_prior(of_pos, cuts, score_counts(docs, first, cuts))
    w = _nn_pu(pos, unl, prior, steps)
    scale = max(1e-9, float(np.std(unl @ w)))
    w = (w / scale).astype(np.float32)
    held = np.isin(kind, (3, 4))
    y = (kind[held] == 4).astype(np.float64)
    slope, offset = _calibrate((x[held].astype(np.float32) @ w).astype(np.float64), y)
    if 0 < y.mean() < 1 and share is not None and 0 < share < 1:
        # Both kinds were drawn up to the bound: back to their share among labelled rows.
        offset += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return Model(w, slope, offset, prior)


def score_documents(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """All columns of `docs` with `score` and `predicted`. Null and empty texts are scored like any other;
    without a model every score is 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scratch.text_slices(batches):
            texts = batch.column(at).to_pylist()
            s = np.full(len(texts), 0.5) if shared.value is None else shared.value.score(features(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*names, "_score", "_predicted"])

    from pyspark.sql.types import StructType

    return docs.mapInArrow(run, StructType([*docs.schema, *StructType().add("_score", "double").add("_predicted", "integer")]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, from a model fitted on `labels`.

    held_out marks ids whose crc32 (of the id as text) is divisible by 5: their labels are not used.
    A null doc_id is not held out. Rows that repeat a doc_id are scored each. Other columns, of any
    name, are ignored.
    """
    rows = docs.select("doc_id", "text")
    found = score_documents(rows.withColumn("doc_id", F.col("doc_id").cast("long")), fit(rows, labels, **options), threshold)
    return found.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
