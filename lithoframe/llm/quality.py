"""Quality scores by Bradley-Terry pairwise ranking.

Each pair of a row labelled 1 and a row labelled 0 is a preference; weights of text features minimise the
logistic loss of the features' differences over all pairs of all labelled rows. The rows are tallied by class and
narrow cells of their score, so a Newton step is one pass over them. The score that separates is a quantile of
the training scores, and a logistic curve maps it to the given threshold.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import discard, staged

#: Cells of the score, its largest size that they part, tasks that tally at most, cells of a search for a rank.
BINS, REACH, TALLIES, RANK_CELLS = 512, 32.0, 16, 4096

_KIND = np.zeros((256, 7))
for _row, _members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"%$#&*@^~=+<>|\\/{}[]_", b"\n\r", bytes(range(128, 256)))):
    _KIND[list(_members), _row] = 1

NAMES = ("length", "capitals", "digits", "stops", "shouts", "symbols", "lines", "other", "word_length", "fresh", "echo", "fresh_tail", "plain")


def features(text: str | None) -> np.ndarray:
    """Features of the whole text, all finite; of null or empty text too."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    share = np.bincount(raw, minlength=256) @ _KIND / max(1, len(raw))
    words = text.split()
    n = len(words)
    distinct = len(set(words))
    echo = sum(map(operator.eq, words, words[1:]))
    plain = sum(map(str.isalpha, words))
    d = max(1, n)
    return np.asarray([np.log1p(n), *share, min(len(text) / d, 40.0) / 10, distinct / d, echo / d, np.log1p(n) - np.log1p(distinct), plain / d])


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features in steps of 2**-12: sums of them, and of their products, are exact in any order."""
    return np.round(np.clip((x - mean) / scale, -6, 6) * 4096) / 4096


def tally(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """By class and cell of the score: rows, sums of features, sums of products of two features."""
    reach = min(REACH, max(6 * np.abs(w).sum(), 1e-9))
    cell = np.clip(((z @ w / reach + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1) + BINS * y
    i, j = np.triu_indices(z.shape[1])
    columns = [None, *z.T, *(z[:, a] * z[:, b] for a, b in zip(i, j, strict=True))]
    return np.stack([np.bincount(cell, c, 2 * BINS) for c in columns], axis=1).reshape(2, BINS, -1).astype(np.float64)


def newton(told: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """The step of w on the logistic loss of all pairs, a cell's rows at its mean score."""
    d = len(w)
    n, s, q = told[..., 0], told[..., 1 : d + 1], told[..., d + 1 :]
    score = s @ w / np.maximum(n, 1)
    pairs = n[0].sum() * n[1].sum()
    p = 1 / (1 + np.exp(np.clip(score[1][:, None] - score[0][None, :], -35, 35)))  # chance of the wrong order
    h = p * (1 - p)
    both = np.zeros((d, d))
    both[np.triu_indices(d)] = (h @ n[0]) @ q[1] + (n[1] @ h) @ q[0]
    both += np.triu(both, 1).T
    cross = s[1].T @ h @ s[0]
    slope = (p @ n[0]) @ s[1] - (n[1] @ p) @ s[0]
    return np.linalg.solve((both - cross - cross.T) / pairs + ridge * np.eye(d), slope / pairs - ridge * w)


def at_rank(values: DataFrame, rank: int, value: str = "s") -> float:
    """The value at a rank from 0, exactly: cells of a range are counted, then those of the rank's cell."""
    v = F.col(value)
    lo, hi = values.agg(F.min(v), F.max(v)).first()
    while lo < hi:
        cell = F.least(F.floor((v - lo) / ((hi - lo) / RANK_CELLS)), F.lit(RANK_CELLS - 1))
        cells = values.filter(v.between(lo, hi)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        for c in sorted(cells.collect(), key=lambda c: c.cell):  # RANK_CELLS rows at most
            if rank < c.n:
                lo, hi = c.lo, c.hi
                break
            rank -= c.n
    return float(lo)


def train(seen: DataFrame, labels: DataFrame, where: Column, threshold: float = 0.7, key: str = "doc_id", label: str = "quality"):
    """The model, or None if either class is missing. `seen` holds doc_id and features x; `where` is over labels.

    Every labelled row whose document is there takes part: in means, weights and the quantile.
    """
    known = labels.filter(where & F.col(label).isin(0, 1)).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y"))
    learnt = staged(seen.join(known, seen["doc_id"] == known["_id"]).select("_y", "x"), "quality-learnt")
    counts = {r["_y"]: int(r.n) for r in learnt.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    each = [F.col("x")[i] for i in range(len(NAMES))]
    told = learnt.agg(*[F.avg(x) for x in each], *[F.stddev_pop(x) for x in each]).first()
    told = np.asarray([float(f"{v:.9g}") for v in told])  # the same whatever order rows come in
    mean, scale = told[: len(NAMES)], told[len(NAMES) :]
    scale = np.where(scale <= 1e-9 * np.maximum(1, np.abs(mean)), 1, scale)
    w = np.zeros(len(NAMES))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            if b.num_rows:
                yield standard(_matrix(b.column("x")), mean, scale), b.column("_y").to_numpy()

    for _ in range(30):

        def tallied(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total = sum(tally(z, y, w) for z, y in rows(batches))
            if not np.isscalar(total):
                yield pa.record_batch({"told": pa.array([total.tobytes()], pa.binary())})

        parts = learnt.coalesce(TALLIES).mapInArrow(tallied, "told binary").collect()  # 0.9 MB each, TALLIES at most
        step = newton(sum(np.frombuffer(r.told) for r in parts).reshape(2, BINS, -1), w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for z, _ in rows(batches):
            yield pa.record_batch({"s": pa.array(z @ w)})

    scores = staged(learnt.mapInArrow(scored, "s double"), "quality-scores")
    # The quantile at the share of label 0 parts the classes.
    n, k = counts[0] + counts[1], counts[0] - 1
    cut = (at_rank(scores, max(0, k - 1)) + at_rank(scores, k + 1)) / 2
    off = scores.select(F.abs(F.col("s") - cut).alias("s"))
    spread = at_rank(off, n // 2) if n % 2 else (at_rank(off, n // 2 - 1) + at_rank(off, n // 2)) / 2
    discard(learnt, scores)
    return {"mean": mean, "scale": scale, "w": w, "cut": cut, "spread": max(spread, 1e-6), "threshold": threshold}


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(NAMES))


def to_unit(s: np.ndarray, model: dict) -> np.ndarray:
    """Scores to 0..1; the cut goes to the threshold."""
    shift = np.log(model["threshold"] / (1 - model["threshold"]))
    return 1 / (1 + np.exp(-np.clip(3 * (s - model["cut"]) / model["spread"] + shift, -35, 35)))


def rate(docs: DataFrame, labels: DataFrame, where: Column, threshold: float = 0.7, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), predicted (1 if score >= threshold, else 0).

    Only the text is scored; null is the empty text, which has features too. If labels lack a class,
    every score is 0.5. Labels with null id or another value are ignored; repeated labels count
    each. Extra columns don't matter; an empty table gives no rows.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "x": pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))})

    rows_in = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows_in.schema["doc_id"].dataType.simpleString()
    seen = staged(rows_in.mapInArrow(look, f"doc_id {kind}, x array<double>"), "quality-features")
    model = docs.sparkSession.sparkContext.broadcast(train(seen, labels, where, threshold, key, label))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            if m is None:
                s = np.full(b.num_rows, 0.5)
            else:
                s = to_unit(standard(_matrix(b.column("x")), m["mean"], m["scale"]) @ m["w"], m)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return seen.mapInArrow(turn, f"doc_id {kind}, score double, predicted int")
