"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one row kept of a group.

Equal vectors collapse first. Centroids are fitted on a bounded sample; every vector belongs to the cell
of its nearest centroid, and may also link with each cell whose border (the plane midway between the two
centroids) is within the angle of the threshold: a vector beyond the border that links with it has to be
as near. So every link is found. A cell's vectors are written as blocks, once; tasks read pairs of blocks
back from there, so the disk grows with the vectors and not with their pairs. Cosines are looked at in single
precision first, and in double precision where those are near the threshold or above it. Tasks give counts of links
and edges of spanning trees, never lists of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import discard, staged
from lithoframe.llm.components import connected_components
from lithoframe.llm.groups import Forest

#: Lengths of vectors at most: each length is compared apart.
MAX_LENGTHS = 64
#: Vectors that fit the centroids at most, cells at most and (while they hold some vectors each) at least,
#: vectors of a cell about, vectors and bytes of a block at most, pairs of blocks sent to Python at once.
SAMPLE, MAX_CELLS, LEAST_CELLS, CELL_ROWS, BLOCK, BLOCK_BYTES, AT_ONCE = 16_384, 8_192, 8, 1_024, 4_096, 4 << 20, 8
#: Distance from a border by which rounding may err.
SLACK = 1e-7


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 10) -> np.ndarray:
    """k unit centroids of unit rows x; fewer if x has fewer distinct rows. Reruns agree."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        live = norm > 0
        c = np.where(live[:, None], sums / np.where(live, norm, 1)[:, None], c)
    return np.unique(c, axis=0)


def _unit(x: np.ndarray, dim: int) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", cell_rows: int = CELL_ROWS, seed: int = 10) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Links are all pairs of rows with cosine >= threshold, in double precision. n_links counts the other rows linked directly;
    component_id is the smallest id reachable. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and neither do vectors of unequal length. Rows that repeat an id,
    with the same vector or another, are separate rows. Rows with a null id are linked and counted as any;
    they are kept only where component_id is null, as no row of the component has an id. Extra columns don't
    matter; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector].dataType.simpleString()
    kind = "float" if kind == "array<float>" else "double"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    fine = F.size("v") > 0
    fine = fine & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    hashed = rows.filter(F.col("v").isNotNull() & fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)))
    distinct = hashed.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    distinct = staged(distinct.select(F.monotonically_increasing_id().alias("rep"), "v", "least", "copies"), "emb-distinct")  # numbered: ids may repeat
    digest = [F.xxhash64(F.lit(k), F.size("v"), "v").alias(f"h{k}") for k in (1, 2)]
    keys = staged(distinct.select("rep", "least", "copies", *digest), "emb-keys")
    if not keys.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
        raise ValueError("unequal vectors share both digests")
    parts = []
    lengths = distinct.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LENGTHS + 1).collect()
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    for dim, n in sorted((int(r.d), int(r.n)) for r in lengths):
        part = distinct.filter(F.size("v") == dim)
        k = min(MAX_CELLS, max(n // cell_rows, min(LEAST_CELLS, n // 4)))
        centroids = np.zeros((1, dim))
        if k > 1:
            picked = part.filter(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * (1 << 30)).select("v").toPandas()
            x = np.stack(picked["v"].to_numpy()).astype(np.float64) if len(picked) else np.ones((1, dim))
            x = x[np.lexsort(x.T)]  # the same whatever order rows come in
            x = x / np.abs(x).max(axis=1, keepdims=True)
            centroids = spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), k, seed=seed)
        parts.append(_blocks_of(part, dim, centroids, threshold, kind))
    discard(distinct)  # its vectors are in the blocks
    parts = [_links_of(blocks, dim, centroids, threshold, kind) for blocks, dim, centroids in parts]
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    components = components.withColumnRenamed("id", "rep")
    smallest = components.join(keys.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("first"))
    told = keys.join(counts, "rep", "left").join(components.join(smallest, "component"), "rep", "left")
    told = told.select("h1", "h2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("component").isNotNull(), F.col("first")).otherwise(F.col("least")).alias("component"))
    told = staged(told, "emb-told")
    mine = hashed.select("vec_id", *digest).join(told, ["h1", "h2"]).select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.filter(F.col("v").isNull() | ~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def near_cells(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit row of x, and which cells hold rows that may link with it, its own included."""
    dots = x @ c.T
    home = dots.argmax(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * (c[home] @ c.T)))  # between the centroids
    return home, dots[np.arange(len(x)), home][:, None] - dots <= _reach(threshold) * gap + SLACK


def _reach(threshold: float) -> float:
    return float(np.sqrt(1 - threshold * threshold)) if 0 < threshold < 1 else float(threshold <= 0)


def _blocks_of(part: DataFrame, dim: int, centroids: np.ndarray, threshold: float, kind: str) -> tuple[DataFrame, int, np.ndarray]:
    """Blocks of vectors of one length and cell, written once: their cell, and the cells that some of them may link with."""
    held = part.sparkSession.sparkContext.broadcast(centroids)  # MAX_CELLS x dim at most
    most, value = max(1, min(BLOCK, BLOCK_BYTES // (8 * dim))), np.float32 if kind == "float" else np.float64

    def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(held.value) == 1:
            return np.zeros(len(x), dtype=np.int64), np.ones((len(x), 1), dtype=bool)
        return near_cells(x, held.value, threshold)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                home, _ = near(_unit(b.column("v").flatten().to_numpy(zero_copy_only=False), dim))
                yield pa.record_batch({"rep": b.column("rep"), "copies": b.column("copies"), "v": b.column("v"), "home": pa.array(home.astype(np.int32))})

    def block(home: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rep, copies = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in ("rep", "copies"))
        x = np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False) for b in batches]).astype(value)
        cells = np.zeros(len(held.value), dtype=bool)
        for a in range(0, len(rep), 512):
            cells |= near(_unit(x[a * dim : (a + 512) * dim], dim))[1].any(axis=0)
        told = {"first": pa.array(rep[:1]), "home": pa.array([home], pa.int32()), "cells": pa.array([np.flatnonzero(cells).astype(np.int32)], pa.list_(pa.int32()))}
        return pa.record_batch(told | {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("rep", rep), ("copies", copies), ("x", x))})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        cell, size = -1, 0
        for b in batches:
            homes = b.column("home").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(homes)) + 1, [len(homes)]])
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                while lo < hi:
                    if kept and (homes[lo] != cell or size == most):
                        yield block(cell, kept)
                        kept, size = [], 0
                    n = min(hi - lo, most - size)
                    kept.append(b.slice(lo, n))
                    cell, size, lo = int(homes[lo]), size + n, lo + n
        if kept:
            yield block(cell, kept)

    placed = part.select("rep", "copies", "v").mapInArrow(place, f"rep long, copies long, v array<{kind}>, home int")
    ranged = placed.repartitionByRange("home", "rep").sortWithinPartitions("home", "rep")
    blocks = ranged.mapInArrow(gather, "first long, home int, cells array<int>, rep binary, copies binary, x binary")
    return staged(blocks, "emb-blocks"), dim, centroids


def _links_of(blocks: DataFrame, dim: int, centroids: np.ndarray, threshold: float, kind: str) -> DataFrame:
    """(rep, links weighted by copies, root): counts and spanning edges of the vectors of one length."""
    spark = blocks.sparkSession
    held, value = spark.sparkContext.broadcast(centroids), np.float32 if kind == "float" else np.float64

    def opened(b: pa.RecordBatch, side: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rep, copies, x = (b.column(f"{side}_{c}")[k].as_buffer() for c in ("rep", "copies", "x"))
        return np.frombuffer(rep, dtype=np.int64), np.frombuffer(copies, dtype=np.int64), _unit(np.frombuffer(x, dtype=value), dim)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            for k in range(b.num_rows):
                i, j = b.column("a_home")[k].as_py(), b.column("b_home")[k].as_py()
                rep, copies, x = opened(b, "a", k)
                side = np.full(len(rep), 2)
                if b.column("a_first")[k] != b.column("b_first")[k]:
                    rep_2, copies_2, x_2 = opened(b, "b", k)
                    rep, copies, x = np.append(rep, rep_2), np.append(copies, copies_2), np.concatenate([x, x_2])
                    side = np.repeat([0, 1], [len(side), len(rep_2)])
                    if i != j:  # only what is within the angle of the border
                        gap = np.sqrt(max(0, 2 - 2 * (c[i] @ c[j])))
                        dots = x @ c[[i, j]].T
                        past = np.where(side == 0, dots[:, 0] - dots[:, 1], dots[:, 1] - dots[:, 0])
                        keep = past <= _reach(threshold) * gap + SLACK
                        rep, copies, x, side = rep[keep], copies[keep], x[keep], side[keep]
                found = _tile(rep, copies, side, x, threshold)
                if found is not None:
                    yield found

    one, two = (blocks.select(*[F.col(k).alias(f"{side}_{k}") for k in blocks.columns]) for side in "ab")
    meet = (F.col("a_first") <= F.col("b_first")) & F.array_contains("a_cells", F.col("b_home")) & F.array_contains("b_cells", F.col("a_home"))
    pairs = one.join(two.hint("shuffle_replicate_nl"), meet).drop("a_cells", "b_cells")  # each task reads two parts of the blocks
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(AT_ONCE))
    try:
        return staged(pairs.mapInArrow(compare, "rep long, links long, root long"), "emb-links")
    finally:
        spark.conf.set(name, before)


def _hits(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of unit rows reaches the threshold in double precision."""
    rough = x.astype(np.float32) @ y.astype(np.float32).T
    slack = 1e-6 + 2.4e-7 * x.shape[1]  # more than single precision errs by
    hit = rough >= threshold - slack
    i, j = np.nonzero(hit)
    if len(i) > 1 << 14:
        return x @ y.T >= threshold
    hit[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return hit


def _tile(rep: np.ndarray, copies: np.ndarray, side: np.ndarray, x: np.ndarray, threshold: float) -> pa.RecordBatch | None:
    """Links of one pair: of a block (side 0) with another (side 1), or of a block (side 2) with itself."""
    rows, cols = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(rows) or not len(cols):
        return None
    same = bool((side == 2).any())
    total, forest, any_link = np.zeros(len(rep), dtype=np.int64), Forest(len(rep)), False
    order = np.argsort(rep, kind="stable")
    rank = np.empty(len(rep), dtype=np.int64)
    rank[order] = np.arange(len(rep))
    for a in range(0, len(rows), 512):
        r = rows[a : a + 512]
        hit = _hits(x[r], x[cols], threshold)
        if same:
            hit &= r[:, None] < cols[None, :]
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        i, j = r[i], cols[j]
        np.add.at(total, i, copies[j])
        np.add.at(total, j, copies[i])
        for q, others in zip(i[np.append(0, np.flatnonzero(np.diff(i)) + 1)], np.split(j, np.flatnonzero(np.diff(i)) + 1), strict=False):
            for o in {forest.find(int(o)) for o in rank[others]}:
                forest.join(int(rank[q]), o)
        any_link = True
    if not any_link:
        return None
    linked = np.flatnonzero(total)
    root = rep[order[[forest.find(int(rank[q])) for q in linked]]]
    return pa.record_batch({"rep": pa.array(rep[linked]), "links": pa.array(total[linked]), "root": pa.array(root)})
