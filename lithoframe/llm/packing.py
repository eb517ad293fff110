"""Packing into optimal length buckets and token-budget batches.

The global histogram of lengths goes through a dynamic program that places bucket boundaries where
total padding is least; inside each bucket, batches take as many rows of padded length as the token
budget allows. The histogram has a fixed number of cells (exact lengths first, then cells of constant
relative width), so what the driver holds doesn't grow with the input.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithoframe.llm.common import word_count

#: Lengths up to EXACT have a cell each; above it, each octave has PER_OCTAVE cells.
EXACT, PER_OCTAVE = 2048, 64
#: Rows of a bucket that one task orders, about.
SLICE_ROWS = 20_000


def cell_of(length):
    """Histogram cell of a length column: the length itself, then logarithmic cells."""
    return F.when(length <= EXACT, length).otherwise(EXACT + 1 + F.floor((F.log2(length.cast("double")) - math.log2(EXACT)) * PER_OCTAVE)).cast("long")


def best_boundaries(tops: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` ranges over ascending cell tops with least total padding.

    cost(i, j) = tops[j] * rows of cells i..j, less their words (the same for every choice).
    """
    n = len(tops)
    if n == 0:
        return []
    t, c = np.asarray(tops, dtype=np.float64), np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    k = min(buckets, n)
    best = t * c[1:]
    choice = np.zeros((k, n), dtype=np.int64)
    for b in range(1, k):
        new = best.copy()
        choice[b] = 0
        for j in range(b, n):
            cost = best[:j] + t[j] * (c[j + 1] - c[1 : j + 1])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], choice[b, j] = cost[i], i + 1
        best = new
    out, j, b = [], n - 1, k - 1
    while j >= 0:
        out.append(int(tops[j]))
        i = int(choice[b, j])
        if i == 0:
            break
        j, b = i - 1, max(b - 1, 0)
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 32_768, seed: int = 7, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, length, bucket, padded, batch, position.

    length is the words of the text (null or empty: 0), or the column named. Rows of a bucket are
    padded to its boundary; a batch holds max(1, token_budget // padded) of them, so one longer than
    the budget is a batch of its own, uncut. Bucket boundaries minimise total padding for the number
    of buckets, exactly up to 2,048 words and over cells 1.1 % wide above. batch is unique over the
    table; position counts from 0 in a batch; the order inside a bucket is a seeded hash, ties by id.
    Rows with equal or null ids are separate rows. An empty table gives no rows.

    A bucket is dealt by hash to slices of about 20,000 rows, which are ordered apart: a bucket with a
    third of all rows is the work of many tasks and costs one incomplete batch a slice.
    """
    spark = docs.sparkSession
    size = word_count(text) if length is None else F.coalesce(F.col(length), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("doc_id"), size.alias("length")).withColumn("cell", cell_of(F.col("length")))
    seen = sorted((r.top, r.n, r.cell) for r in rows.groupBy("cell").agg(F.max("length").alias("top"), F.count(F.lit(1)).alias("n")).collect())
    ends = best_boundaries([r[0] for r in seen], [r[1] for r in seen], buckets)
    table, b, held = [], 0, {}
    for top, n, cell in seen:
        while top > ends[b]:
            b += 1
        held[b] = held.get(b, 0) + n
        table.append((cell, b, ends[b]))
    table = [(c, b, e, max(1, math.ceil(held[b] / SLICE_ROWS)), max(1, token_budget // max(1, e))) for c, b, e in table]
    where = spark.createDataFrame(table, "cell long, bucket int, padded long, slices int, each long")
    rows = rows.join(F.broadcast(where), "cell").withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))  # a row a cell
    rows = rows.withColumn("slice", F.pmod(F.col("_h"), F.col("slices")).cast("int"))
    order = W.partitionBy("bucket", "slice").orderBy("_h", "doc_id", "length")
    rows = rows.withColumn("_n", F.row_number().over(order) - 1)
    slice_of = (F.col("bucket").cast("long") * F.lit(1 << 24) + F.col("slice")) * F.lit(1 << 20)
    return rows.select("doc_id", "length", "bucket", "padded", (slice_of + F.floor(F.col("_n") / F.col("each"))).alias("batch"), (F.col("_n") % F.col("each")).cast("int").alias("position"))
