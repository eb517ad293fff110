"""Tiles: groups of candidate rows, the large ones cut so that no task holds more than two blocks.

A group of n members is dealt to ceil(n / BLOCK) blocks, and every pair of blocks is a tile. Members
meet in exactly one tile, so each pair is seen once for its group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import trimmed


def tiled(members: DataFrame, member: str, blocks: Column) -> DataFrame:
    """members with tile_i, tile_j and side (the own block is 0: rows, 1: columns, 2: both of the tile).

    `blocks` is the number of blocks of the row's group, the same for all its members.
    """
    own = F.pmod(F.xxhash64(F.col(member), F.lit(3)), F.col("_blocks")).cast("int")
    rows = members.withColumn("_blocks", blocks.cast("int")).withColumn("_own", own)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    i, j = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    return rows.withColumn("side", side.cast("int")).withColumn("tile_i", i).withColumn("tile_j", j).drop("_blocks", "_own", "_other")


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by key -> tables of whole groups (many groups a table; a group is never cut)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        first = [b.column(k)[0].as_py() for k in key]
        last = [b.column(k)[b.num_rows - 1].as_py() for k in key]
        if held and [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in key] != first:
            yield pa.Table.from_batches(held)
            held = []
        if first == last:
            held.append(b)
            continue
        keys = [b.column(k).to_numpy(zero_copy_only=False) for k in key]
        new = np.zeros(b.num_rows, dtype=bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cut = int(np.flatnonzero(new)[-1])
        held.append(b.slice(0, cut))
        yield pa.Table.from_batches(held)
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, key: list[str]) -> np.ndarray:
    """Offsets of the groups of a table sorted by key."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in key:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


class Forest:
    """Union-find over 0..n-1; the root is the smallest number of its set."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def join_matrix(self, links: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        """Unite row r's member with the members of its true columns, without listing all pairs."""
        for r in np.flatnonzero(links.any(axis=1)):
            a = self.find(int(rows[r]))
            for c in cols[links[r]]:
                if self.up[int(c)] != a or a != self.find(a):
                    self.join(a, int(c))
                    a = self.find(a)


def spread(df: DataFrame, key: list[str], make: Callable, schema: str) -> DataFrame:
    """Deal df by tile, sort in partitions, and run make over the stream of whole groups."""
    return df.repartition(*key).sortWithinPartitions(*key).mapInArrow(trimmed(make), schema)
