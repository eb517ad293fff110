"""Samples, recency and batches over members and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithoframe.functions.digests import fanout
from lithoframe.operators.health import ring, ring_start

def gossip_top(members: DataFrame, k: int) -> DataFrame:
    """k members(node, state) to gossip of: alive, then suspect, then dead; ties by node."""
    rank = F.when(F.col("state") == "alive", 0).when(F.col("state") == "suspect", 1).otherwise(2)
    return members.withColumn("rank", rank).orderBy("rank", "node").limit(k).drop("rank")


def fanout_sample(contents: DataFrame, alive: DataFrame) -> DataFrame:
    """max(1, ceil(ln n)) of n live members for each content: the next ones on the ring from its start."""
    members = ring(alive)
    n = members.agg(F.count(F.lit(1)).alias("n"))
    rows = contents.select("cid").join(F.broadcast(n)).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.least(fanout(F.col("n")), F.col("n")) - 1)))
    return rows.withColumn("place", (ring_start(F.col("cid"), F.col("n")) + F.col("d")) % F.col("n")).join(members, "place").select("cid", "node")


def random_members(alive: DataFrame, k: int, seed: str, exclude: int | None = None) -> DataFrame:
    rows = alive if exclude is None else alive.filter(F.col("node") != exclude)
    return rows.select("node").orderBy(F.md5(F.concat_ws(":", "node", F.lit(seed))), "node").limit(k)


def keep_recent(rows: DataFrame, group: str, last_used: str, tie: str, capacity: int) -> DataFrame:
    """The `capacity` most recently used rows of each group; ties by the smaller tie column."""
    order = W.partitionBy(group).orderBy(F.desc(last_used), F.asc(tie))
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= capacity).drop("_r")


def probe_round_robin(ticks: DataFrame, alive: DataFrame) -> DataFrame:
    """ticks(tick) -> (tick, node): the live members in turn, in order of the node."""
    order = alive.select("node", (F.row_number().over(W.orderBy("node")) - 1).alias("i"))
    n = alive.agg(F.count(F.lit(1)).alias("n"))
    return ticks.join(F.broadcast(n)).withColumn("i", F.pmod("tick", "n")).join(F.broadcast(order), "i").select("tick", "node")


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with batch: `size` at a time in order of key over the whole table, null keys last.

    Positions are ranks inside each span of 2^20 keys plus the rows of the spans before, so no task
    sorts more than a span.
    """
    spans = rows.withColumn("_s", F.floor(F.col(key) / F.lit(1 << 20)))
    sizes = spans.groupBy(F.col("_s").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_t", (F.sum("_n").over(W.orderBy(F.asc_nulls_last("_t"))) - F.col("_n")).alias("_before"))
    ranked = spans.withColumn("_r", F.row_number().over(W.partitionBy("_s").orderBy(key)) - 1)
    placed = ranked.join(sizes, F.col("_s").eqNullSafe(F.col("_t")))
    return placed.withColumn("batch", F.floor((F.col("_before") + F.col("_r")) / size).cast("long")).drop("_s", "_t", "_r", "_before")


def sequential_reads(reads: DataFrame, ahead: int = 8) -> DataFrame:
    """reads(stream, seq, page) -> first and last page to prefetch after a read that follows its predecessor."""
    before = F.lag("page").over(W.partitionBy("stream").orderBy("seq"))
    rows = reads.withColumn("_b", before).filter(F.col("page") == F.col("_b") + 1)
    return rows.select("stream", "seq", (F.col("page") + 1).alias("first"), (F.col("page") + ahead).alias("last"))
