"""Health scan and repair: triage, cursor batches, ranking, election, placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithoframe.functions.digests import DEFAULT_K, deficit, severity, target_pieces
from lithoframe.operators.tracker import available


def triage(holders: DataFrame, k_of: DataFrame) -> DataFrame:
    """cid, k, available, target, severity, deficit of every content with holders or a k."""
    both = k_of.join(available(holders), "cid", "full").select("cid", F.coalesce("k", F.lit(DEFAULT_K)).cast("long").alias("k"), F.coalesce("available", F.lit(0)).cast("long").alias("available"))
    a, k = F.col("available"), F.col("k")
    return both.select("cid", "k", "available", target_pieces(k).alias("target"), severity(a, k).alias("severity"), F.when(severity(a, k) == "healthy", F.lit(0).cast("long")).otherwise(deficit(a, k)).alias("deficit"))


def eligible(holders: DataFrame, me: int) -> DataFrame:
    """Contents of which the scanning node has two pieces or more: enough to recode."""
    return holders.filter((F.col("node") == me) & (F.col("piece_count") >= 2)).select("cid").distinct()


def cursor_batch(contents: DataFrame, share: float, cursor: int) -> DataFrame:
    """The next max(1, ceil(n * share)) contents in order from the cursor, wrapping around.

    Positions come from a global sort: ranks inside range partitions plus the partitions' offsets, so
    no task sees more than its partition.
    """
    ranged = contents.select("cid").distinct().orderBy("cid").withColumn("part", F.spark_partition_id())
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy(F.lit(1))).alias("total"))
    placed = ranged.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("cid"))).join(sizes, "part")
    pos = F.col("before") + F.col("r") - 1
    take = F.greatest(F.lit(1), F.ceil(F.col("total") * share))
    return placed.filter(F.pmod(pos - F.lit(cursor) % F.col("total"), F.col("total")) < take).select("cid", pos.cast("long").alias("position"))


def rank(candidates: DataFrame) -> DataFrame:
    """candidates(cid, node, uptime, reputation) with rank: uptime, reputation descending, node ascending."""
    clean = candidates.filter(~F.isnan("reputation"))
    return clean.withColumn("rank", F.row_number().over(W.partitionBy("cid").orderBy(F.desc("uptime"), F.desc("reputation"), F.asc("node"))))


def elect(ranked: DataFrame, needs: DataFrame) -> DataFrame:
    """The first `deficit` candidates of each content: a different number for each."""
    return ranked.join(needs.select("cid", "deficit"), "cid").filter(F.col("rank") <= F.col("deficit")).drop("deficit")


def repairers(holders: DataFrame, alive: DataFrame, me: int | None = None) -> DataFrame:
    """Holders that are alive, or this node itself."""
    found = holders.join(alive.select("node"), "node", "left_semi")
    return found if me is None else found.unionByName(holders.filter(F.col("node") == me)).dropDuplicates(["cid", "node"])


def ring(members: DataFrame) -> DataFrame:
    """members(node) with place 0..n-1 in order of the node; as many rows as the cluster has members."""
    return members.select("node", (F.row_number().over(W.orderBy("node")) - 1).cast("long").alias("place"))


def ring_start(content: Column, n: Column) -> Column:
    """Where a content's walk around the ring begins."""
    return F.conv(F.substring(F.md5(content.cast("string")), 1, 7), 16, 10).cast("long") % n


def distribution_target(contents: DataFrame, holders: DataFrame, alive: DataFrame, me: int) -> DataFrame:
    """Where a new piece of each content goes: a live holder of one piece, else a live node without any,
    else any live node, never this one. Of equals, the first on the ring from the content's start.

    A content with h holders walks h + 1 places at most, so the work follows the holders' table.
    """
    others = ring(alive.filter(F.col("node") != me))
    n = others.agg(F.count(F.lit(1)).alias("n"))
    all_ = contents.select("cid").distinct().join(F.broadcast(n)).withColumn("start", ring_start(F.col("cid"), F.col("n")))
    held = holders.select("cid", "node", "piece_count").join(others, "node")
    one = all_.join(held.filter("piece_count = 1"), "cid").select("cid", F.pmod(F.col("place") - F.col("start"), F.col("n")).alias("d"), "node")
    one = one.groupBy("cid").agg(F.min_by("node", "d").alias("first"))
    walk = all_.join(held.groupBy("cid").agg(F.count(F.lit(1)).alias("h")), "cid", "left")
    walk = walk.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.coalesce("h", F.lit(0)), F.col("n") - 1))))
    walk = walk.withColumn("place", (F.col("start") + F.col("d")) % F.col("n")).join(others, "place").join(held.select("cid", "node", F.lit(1).alias("taken")), ["cid", "node"], "left")
    free = F.when(F.col("taken").isNull(), F.col("node"))
    rest = walk.groupBy("cid").agg(F.min_by(free, F.when(free.isNotNull(), F.col("d"))).alias("second"), F.min_by("node", "d").alias("third"))
    both = rest.join(one, "cid", "left")
    return both.select("cid", F.coalesce("first", "second", "third").alias("target"), F.when(F.col("first").isNotNull(), 1).when(F.col("second").isNotNull(), 2).otherwise(3).alias("tier"))


def round_robin(pieces: DataFrame, nodes: DataFrame, per_node: int = 2) -> DataFrame:
    """pieces(cid, piece) dealt to nodes in order, per_node at a time."""
    n = nodes.select("node", F.row_number().over(W.orderBy("node")).alias("i"), F.count(F.lit(1)).over(W.partitionBy(F.lit(1))).alias("n"))
    p = pieces.withColumn("j", F.row_number().over(W.partitionBy("cid").orderBy("piece")) - 1)
    size = nodes.agg(F.count(F.lit(1)).alias("n"))
    return p.join(F.broadcast(size)).withColumn("i", F.pmod(F.floor(F.col("j") / per_node), F.col("n")) + 1).drop("n", "j").join(n.select("node", "i"), "i").drop("i")
