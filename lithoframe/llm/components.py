"""Connected components of an edge table, by rounds of hooking and contraction.

Every step is a join or a combinable aggregate, so neither a hot vertex nor a large component is
gathered in one task; nothing but row counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.common import staged

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (id, component): smallest id reachable, for every id in an edge.

    Self-loops keep their vertex; repeated edges and both directions are allowed; nulls are ignored.
    Each round hooks a vertex to its smallest neighbour, shortens the hooks, contracts the edges to
    roots and drops loops: vertices that still have edges at least halve.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    label = staged(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("id"), F.col("a").alias("component")), "cc-ids")
    left = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            return label
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"))
        hook = staged(hook, "cc-hook")
        for _ in range(2):  # hooks always point to smaller ids, so the jumps end at or before a root
            up = hook.select(F.col("v").alias("u"), F.col("p").alias("pp"))
            hook = hook.join(up, hook.p == up.u, "left").select("v", F.coalesce("pp", "p").alias("p"))
        hook = staged(hook, "cc-jump")
        label = staged(label.join(hook, label.component == hook.v, "left").select("id", F.coalesce("p", "component").alias("component")), "cc-label")
        x, y = hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = left.join(x, "a").join(y, "b").filter("pa <> pb")
        left = staged(moved.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "cc-edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
