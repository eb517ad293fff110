"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into blocks by a seeded hash (a random permutation of each source, cut into blocks).
A source's quota is a number of passes over its blocks: whole passes, then blocks in permuted order
up to its target. The tree splits the vector of block quotas over the shards: each inner node draws
its left child's quotas without replacement from its own, so every shard's quotas are random and
their sums exact. A shard's draws are disjoint runs of the permuted blocks, shuffled inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithoframe.llm.common import WORD, staged, unused, word_count

#: Blocks of a source at most, and documents of a block at least.
MAX_BLOCKS, BLOCK_DOCS = 4096, 64
#: Sources at most: their sizes and quotas are held on the driver.
MAX_SOURCES = 100_000
#: Words of a shard about, shards at most, and quotas (sources times shards) at most.
SHARD_WORDS, MAX_SHARDS, MAX_QUOTAS = 4_000_000, 16_384, 4_000_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, ceiling: float = 2.0) -> list[float]:
    """share of all sizes dealt by weight; none over ceiling times its size, the excess dealt again."""
    n, out = len(sizes), [0.0] * len(sizes)
    open_, rest = list(range(n)), share * float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / total > ceiling * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = ceiling * sizes[i]
        rest = max(0.0, rest - sum(out[i] for i in over))
        open_ = [i for i in open_ if i not in set(over)]
    return out


def splitting_tree(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """quotas by source -> (shards, sources): random, rows as even as can be, columns' sums exact."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        take = int(round(int(have.sum()) * (mid - lo) / (hi - lo)))
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if have.size else have
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def _by_source(docs: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, list]:
    """Rows with their sizes, counted once; and the sources in code-point order, null last."""
    rows = staged(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("src"), word_count(text).alias("size")), "mix-sizes")
    found = rows.groupBy("src").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.src is None, r.src or ""))
    return rows, found


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 20, split_documents: bool = True, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, src, size, source_size, target, times, part, block, k, h.

    size is the number of words (null text: 0). times is how often the whole document is to be drawn and
    part the leading words drawn once more of the one document in which a source's target falls
    (split_documents), else that document is drawn when this comes nearer to the target.
    Sources take the weights in turn in code-point order, a null source last.
    Rows with equal id, source and size share one decision, so rerunning gives the same rows. Empty
    documents have nothing to take; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows, found = _by_source(docs, key, text, source)
    sizes = [int(r.words) for r in found]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], share, ceiling)
    table = []
    for k, (r, t, s) in enumerate(zip(found, goal, sizes, strict=True)):
        whole = int(t // s) if s else 0
        table.append((k, r.src, s, float(t), whole, int(round(t - whole * s)), min(MAX_BLOCKS, max(1, int(r.n) // BLOCK_DOCS))))
    quota = spark.createDataFrame(table, "k int, src string, source_size long, target double, whole int, rest long, blocks int")
    rows = rows.join(F.broadcast(quota), rows.src.eqNullSafe(quota.src), "inner").drop(quota.src)  # MAX_SOURCES rows at most
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("block", F.pmod("h", "blocks").cast("int"))
    blocks = rows.groupBy("k", "block", "rest", "blocks").agg(F.sum("size").alias("words"))
    before = W.partitionBy("k").orderBy("block")  # at most MAX_BLOCKS rows
    blocks = blocks.withColumn("upto", F.sum("words").over(before)).withColumn("start", F.col("upto") - F.col("words"))
    blocks = staged(blocks.select("k", "block", (F.col("upto") <= F.col("rest")).alias("all_in"), ((F.col("start") < F.col("rest")) & (F.col("upto") > F.col("rest"))).alias("at_edge"), "start"), "mix-blocks")
    rows = rows.join(blocks, ["k", "block"])
    # Inside the one block of a source in which its target falls, documents are taken in permuted order.
    edge = rows.filter("at_edge").withColumn("end", F.col("start") + F.sum("size").over(W.partitionBy("k", "block").orderBy("h", "doc_id", "size")))  # equal rows together
    room = F.col("rest") - (F.col("end") - F.col("size"))
    if split_documents:
        extra, part = (room >= F.col("size")).cast("int"), F.when((room > 0) & (room < F.col("size")), room).otherwise(0).cast("long")
    else:
        extra, part = ((room > 0) & (2 * room >= F.col("size"))).cast("int"), F.lit(0).cast("long")
    edge = edge.select(*rows.columns, extra.alias("extra"), part.alias("part"))
    rest = rows.filter("not at_edge").select("*", F.col("all_in").cast("int").alias("extra"), F.lit(0).cast("long").alias("part"))
    out = rest.unionByName(edge)
    return out.select("doc_id", "src", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("times"), "part", "block", "k", "h")


def draw(planned: DataFrame, seed: int = 20, shards: int | None = None) -> DataFrame:
    """What the shards hold: (doc_id, src, size, pass, block, words, shard, place), a row for each draw of a distinct plan row.

    words is size, or part for the leading words. A block of a source is drawn once in each pass that takes any
    of it; the draws of a source, by pass and permuted block, are cut into runs of the lengths that the tree gave
    the shards. Sorted by place, a shard is shuffled. The number of shards follows the words drawn, unless it
    is given.
    """
    spark = planned.sparkSession
    ids = planned.filter("size > 0 and times + part > 0").select("doc_id", "src", "size", "k", "block", "h", "times", "part").distinct()
    last = F.col("times") + (F.col("part") > 0).cast("int") - 1
    drawn = ids.select("*", F.explode(F.sequence(F.lit(0), last)).alias("pass"))
    drawn = staged(drawn.withColumn("words", F.when(F.col("pass") < F.col("times"), F.col("size")).otherwise(F.col("part"))).drop("times", "part"), "mix-drawn")
    used = drawn.groupBy("k", "pass", "block").agg(F.sum("words").alias("words"))
    runs = staged(used.select("k", "pass", "block", "words", F.row_number().over(W.partitionBy("k").orderBy("pass", "block")).alias("j")), "mix-runs")  # MAX_BLOCKS a pass at most
    count = sorted((r.k, int(r.n), int(r.words)) for r in runs.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).collect())
    if shards is None:
        shards = max(1, min(-(-sum(c[2] for c in count) // SHARD_WORDS), MAX_SHARDS, MAX_QUOTAS // max(1, len(count))))
    split = splitting_tree([n for _, n, _ in count], shards, seed)
    quotas = [(k, split[:, c].tolist()) for c, (k, _, _) in enumerate(count)]
    dealt = spark.createDataFrame(quotas, "k int, quotas array<long>").select("k", F.posexplode("quotas").alias("shard", "n")).filter("n > 0")
    dealt = dealt.withColumn("upto", F.sum("n").over(W.partitionBy("k").orderBy("shard")))
    dealt = dealt.select("k", "shard", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("j"))
    runs = runs.join(dealt, ["k", "j"]).select("k", "pass", "block", "shard")
    return drawn.join(runs, ["k", "pass", "block"]).select("doc_id", "src", "size", "pass", "block", "words", "shard", F.xxhash64("h", "pass", F.lit(seed)).alias("place"))


def tally(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per row of docs: doc_id, src, size, source_size, target, taken (words that the drawn shards hold of it).

    The target is met to the word: the document in which it falls is drawn in part. A row without draws has 0.
    Rows with equal id, source and size have equal draws; an empty table gives no rows.
    """
    planned = staged(plan(docs, key=key, text=text, source=source, **options), "mix-plan")
    held = draw(planned).groupBy("doc_id", "src", "size").agg(F.sum("words").alias("taken"))
    same = planned.doc_id.eqNullSafe(held.doc_id) & planned.src.eqNullSafe(held.src) & (planned["size"] == held["size"])
    return planned.join(held, same, "left").select(planned.doc_id, planned.src, planned["size"], "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 20, shards: int | None = None, split_documents: bool = False, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: rows of docs as often as drawn, with docs' columns and two more, shard and place.

    They are called _shard and _place, with a number if docs has such columns. Whole documents, each at most
    ceiling times; with split_documents the one in which a source's target falls comes once with its leading
    words only, joined by blanks. Empty documents are never drawn. Rows of a shard are shuffled when sorted by
    place. Rows with equal id, source and size are drawn together. An empty table gives no rows.
    """
    drawn = draw(plan(docs, weights, share, ceiling, seed, split_documents, key, text, source), seed, shards)
    names, at = docs.columns, docs.columns.index
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    k, t, s = f"c{at(key)}", f"c{at(text)}", f"c{at(source)}"
    own = own.withColumn("own_size", word_count(t))
    same = own[k].eqNullSafe(drawn["doc_id"]) & own[s].cast("string").eqNullSafe(drawn["src"]) & (own["own_size"] == drawn["size"])
    leading = F.array_join(F.expr(f"slice(regexp_extract_all({t}, '{WORD.replace(chr(92), chr(92) * 2)}', 0), 1, cast(words as int))"), " ")
    body = F.when(F.col("words") < F.col("size"), leading).otherwise(F.col(t)) if split_documents else F.col(t)
    columns = [(body if c == t else F.col(c)).alias(n) for c, n in zip(own.columns[:-1], names, strict=True)]
    return own.join(drawn, same).select(*columns, F.col("shard").alias(unused("_shard", names)), F.col("place").alias(unused("_place", names)))
