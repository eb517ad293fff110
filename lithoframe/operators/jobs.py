"""Jobs over several operators: coding new contents, and repairing those that lost pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithoframe.operators import coding, health, objects


def encode_job(contents: DataFrame, known_pieces: DataFrame, k: int, me: int, index: DataFrame | None = None) -> dict[str, DataFrame]:
    """contents(cid, data) that aren't pieces -> pieces (2k + 16 each) to store, their index, and this node's holder rows."""
    pieces = coding.encode_pieces(objects.not_pieces(contents, known_pieces), k, 2 * k + 16)
    pieces = coding.piece_ids(pieces)
    held = pieces.groupBy("cid").agg(F.count(F.lit(1)).cast("int").alias("piece_count")).withColumn("node", F.lit(me))
    return {"pieces": pieces, "index": coding.piece_index(pieces, index), "holders": held.select("cid", "node", "piece_count")}


def repair_job(stored: DataFrame, k_of: DataFrame, alive: DataFrame, ranking: DataFrame, me: int) -> DataFrame:
    """stored(node, cid, p, vector, data) -> (cid, node, rank, target, vector, data): the pieces that repair makes.

    Contents short of pieces elect as many live holders as are missing, by rank; each that has two pieces or more
    combines two of them, without decoding, into one new piece for the content's target.
    """
    holders = stored.groupBy("cid", "node").agg(F.count(F.lit(1)).cast("int").alias("piece_count"))
    needs = health.triage(holders, k_of).filter("deficit > 0").select("cid", "deficit")
    short = holders.join(needs.select("cid"), "cid", "left_semi")  # healthy contents need no ranking
    ranked = health.rank(health.repairers(short, alive).join(ranking, "node").select("cid", "node", "uptime", "reputation"))
    elected = health.elect(ranked, needs).select("cid", "node", "rank")
    first = F.row_number().over(W.partitionBy("cid", "node").orderBy("p"))
    two = stored.join(elected, ["cid", "node"], "left_semi").withColumn("r", first).filter("r <= 2")
    able = two.groupBy("cid", "node").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n")
    joint = two.join(able, ["cid", "node"], "left_semi").withColumn("cid", F.concat_ws("/", F.col("cid").cast("string"), F.col("node").cast("string")))
    made = coding.recode_pieces(joint, 1).withColumn("own", F.split("cid", "/"))
    kind = stored.schema["cid"].dataType.simpleString()
    made = made.select(F.col("own")[0].cast(kind).alias("cid"), F.col("own")[1].cast(stored.schema["node"].dataType).alias("node"), "vector", "data")
    to = health.distribution_target(needs, holders, alive, me).select("cid", "target")
    return made.join(elected, ["cid", "node"]).join(to, "cid").select("cid", "node", "rank", "target", "vector", "data")
