"""How the model's inputs are read off the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.functions.digests import epoch_ms
from lithoframe.session import table

#: The same projections for the oracle.
SQL = {
    "reports": "(SELECT l_partkey AS cid, l_suppkey AS node, CAST(floor(l_quantity / 10) AS INT) AS piece_count, l_shipdate AS last_seen, (l_orderkey * 100 + l_linenumber) * 100000 + datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS seq FROM lineitem)",
    "holders": "(SELECT l_partkey AS cid, l_suppkey AS node, max(CAST(floor(l_quantity / 10) AS INT)) AS piece_count FROM lineitem GROUP BY 1, 2)",
    "k_of": "(SELECT p_partkey AS cid, p_size AS k FROM part)",
    "alive": "(SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 7 <> 0)",
    "ranking": "(SELECT s_suppkey AS node, CAST(floor(abs(s_acctbal) / 2500) AS BIGINT) AS uptime, round(abs(s_acctbal) / 10000, 1) AS reputation FROM supplier)",
    "members": "(SELECT user_id AS node, event_id AS seq, CASE event_type WHEN 'view' THEN 'alive' WHEN 'click' THEN 'alive' WHEN 'error' THEN 'suspect' WHEN 'purchase' THEN 'dead' ELSE 'ping' END AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 AS inc FROM events)",
    "clocks": "(SELECT user_id AS node, event_id AS seq, (epoch_us(ts) // 1000) AS wall_ms, CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE ((epoch_us(ts) // 1000) + (CAST(json_extract_string(props, '$.k') AS BIGINT) - 70) * 700) * 65536 + CAST(json_extract_string(props, '$.k') AS BIGINT) END AS remote FROM events)",
    "runs": "(SELECT user_id AS program, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'ok' WHEN event_type = 'view' THEN 'fuel' ELSE 'error' END AS outcome FROM events)",
    "writes": "(SELECT o_custkey % 100 AS db, o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey % 100 END AS writer, o_custkey % 100 AS owner, o_orderkey % 13 <> 0 AS signed, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'r' || CAST(o_orderkey % 4 AS VARCHAR) END AS expected, 'r' || CAST(o_orderkey % 5 AS VARCHAR) AS root FROM orders)",
    "page_log": "(SELECT o_custkey % 10 AS page_num, row_number() OVER (ORDER BY o_orderkey) AS version, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS cid FROM orders)",
}


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Holder reports; seq orders them, by the date where a line of an order occurs twice."""
    seq = (F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 100_000 + F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("cid"), F.col("l_suppkey").alias("node"), F.floor(F.col("l_quantity") / 10).cast("int").alias("piece_count"), F.col("l_shipdate").alias("last_seen"), seq.alias("seq"))


def holders(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d).groupBy("cid", "node").agg(F.max("piece_count").alias("piece_count"))


def k_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("cid"), F.col("p_size").alias("k"))


def alive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").filter("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("node"))


def ranking(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.floor(F.abs("s_acctbal") / 2500).cast("long").alias("uptime"), F.round(F.abs("s_acctbal") / 10000, 1).alias("reputation"))


def prop_k():
    return F.get_json_object("props", "$.k").cast("long")


def members(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "alive").when(F.col("event_type") == "error", "suspect").when(F.col("event_type") == "purchase", "dead").otherwise("ping")
    return table(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), kind.alias("kind"), (prop_k() % 6).alias("inc"))


def clocks(spark: SparkSession, d: str) -> DataFrame:
    ms = epoch_ms(F.col("ts"))
    remote = F.when(~F.col("event_type").isin("view", "click"), (ms + (prop_k() - 70) * 700) * 65536 + prop_k())
    return table(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), ms.alias("wall_ms"), remote.alias("remote"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "view", "fuel").otherwise("error")
    return table(spark, d, "events").select(F.col("user_id").alias("program"), F.col("event_id").alias("seq"), outcome.alias("outcome"))


def writes(spark: SparkSession, d: str) -> DataFrame:
    o, own = F.col("o_orderkey"), F.col("o_custkey") % 100
    return table(spark, d, "orders").select(
        own.alias("db"), "o_orderkey", F.when(o % 11 == 0, F.lit(-1).cast("long")).otherwise(own).alias("writer"), own.alias("owner"), (o % 13 != 0).alias("signed"),
        F.when(o % 3 != 0, F.concat(F.lit("r"), (o % 4).cast("string"))).alias("expected"), F.concat(F.lit("r"), (o % 5).cast("string")).alias("root"),
    )


def page_log(spark: SparkSession, d: str) -> DataFrame:
    """Writes of ten pages; the version is the order's number plus one (keys count from 0 without gaps)."""
    o = F.col("o_orderkey")
    return table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("page_num"), (o + 1).alias("version"), F.when(o % 17 != 0, F.sha2(o.cast("string"), 256)).alias("cid"))
