"""Structured Streaming forms of the operators: windows, dedup, rendezvous, membership."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lithoframe.session import shared_folder
from lithoframe.streaming.folds import STATE_NAMES, UNKNOWN, member_step


def source(spark: SparkSession, path: str, time: str = "ts", delay: str = "30 seconds") -> DataFrame:
    """A table's file or folder as a stream with a watermark; the schema is the files' own."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all there is and read back what it wrote; a restart goes on from its checkpoint."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/lithoframe/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def route(stream: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], kind: str = "event_type"):
    """Dispatch each micro-batch by kind to its handler; kinds without one are ignored."""

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        for name, handle in handlers.items():
            handle(batch.filter(F.col(kind) == name))
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).trigger(availableNow=True)


def ingest_holders(reports: DataFrame) -> DataFrame:
    """Run a stream of reports(cid, node, piece_count, last_seen) over all there is: the holders that it leaves.

    Each micro-batch is combined and appended under its number; a batch that is run again replaces its own
    folder, so nothing counts twice.
    """
    spark = reports.sparkSession
    at = f"{shared_folder(spark)}/lithoframe/holders-{uuid.uuid4().hex}"
    combine = lambda rows: rows.groupBy("cid", "node").agg(F.max("piece_count").alias("piece_count"), F.max("last_seen").alias("last_seen"))
    schema = combine(spark.createDataFrame([], reports.schema)).schema

    def each(batch: DataFrame, number: int) -> None:
        combine(batch).write.mode("overwrite").parquet(f"{at}/batch={number}")

    reports.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start().awaitTermination()
    return combine(spark.read.schema(schema).parquet(at).select(*schema.names))


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """Counts and sums by window and type; the same for batch and stream."""
    w = F.window("ts", width)
    return events.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy(w, "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def single_flight(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def membership_stream(messages: DataFrame) -> DataFrame:
    """messages(node, seq, kind, inc) -> each node's state after each micro-batch, as an append stream.

    State is kept for each node; within a micro-batch messages are taken in order of seq.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        st, inc, up, down = state.get if state.exists else (UNKNOWN, 0, 0, 0)
        rows = pd.concat(list(parts)).sort_values("seq")
        for kind, n in zip(rows["kind"], rows["inc"], strict=True):
            st, inc, event = member_step(st, inc, kind, int(n))
            up, down = up + (event == "connected"), down + (event == "disconnected")
        state.update((st, inc, up, down))
        yield pd.DataFrame({"node": [key[0]], "seq": [int(rows["seq"].iloc[-1])], "state": [STATE_NAMES.get(st, "unknown")], "incarnation": [inc], "connects": [up], "disconnects": [down]})

    return messages.groupBy("node").applyInPandasWithState(step, "node long, seq long, state string, incarnation long, connects int, disconnects int", "st int, inc long, up int, down int", "append", GroupStateTimeout.NoTimeout)


def rendezvous(requests: DataFrame, responses: DataFrame, within: str = "120 seconds") -> DataFrame:
    """requests(cid, waiter, ts) with the first response(cid, resp_ts) not before them and within the wait.

    Unanswered requests stay, with a null; responses nobody waits for are dropped. One pass back in time
    over both tables: no pairs are made. A row window doesn't run on a stream; there, join the two streams
    on cid and the interval, under watermarks.
    """
    asked = requests.select("cid", "waiter", "ts", F.lit(None).cast("timestamp_ntz").alias("resp_ts"), F.lit(1).alias("asks"))
    told = responses.select("cid", F.lit(None).cast("long").alias("waiter"), F.col("resp_ts").alias("ts"), F.col("resp_ts").cast("timestamp_ntz"), F.lit(0).alias("asks"))
    back = W.partitionBy("cid").orderBy(F.desc("ts"), "asks").rowsBetween(W.unboundedPreceding, 0)
    met = asked.union(told).withColumn("resp_ts", F.last("resp_ts", ignorenulls=True).over(back)).filter("asks = 1")
    return met.select("cid", "waiter", "ts", F.when(F.col("resp_ts") < F.col("ts") + F.expr(f"INTERVAL {within}"), F.col("resp_ts")).alias("resp_ts"))
