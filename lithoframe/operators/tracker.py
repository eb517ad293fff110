"""Holders and providers of contents: upserts, counts, removals, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holder_upsert(reports: DataFrame, order: str = "seq") -> DataFrame:
    """Reports in `order` -> one row per (cid, node): the largest count, the last report's last_seen.

    `order` is one number, so that the aggregate's buffer has a fixed size and stays in a hash map.
    """
    return reports.groupBy("cid", "node").agg(F.max("piece_count").alias("piece_count"), F.max_by("last_seen", order).alias("last_seen"))


def available(holders: DataFrame) -> DataFrame:
    return holders.groupBy("cid").agg(F.sum("piece_count").cast("long").alias("available"))


def holder_list(holders: DataFrame) -> DataFrame:
    """Holders of each content in order of the node."""
    return holders.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("node", "piece_count"))).alias("holders"))


def first_writer(reports: DataFrame, value: str, order: str = "seq") -> DataFrame:
    return reports.groupBy("cid").agg(F.min_by(value, order).alias(value))


def provider_upsert(announcements: DataFrame) -> DataFrame:
    return announcements.groupBy("cid", "node").agg(F.max("announced_at").alias("announced_at"))


def provider_counts(providers: DataFrame) -> DataFrame:
    return providers.agg(F.count_distinct("cid").alias("contents"), F.count(F.lit(1)).alias("records"))


def expire(rows: DataFrame, seen: str, now: Column, max_age_s: float) -> DataFrame:
    """Rows younger than max_age_s."""
    return rows.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(seen).cast("timestamp")) < int(max_age_s * 1_000_000))


def remove_nodes(rows: DataFrame, dead: DataFrame) -> DataFrame:
    return rows.join(dead.select("node"), "node", "left_anti")


def forget_empty(k_of: DataFrame, holders: DataFrame) -> DataFrame:
    """k of contents that still have holders."""
    return k_of.join(holders.select("cid"), "cid", "left_semi")


def remove_provider(providers: DataFrame, pairs: DataFrame) -> DataFrame:
    return providers.join(pairs.select("cid", "node"), ["cid", "node"], "left_anti")


def provider_list(providers: DataFrame) -> DataFrame:
    """(cid, nodes): the nodes that announced a content, in order."""
    return providers.groupBy("cid").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def waiting(waiters: DataFrame) -> DataFrame:
    """Contents waited for, and waiters, in one row."""
    return waiters.agg(F.count_distinct("cid").alias("contents"), F.count(F.lit(1)).alias("waiters"))
