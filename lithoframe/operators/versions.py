"""Pages, page indexes, commits, snapshots and signed writes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithoframe.functions.digests import cid, le32

PAGE_BYTES = 16_384
ZERO_ROOT = "00" * 32


def to_pages(files: DataFrame, key: str, data: str, size: int = PAGE_BYTES) -> DataFrame:
    """(key, page_num, data): chunks of `size` bytes from 0, the last one padded with zeros."""
    body = F.col(data).cast("binary")
    n = F.greatest(F.ceil(F.octet_length(body) / size), F.lit(0)).cast("int")
    rows = files.select(F.col(key), body.alias("body"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("array()").cast("array<int>"))).alias("page_num"))
    return rows.select(key, "page_num", F.rpad(F.substring("body", F.col("page_num") * size + 1, F.lit(size)), size, F.lit(b"\x00")).alias("data"))


def page_index(pages: DataFrame) -> DataFrame:
    return pages.withColumn("cid", cid(F.col("data"))).drop("data")


def read_pages(index: DataFrame, store: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("page_num",)) -> DataFrame:
    """wanted(keys) resolved over the index(keys, cid) to the store's objects: cid and data null if there is none."""
    return wanted.join(index.select(*keys, "cid"), list(keys), "left").join(store.select("cid", "data"), "cid", "left")


def checked_pages(pages: DataFrame, size: int = PAGE_BYTES) -> DataFrame:
    """Pages to write; one that isn't `size` bytes long fails the write."""
    return pages.withColumn("data", F.when(F.octet_length("data") == size, F.col("data")).otherwise(F.raise_error(F.lit(f"a page has {size} bytes"))))


def latest(log: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """The last row of each key in `order`: last write wins, combined before the shuffle."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


def snapshot(log: DataFrame, version: int | Column, keys: list[str], *values: str) -> DataFrame:
    """log(keys, version, values) as of a version; a null in the first value is a tombstone."""
    return latest(log.filter(F.col("version") <= version), keys, "version", *values).filter(F.col(values[0]).isNotNull())


def root_cid(index: DataFrame, group: list[str]) -> DataFrame:
    """Digest of the serialised index: count, then (page_num, cid) in order of page_num, little-endian; a null cid is no entry."""
    entries = F.array_sort(F.collect_list(F.when(F.col("cid").isNotNull(), F.struct("page_num", "cid"))))
    listed = index.groupBy(*group).agg(entries.alias("e"))
    text = F.concat(le32(F.size("e")), F.array_join(F.transform("e", lambda x: F.concat(le32(x["page_num"]), x["cid"])), ""))
    return listed.select(*group, F.size("e").alias("pages"), F.sha2(F.unhex(text), 256).alias("root"))


def commit_roots(log: DataFrame, every: int) -> DataFrame:
    """log(page_num, version, cid) -> (version, pages, root) at each `every`-th version and the last one.

    A page's last write of each interval is kept and carried on to later commits, so the log is read once
    however many commits there are.
    """
    last = log.agg(F.max("version").cast("long").alias("last"))
    commits = last.select(F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("last") / every)), lambda k: F.least(k * every, F.col("last")))).alias("at"))
    told = log.join(F.broadcast(last)).withColumn("at", F.least(F.ceil(F.col("version") / every) * every, F.col("last")))
    told = latest(told.withColumn("write", F.struct("cid")), ["at", "page_num"], "version", "write")
    grid = log.select("page_num").distinct().crossJoin(F.broadcast(commits)).join(told, ["at", "page_num"], "left")
    carried = F.last("write", ignorenulls=True).over(W.partitionBy("page_num").orderBy("at"))
    return root_cid(grid.select("at", "page_num", carried["cid"].alias("cid")), ["at"]).withColumnRenamed("at", "version")


def parse_index(serialised: Column) -> Column:
    """Hex of an index -> array of (page_num, cid); null if shorter than its count says; more is ignored."""
    number = lambda at: F.conv(F.concat(*[F.substring(serialised, at + d, F.lit(2)) for d in (6, 4, 2, 0)]), 16, 10).cast("long")
    n = number(F.lit(1))
    fits = (F.length(serialised) >= 8) & (F.length(serialised) >= 8 + n * 72)
    entry = lambda i: F.struct(number((9 + i * 72).cast("int")).alias("page_num"), F.substring(serialised, (17 + i * 72).cast("int"), F.lit(64)).alias("cid"))
    listed = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), entry)).otherwise(F.expr("cast(array() as array<struct<page_num:bigint,cid:string>>)"))
    return F.when(fits, listed)


def merkle_roots(leaves: DataFrame, group: str, levels: int | None = None) -> DataFrame:
    """leaves(group, pos from 0, hash) -> (group, root): pairs are hashed, an odd level repeats its last.

    One aggregate a level, over as many levels as log2 of the largest group, found by one aggregate, or
    over `levels` if those are more; a single leaf is its root.
    """
    at = leaves.select(group, F.col("pos").cast("long").alias("pos"), "hash")
    last = at.agg(F.max("pos")).first()[0] or 0
    levels = max(levels or 0, last.bit_length())
    for _ in range(levels):
        n = F.count(F.lit(1)).over(W.partitionBy(group)).alias("n")
        pair = at.select(group, "pos", "hash", n).groupBy(group, F.floor(F.col("pos") / 2).alias("pos"))
        up = pair.agg(F.min_by("hash", "pos").alias("l"), F.max_by("hash", "pos").alias("r"), F.first("n").alias("n"))
        at = up.select(group, "pos", F.when(F.col("n") == 1, F.col("l")).otherwise(F.sha2(F.unhex(F.concat("l", "r")), 256)).alias("hash"))
    return at.filter("pos = 0").select(group, F.col("hash").alias("root"))


def cas_conflict(expected: Column, current: Column) -> Column:
    """A conflict only if both roots are there and differ."""
    return expected.isNotNull() & current.isNotNull() & (expected != current)


def fold_writes(log: DataFrame, db: str, order: str) -> DataFrame:
    """log(db, order, writer, owner, signed, expected, root) -> verdict of each write, in order.

    A write is accepted if it is signed, by the owner, and its expected root is null, or the current
    root, or there is no root yet; then its root becomes the current one. The verdict of a write depends
    on all before it, so each database's log is one group; the fold is linear in it.
    """
    kind, kinds = log.schema[order].dataType.simpleString(), log.schema[db].dataType.simpleString()

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("o")
        current, told = None, []
        for writer, owner, signed, expected, root in zip(group["writer"], group["owner"], group["signed"], group["expected"], group["root"], strict=True):
            if not signed:
                told.append("bad_signature")
            elif writer != owner:
                told.append("unauthorized")
            elif expected is not None and current is not None and expected != current:
                told.append("conflict")
            else:
                told.append("accepted")
                current = root
        return pd.DataFrame({db: group["db"], order: group["o"], "verdict": told})

    rows = log.select(F.col(db).alias("db"), F.col(order).alias("o"), "writer", "owner", "signed", "expected", "root")
    return rows.groupBy("db").applyInPandas(fold, f"{db} {kinds}, {order} {kind}, verdict string")


def migration_class(sql: Column) -> Column:
    """blank is rejected; anything without a schema word is only warned of."""
    upper = F.upper(sql)
    return F.when(F.trim(sql) == "", "rejected").when(upper.rlike("CREATE|ALTER|DROP|RENAME"), "ok").otherwise("warned")


def unreachable(objects: DataFrame, roots: DataFrame, index: DataFrame, min_age_s: float = 330.0) -> DataFrame:
    """Mark and sweep: objects(cid, age_s) old enough that no live root(root) reaches over index(root, cid)."""
    live = index.join(roots.select("root"), "root", "left_semi").select("cid")
    return objects.filter(F.col("age_s") > min_age_s).join(live, "cid", "left_anti")
