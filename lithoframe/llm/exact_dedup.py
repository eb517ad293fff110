"""Exact duplicates by 128-bit content hash, with bytes compared inside the groups.

Built-in expressions only. The aggregate's keys are the hash and the text itself, so equality is of
bytes, and copies collapse before the shuffle, however many. Texts are shuffled once: duplicate_groups
joins back digests and ids only, and drop_duplicates takes the other columns along in the aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoframe.llm.common import staged, text_or_empty


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte for byte; null is the empty text, so null and empty rows form
    one group. The largest key of a group stays; of rows that repeat that key too (the same id twice
    with the same text), all are marked kept. Rows with a null key take part in the group size, and
    are kept only in a group without any other key. Other columns are ignored, so their names can't
    clash; an empty table gives no rows. Two unequal texts that share both digests raise an error
    instead of being merged.
    """
    body = text_or_empty(text)
    rows = docs.select(F.col(key).alias("doc_id"), F.md5(body).alias("h"), F.sha2(body, 256).alias("text_sha256"))
    groups = (
        docs.select(F.col(key).alias("doc_id"), F.md5(body).alias("h"), body.alias("body"))
        .groupBy("h", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    digests = groups.groupBy("h", "text_sha256").agg(
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("unequal texts share both digests"))).alias("clash"),
    )
    digests = staged(digests, "exact-groups")  # read back, the join can split a hot group's rows
    return rows.join(digests, ["h", "text_sha256"]).filter(F.col("clash").isNull()).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"
    )


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts: that of the largest key; columns and their order stay.

    Null is the empty text, but the row that stays keeps its null. Of rows that share the largest key, the
    one whose other columns are the largest, in their order, stays, so reruns agree (columns without an order,
    as maps, go with it). A null key is smaller than any other. The columns' names are not looked at, so any
    may occur, even twice beside key and text; an empty table gives no rows.
    """
    names, at = docs.columns, docs.columns.index
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    k, t = f"c{at(key)}", f"c{at(text)}"
    rest = [c for c in rows.columns if c not in (k, t)]
    first = [c for c in rest if _orderable(rows.schema[c].dataType)]
    other = [c for c in rest if c not in first]
    rank = F.struct(k, "told", *first)
    best = F.max(rank) if not other else F.max_by(F.struct(rank.alias("rank"), *other), rank)
    bodies = rows.select(k, *rest, F.col(t).isNotNull().alias("told"), text_or_empty(t).alias("body")).withColumn("h", F.md5("body"))
    kept = bodies.groupBy("h", "body").agg(best.alias("best"))
    whole = "best.rank" if other else "best"
    own = {k: F.col(f"{whole}.{k}"), t: F.when(F.col(f"{whole}.told"), F.col("body"))}
    own |= {c: F.col(f"{whole}.{c}") for c in first} | {c: F.col(f"best.{c}") for c in other}
    return kept.select(*[own[c].alias(n) for c, n in zip(rows.columns, names, strict=True)])
