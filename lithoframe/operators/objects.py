"""Content-addressed objects: put, get, contains, delete, usage, bloom membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lithoframe.functions.digests import cid, shard, verify

#: Bits of a bloom filter and hashes of a key (about 1 % false positives at a million keys).
BLOOM_BITS, BLOOM_HASHES = 9_585_059, 7


def address(data: DataFrame, column: str = "data") -> DataFrame:
    return data.withColumn("cid", cid(F.col(column)))


def put(data: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """(cid, data) of the objects to write: distinct contents that the store doesn't have."""
    new = address(data).select("cid", "data").dropDuplicates(["cid"])
    return new if store is None else new.join(store.select("cid"), "cid", "left_anti")


def write_objects(objects: DataFrame, path: str) -> None:
    """Append to a store laid out by the first byte of the id, so that a lookup by id reads one shard."""
    objects.withColumn("shard", shard(F.col("cid"))).write.mode("append").partitionBy("shard").parquet(path)


def get(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(cid) -> (cid, data), data null if absent; a stored object that isn't its id raises an error."""
    checked = F.when(verify(F.col("data"), F.col("cid")), F.col("data")).otherwise(F.raise_error(F.lit("object doesn't match its id")))
    return wanted.select("cid").join(store.select("cid", "data"), "cid", "left").select("cid", F.when(F.col("data").isNotNull(), checked).alias("data"))


def contains(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with a boolean column present."""
    keys = store.select(F.col("cid"), F.lit(True).alias("present")).dropDuplicates(["cid"])
    return wanted.join(keys, "cid", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def list_cids(names: DataFrame, column: str = "name") -> DataFrame:
    """(cid) of the names that are ids: 64 hex digits, in lower case; other files are skipped."""
    return names.filter(F.col(column).rlike("^[0-9a-fA-F]{64}$")).select(F.lower(column).alias("cid")).distinct()


def not_pieces(contents: DataFrame, pieces: DataFrame) -> DataFrame:
    """Contents(cid) that aren't themselves coded pieces(piece_id): pieces aren't coded again."""
    return contents.join(pieces.select(F.col("piece_id").alias("cid")), "cid", "left_anti")


def get_codes(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(name) -> (name, code) as a program sees it: the object's bytes, -1 absent, -2 not an id, -3 damaged."""
    asked = wanted.select("name", F.when(F.col("name").rlike("^[0-9a-f]{64}$"), F.col("name")).alias("cid"))
    got = asked.join(store.select("cid", "data"), "cid", "left")
    code = F.when(F.col("cid").isNull(), -2).when(F.col("data").isNull(), -1).when(~verify(F.col("data"), F.col("cid")), -3).otherwise(F.octet_length("data"))
    return got.select("name", code.cast("long").alias("code"))


def counters(rows: DataFrame, name: str, **counts) -> tuple[DataFrame, Observation]:
    """rows, and what counts them as they pass: its get holds the counters after an action."""
    seen = Observation(name)
    return rows.observe(seen, *[c.alias(k) for k, c in counts.items()]), seen


def delete(store: DataFrame, gone: DataFrame) -> DataFrame:
    return store.join(gone.select("cid"), "cid", "left_anti")


def usage(store: DataFrame, data: str = "data") -> DataFrame:
    """Objects and their bytes, in one row."""
    return store.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum(F.octet_length(data)), F.lit(0)).alias("bytes"))


def shard_histogram(store: DataFrame) -> DataFrame:
    return store.groupBy(shard(F.col("cid")).alias("shard")).agg(F.count(F.lit(1)).alias("objects"))


def bloom_bits(key: str = "cid"):
    """Bit numbers of a key, taken from its digest."""
    part = lambda i: F.conv(F.substring(F.col(key), 1 + 8 * i, 8), 16, 10).cast("long") % BLOOM_BITS
    return F.array(*[part(i) for i in range(BLOOM_HASHES)])


def bloom_build(store: DataFrame) -> DataFrame:
    """The filter as (bucket, bitmap) rows: at most BLOOM_BITS / 32,768 of them, whatever the store's size."""
    bits = store.select(F.explode(bloom_bits()).alias("bit"))
    return bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def bloom_contains(keys: DataFrame, bloom: DataFrame) -> DataFrame:
    """keys(cid) with `maybe`: false means certainly absent. The filter's size is fixed, so it is broadcast."""
    probes = keys.select("cid", F.explode(bloom_bits()).alias("bit")).withColumn("bucket", F.bitmap_bucket_number("bit"))
    hit = probes.join(F.broadcast(bloom), "bucket", "left")
    byte = "cast(conv(hex(substring(bitmap, cast(floor(bitmap_bit_position(bit) / 8) as int) + 1, 1)), 16, 10) as int)"
    set_ = F.coalesce(F.expr(f"(shiftright({byte}, cast(bitmap_bit_position(bit) % 8 as int)) & 1) = 1"), F.lit(False))
    return hit.groupBy("cid").agg(F.min(set_.cast("int")).alias("m")).select("cid", (F.col("m") == 1).alias("maybe"))


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON arrays of values, binary in lower-case hex."""
    kinds = dict(rows.dtypes)
    values = {c: F.lower(F.hex(c)) if kinds[c] == "binary" else F.col(c) for c in rows.columns}
    return rows.select(F.to_json(F.struct(*[v.alias(c) for c, v in values.items()])).alias("json"))
