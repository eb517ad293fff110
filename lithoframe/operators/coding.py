"""Random linear coding over GF(2^8), its decoder, and homomorphic tags.

Pieces are whole byte strings: encoding is done where the object is, without a shuffle; recoding and
decoding take a content's pieces as one group. The byte-wise forms (split, combine, tags) are joins under
an XOR aggregate, for relations of single bytes. Coefficients come from digests, so that reruns and other
engines agree.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.gf256 import byte_at, mul, products, tables

TAG_BYTES = 32


def coefficient(*parts: Column) -> Column:
    """A non-zero field element from the digest of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 6), 16, 10).cast("long") % 255 + 1).cast("int")


def piece_size(k: int) -> Column:
    """Bytes of each of k pieces of data: ceil(len / k), 1 if it is empty."""
    return F.greatest(F.ceil(F.octet_length("data") / k), F.lit(1)).cast("int")


def split(objects: DataFrame, k: int) -> DataFrame:
    """objects(cid, data) -> (cid, j, off, b): k pieces of ceil(len / k) bytes (1 if empty), zero padded."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = objects.select("cid", F.col("data").cast("binary").alias("data"), piece_size(k).alias("size"))
    cells = rows.select("cid", "data", "size", F.explode(F.sequence(F.lit(0), F.col("size") * k - 1)).alias("pos"))
    return cells.select("cid", F.floor(F.col("pos") / F.col("size")).cast("int").alias("j"), (F.col("pos") % F.col("size")).cast("int").alias("off"), byte_at(F.col("data"), F.col("pos") + 1).alias("b"))


def vectors(contents: DataFrame, k: int, pieces: int, seed: str = "e") -> DataFrame:
    """contents(cid) -> (cid, p, j, c): coding vectors of `pieces` coded pieces."""
    grid = contents.select("cid", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("p")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return grid.withColumn("c", coefficient(F.lit(seed), F.col("cid").cast("string"), F.col("p").cast("string"), F.col("j").cast("string")))


def combine(cells: DataFrame, coefficients: DataFrame) -> DataFrame:
    """cells(cid, j, off, b) x coefficients(cid, p, j, c) -> (cid, p, off, b): sums of c * b over the field."""
    met = cells.join(coefficients, ["cid", "j"])
    return met.groupBy("cid", "p", "off").agg(F.bit_xor(mul(F.col("c"), F.col("b"))).cast("int").alias("b"))


def encode_pieces(objects: DataFrame, k: int, pieces: int, seed: str = "e") -> DataFrame:
    """objects(cid, data) -> (cid, p, vector, data): coded pieces as byte strings, made where the object is."""
    if k < 1:
        raise ValueError("k must be at least 1")
    text = lambda x: x.cast("string")
    one = lambda p: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: coefficient(F.lit(seed), text(F.col("cid")), text(p), text(j)))
    rows = objects.select("cid", F.coalesce(F.col("data").cast("binary"), F.lit(b"")).alias("data"), F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), one).alias("vectors"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = products()
        for b in batches:
            for i in range(b.num_rows):
                raw = np.frombuffer(b.column("data")[i].as_py(), dtype=np.uint8)
                size = max(1, -(-len(raw) // k))
                parts = np.zeros((k, size), dtype=np.uint8)
                parts.reshape(-1)[: len(raw)] = raw
                vector = b.column("vectors")[i].as_py()
                coded = [np.bitwise_xor.reduce(table[np.asarray(v)[:, None], parts], axis=0).tobytes() for v in vector]
                yield pa.record_batch({"cid": pa.concat_arrays([b.column("cid").slice(i, 1)] * pieces), "p": pa.array(range(pieces), pa.int32()), "vector": pa.array(vector, pa.list_(pa.int32())), "data": pa.array(coded, pa.binary())})

    return rows.mapInArrow(turn, f"cid {rows.schema['cid'].dataType.simpleString()}, p int, vector array<int>, data binary")


def recode_pieces(pieces: DataFrame, count: int, seed: str = "n") -> DataFrame:
    """pieces(cid, p, vector, data) -> (cid, p, vector, data): `count` new pieces of each content, combined from
    all of its rows in order of p, without decoding. A content without pieces has none."""

    def turn(group: pd.DataFrame) -> pd.DataFrame:
        group, table, cid = group.sort_values("p"), products(), group["cid"].iloc[0]
        old = np.concatenate([np.stack([np.asarray(v, dtype=np.uint8) for v in group["vector"]]), np.stack([np.frombuffer(d, dtype=np.uint8) for d in group["data"]])], axis=1)
        k = len(group["vector"].iloc[0])
        scale = np.asarray([[int(hashlib.md5(f"{seed}:{cid}:{q}:{p}".encode()).hexdigest()[:6], 16) % 255 + 1 for p in group["p"]] for q in range(count)])
        new = np.stack([np.bitwise_xor.reduce(table[s[:, None], old], axis=0) for s in scale])
        return pd.DataFrame({"cid": [cid] * count, "p": range(count), "vector": [r[:k].astype(np.int32) for r in new], "data": [r[k:].tobytes() for r in new]})

    kind = pieces.schema["cid"].dataType.simpleString()
    return pieces.select("cid", "p", "vector", "data").groupBy("cid").applyInPandas(turn, f"cid {kind}, p int, vector array<int>, data binary")


def bytes_of(pieces: DataFrame) -> DataFrame:
    """(cid, p, off, b): the bytes of pieces as rows."""
    each = F.transform(F.sequence(F.lit(1), F.octet_length("data")), lambda i: byte_at(F.col("data"), i))
    return pieces.select("cid", "p", F.posexplode(each).alias("off", "b"))


def encode(objects: DataFrame, k: int, pieces: int) -> DataFrame:
    return bytes_of(encode_pieces(objects, k, pieces))


def possession(pieces: DataFrame, claims: DataFrame, seed: str = "c") -> DataFrame:
    """claims(cid, p, proof) -> (cid, p, holds): the proof is the field product of the piece's coding vector with the
    challenge of the content; who has the piece knows its vector, and the challenger has the vectors alone."""
    return claims.join(possession_proofs(pieces, seed).withColumnRenamed("proof", "want"), ["cid", "p"], "left").select("cid", "p", F.coalesce(F.col("proof") == F.col("want"), F.lit(False)).alias("holds"))


def possession_proofs(pieces: DataFrame, seed: str = "c") -> DataFrame:
    r = lambda j: coefficient(F.lit(seed), F.col("cid").cast("string"), j.cast("string"))
    terms = F.transform("vector", lambda v, j: mul(v, r(j)))
    return pieces.select("cid", "p", F.aggregate(terms, F.lit(0), lambda x, y: x.bitwiseXOR(y)).alias("proof"))


def recode(cells: DataFrame, new: DataFrame) -> DataFrame:
    """Coded cells(cid, p, off, b) combined by new(cid, q, p, c) -> (cid, p, off, b) of the new pieces."""
    return combine(cells.withColumnRenamed("p", "j"), new.withColumnRenamed("p", "j").withColumnRenamed("q", "p"))


def recoded_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors(cid, p, j, c) of recoded pieces in terms of the original ones."""
    met = new.withColumnRenamed("c", "s").join(old, ["cid", "p"])
    return met.groupBy("cid", F.col("q").alias("p"), "j").agg(F.bit_xor(mul(F.col("s"), F.col("c"))).cast("int").alias("c"))


def piece_ids(pieces: DataFrame) -> DataFrame:
    """Pieces with piece_id: digest of vector and data."""
    vector = F.array_join(F.transform("vector", lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")
    return pieces.withColumn("piece_id", F.sha2(F.concat(F.unhex(vector), F.col("data")), 256))


def piece_index(pieces: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(cid, p, piece_id): the index of pieces by content; new rows replace those of the same content and p."""
    new = piece_ids(pieces).select("cid", "p", "piece_id")
    return new if index is None else index.join(new, ["cid", "p"], "left_anti").unionByName(new)


def eliminate(vectors_: np.ndarray, data: np.ndarray) -> tuple[int, np.ndarray | None, np.ndarray]:
    """(rank, decoded rows or None, innovative flags), taking rows in order until the rank is full."""
    k = vectors_.shape[1]
    table, (exp, log) = products(), tables()
    rows: dict[int, np.ndarray] = {}
    useful = np.zeros(len(vectors_), dtype=bool)
    for n, row in enumerate(np.concatenate([vectors_, data], axis=1).astype(np.uint8)):
        row = row.copy()
        for col, basis in rows.items():
            if row[col]:
                row ^= table[row[col], basis]
        pivot = np.flatnonzero(row[:k])
        if not len(pivot):
            continue
        col = int(pivot[0])
        row = table[int(exp[255 - log[row[col]]]), row]
        for other, basis in rows.items():
            if basis[col]:
                rows[other] = basis ^ table[basis[col], row]
        rows[col] = row
        useful[n] = True
        if len(rows) == k:
            break
    return len(rows), np.stack([rows[c][k:] for c in range(k)]) if len(rows) == k else None, useful


def decode(pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """pieces(cid, p, vector, data) and sizes(cid, size) -> (cid, rank, data): data without padding, null
    below full rank. One content's pieces are one group, k + 1 rows of a piece's size in memory.
    Pieces whose vector or data hasn't the size of most of the content's are malformed and skipped.
    """

    def turn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("p")
        shape = list(zip(group["vector"].map(len), group["data"].map(len), strict=True))
        fine = group[[x == Counter(shape).most_common(1)[0][0] for x in shape]]
        data = [np.frombuffer(d, dtype=np.uint8) for d in fine["data"]]
        rank, out, _ = eliminate(np.stack(fine["vector"].to_numpy()), np.stack(data))
        data = out.astype(np.uint8).tobytes()[: int(group["size"].iloc[0])] if out is not None else None
        return pd.DataFrame({"cid": [group["cid"].iloc[0]], "rank": [rank], "data": [data]})

    joined = pieces.join(sizes.select("cid", "size"), "cid")
    kind = joined.schema["cid"].dataType.simpleString()
    return joined.groupBy("cid").applyInPandas(turn, f"cid {kind}, rank int, data binary")


def keystream(contents: DataFrame, length: int | Column, seed: str = "m") -> DataFrame:
    """(cid, t, off, r): `length` pseudo-random bytes, a number or each content's own, for each of the TAG_BYTES tag bytes."""
    last = (length if isinstance(length, Column) else F.lit(length)) - 1
    grid = contents.select("cid", F.explode(F.sequence(F.lit(0), F.lit(TAG_BYTES - 1))).alias("t"), last.alias("last")).withColumn("off", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("cid").cast("string"), F.col("t").cast("string"), F.col("off").cast("string")))
    return grid.withColumn("r", F.conv(F.substring(h, 1, 2), 16, 10).cast("int"))


def tags(cells: DataFrame, stream: DataFrame) -> DataFrame:
    """cells(cid, p, off, b) -> (cid, p, t, tag): inner products with the content's stream; linear in cells."""
    return cells.join(stream, ["cid", "off"]).groupBy("cid", "p", "t").agg(F.bit_xor(mul(F.col("r"), F.col("b"))).cast("int").alias("tag"))


def combine_tags(tags_: DataFrame, new: DataFrame) -> DataFrame:
    """Tags of pieces combined by new(cid, q, p, c): what the combination's own tag is."""
    met = tags_.join(new, ["cid", "p"])
    return met.groupBy("cid", F.col("q").alias("p"), "t").agg(F.bit_xor(mul(F.col("c"), F.col("tag"))).cast("int").alias("tag"))


def verify_tags(cells: DataFrame, stream: DataFrame, claimed: DataFrame) -> DataFrame:
    """claimed(cid, p, t, tag) -> (cid, p, valid): every tag byte of the piece, computed anew, is the claimed one."""
    own = tags(cells, stream).withColumnRenamed("tag", "want")
    both = own.join(claimed, ["cid", "p", "t"], "full")
    return both.groupBy("cid", "p").agg(F.min((F.col("tag").eqNullSafe(F.col("want"))).cast("int")).alias("v")).select("cid", "p", (F.col("v") == 1).alias("valid"))


def identity_pieces(objects: DataFrame) -> DataFrame:
    """The piece that is the object itself: vector [1]; none for an absent object."""
    return objects.filter(F.col("data").isNotNull()).select("cid", F.array(F.lit(1)).alias("vector"), "data")


def run_agent(rows: DataFrame, function, schema: str) -> DataFrame:
    """A user's function over batches of rows (pandas in, pandas out); its errors fail the query.

    A None is a missing entry and fails before anything runs.
    """
    if not callable(function):
        raise ValueError("missing entry: no function to run")

    def turn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield function(part)

    return rows.mapInPandas(turn, schema)
