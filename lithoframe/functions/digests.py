"""Scalar functions of the data model, all built-in column expressions.

Content ids are SHA-256 digests in lower-case hex (Spark has no BLAKE3); hex order is byte order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The data model's constants.
REPLAY_WINDOW_MS, MAX_SKEW_MS = 30_000, 500
DEFAULT_K, MAX_BACKOFF_EXPONENT, QUARANTINE_AFTER = 32, 6, 10


def cid(data: Column) -> Column:
    return F.sha2(data, 256)


def verify(data: Column, expected: Column) -> Column:
    return cid(data) == expected


def parse_cid(text: Column) -> Column:
    """64 hex digits -> 32 bytes; anything else is null."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def shard(content: Column) -> Column:
    """One of 256 partitions: the first byte in hex."""
    return F.substring(content, 1, 2)


def le32(n: Column) -> Column:
    """An unsigned 32-bit number as 8 hex digits, little-endian."""
    big = F.lpad(F.lower(F.hex(n.cast("long"))), 8, "0")
    return F.concat(F.substring(big, 7, 2), F.substring(big, 5, 2), F.substring(big, 3, 2), F.substring(big, 1, 2))


def redundancy(k: Column) -> Column:
    return 2.0 + 16.0 / k


def encoder_pieces(k: Column) -> Column:
    """Pieces an encoder makes: ceil(k * redundancy) = 2k + 16."""
    return F.ceil(k * redundancy(k)).cast("long")


def target_pieces(k: Column) -> Column:
    """Pieces the health scan wants: k * ceil(redundancy), k at least 1."""
    k = F.greatest(k, F.lit(1))
    return (k * F.ceil(redundancy(k))).cast("long")


def severity(available: Column, k: Column) -> Column:
    return F.when(available < k, "critical").when(available < target_pieces(k), "normal").otherwise("healthy")


def deficit(available: Column, k: Column) -> Column:
    """Missing pieces: up to k when critical, up to the target when normal; never negative."""
    want = F.when(available < k, k.cast("long")).otherwise(target_pieces(k))
    return F.greatest(want - available, F.lit(0).cast("long"))


def hlc_pack(ms: Column, logical: Column) -> Column:
    return F.shiftleft(ms.cast("long"), 16).bitwiseOR(logical.cast("long"))


def hlc_wall(ts: Column) -> Column:
    return F.shiftright(ts, 16)


def hlc_logical(ts: Column) -> Column:
    return ts.bitwiseAND(F.lit(65_535))


def hlc_class(remote_ms: Column, local_ms: Column) -> Column:
    """skew: too far ahead; replay: too far off; else ok."""
    return F.when(remote_ms > local_ms + MAX_SKEW_MS, "skew").when(F.abs(remote_ms - local_ms) > REPLAY_WINDOW_MS, "replay").otherwise("ok")


def hlc_rejected(remote: Column, local_ms: Column) -> Column:
    """Why a message with this stamp is dropped, or null; a stamp of 0 (a sender without a clock) passes."""
    found = hlc_class(hlc_wall(remote), local_ms)
    return F.when((remote != 0) & (found != "ok"), found)


def backoff_seconds(failures: Column) -> Column:
    return F.pow(F.lit(2), F.least(failures, F.lit(MAX_BACKOFF_EXPONENT))).cast("long")


def piggyback_count(members: Column) -> Column:
    """4 up to 16 members, else ceil(log2(n)), exactly: the bits of n - 1."""
    return F.when(members <= 16, 4).otherwise(F.length(F.bin(members.cast("long") - 1))).cast("long")


def fanout(members: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.ln(members.cast("double")))).cast("long")


def signed_payload(writer: Column, sql: Column, root: Column) -> Column:
    """Length-prefixed fields and an option tag for the root, in hex: what a writer signs."""
    part = lambda c: F.concat(le32(F.octet_length(c)), F.lower(F.hex(c)))
    return F.concat(part(writer), part(sql), F.when(root.isNull(), "00").otherwise(F.concat(F.lit("01"), F.coalesce(root, F.lit("")))))


def keyed_digest(secret: Column, payload: Column) -> Column:
    """Stands in for a signature (no signature library here): only who has the secret can make it."""
    return F.sha2(F.concat(secret, payload), 256)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
