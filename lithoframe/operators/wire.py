"""Message frames and classes, as column expressions over hex strings.

A frame of version 1 is type tag (4 bytes), version (1), stamp (8), payload length (4), payload; version 0
has no stamp, which then is 0. Numbers are big-endian.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The messages' names and type tags; those of the membership protocol start with Swim.
TAGS = {
    "Ping": 0x0001, "Pong": 0x0002, "PieceRequest": 0x0010, "PieceResponse": 0x0011, "ProviderAnnounce": 0x0020, "SignedWrite": 0x0030, "HealthReport": 0x0040,
    "SwimJoin": 0x0100, "SwimAlive": 0x0101, "SwimSuspect": 0x0102, "SwimDead": 0x0103, "SwimPing": 0x0104, "SwimPingAck": 0x0105, "RpcRequest": 0x0200, "RpcResponse": 0x0201,
}
V0_HEADER, V1_HEADER = 9, 17


def tag_of(name: Column) -> Column:
    """Type tag of a message's name; null if there is no such message."""
    return F.element_at(F.create_map(*[F.lit(x) for item in TAGS.items() for x in item]), name)


def name_of(tag: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for name, n in TAGS.items() for x in (n, name)]), tag)


def is_membership(name: Column) -> Column:
    return F.startswith(name, F.lit("Swim"))


def be(n: Column, size: int) -> Column:
    """A number as hex of `size` bytes, big-endian."""
    return F.lpad(F.lower(F.hex(n.cast("long"))), 2 * size, "0")


def frame(tag: Column, stamp: Column, payload: Column, version: int = 1) -> Column:
    """Hex of a frame around a payload in hex."""
    head = F.concat(be(tag, 4), F.lit(f"{version:02x}"))
    return F.concat(head, be(stamp, 8), be(F.length(payload) / 2, 4), payload) if version else F.concat(head, be(F.length(payload) / 2, 4), payload)


def parse(data: Column) -> Column:
    """Hex of a frame -> (error, tag, stamp, payload); error is null, short, truncated or version. More bytes than the length says are ignored."""
    number = lambda at, size: F.conv(F.substring(data, 2 * at + 1, 2 * size), 16, 10).cast("long")
    have, version = F.length(data) / 2, number(4, 1)
    size = F.when(version == 0, number(5, 4)).otherwise(number(13, 4))
    head = F.when(version == 0, V0_HEADER).otherwise(V1_HEADER)
    error = F.when(have < V0_HEADER, "short").when(version > 1, "version").when(have < head, "short").when(have < head + size, "truncated")
    fine = error.isNull()
    return F.struct(
        error.alias("error"),
        F.when(fine, number(0, 4)).alias("tag"),
        F.when(fine, F.when(version == 0, F.lit(0).cast("long")).otherwise(number(5, 8))).alias("stamp"),
        F.when(fine, F.substr(data, (2 * head + 1).cast("int"), (2 * size).cast("int"))).alias("payload"),
    )
