"""GF(2^8) with polynomial 0x11B and generator 3, as column expressions and numpy tables.

The tables follow from the rule exp(i + 1) = 3 * exp(i); expressions look them up in literal arrays.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

POLYNOMIAL, GENERATOR = 0x11B, 3


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """exp over 0..509 (so that sums of two logs need no modulo) and log over 0..255 (log 0 is unused)."""
    exp, log, x = np.zeros(510, dtype=np.int64), np.zeros(256, dtype=np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        doubled = (x << 1) ^ (POLYNOMIAL if x & 0x80 else 0)
        x = doubled ^ x
    return exp, log


@cache
def products() -> np.ndarray:
    """256 x 256 multiplication table."""
    exp, log = tables()
    out = exp[log[:, None] + log[None, :]].astype(np.uint8)
    out[0, :] = out[:, 0] = 0
    return out


def _literal(values: np.ndarray) -> Column:
    return F.expr("array(" + ",".join(map(str, values.tolist())) + ")")


def mul(a: Column, b: Column) -> Column:
    exp, log = tables()
    at = lambda t, k: F.element_at(_literal(t), (k + 1).cast("int"))
    return F.when((a == 0) | (b == 0), 0).otherwise(at(exp, at(log, a) + at(log, b)))


def inverse(a: Column) -> Column:
    """Null for 0."""
    exp, log = tables()
    at = lambda t, k: F.element_at(_literal(t), (k + 1).cast("int"))
    return F.when(a != 0, at(exp, 255 - at(log, a)))


def divide(a: Column, b: Column) -> Column:
    """Null when b is 0."""
    return F.when(b != 0, mul(a, inverse(b)))


def byte_at(data: Column, position: Column) -> Column:
    """Byte of a binary column at a 1-based position, 0..255; 0 beyond its end."""
    found = F.conv(F.hex(F.substring(data, position, 1)), 16, 10).cast("int")
    return F.when(position <= F.octet_length(data), found).otherwise(0)


def mul_add(into: Column, scale: Column, source: Column) -> Column:
    """Arrays of field elements: into XOR scale * source."""
    return F.zip_with(into, source, lambda d, s: d.bitwiseXOR(mul(scale, s)))
