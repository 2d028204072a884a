"""Seeded draws: the 64-bit FNV-1a hash as an expression, and uniform and normal values from it.

A step's product wraps at 64 bits, which ANSI arithmetic refuses, so it is put together from 32-bit halves: the prime is
2^40 + 435, whose first term only moves the low half up by eight bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the hash: its offset basis (as a signed long) and the low part of its prime.
BASIS, PRIME_LOW = 14695981039346656037 - (1 << 64), 435
#: Fixed value: the half width of the ambient noise in degrees.
AMBIENT_NOISE = 0.3
_LOW = 0xFFFFFFFF


def fnv_step(state: Column, byte: Column) -> Column:
    """The hash after one more byte (0 to 255)."""
    x = state.bitwiseXOR(byte)
    low, high = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)
    product = low * PRIME_LOW
    upper = (high * PRIME_LOW + F.shiftrightunsigned(product, 32) + low * 256).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(upper, 32).bitwiseOR(product.bitwiseAND(F.lit(_LOW)))


def fnv1a(text: Column, state: Column | None = None) -> Column:
    """The FNV-1a hash of a text's UTF-8 bytes as a long, going on from ``state`` where one is given; null for null."""
    digits = F.hex(text.cast("binary"))
    places = F.filter(F.sequence(F.lit(0), F.octet_length(text)), lambda i: i < F.octet_length(text))
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(F.transform(places, byte), F.lit(BASIS) if state is None else state, fnv_step)


def fnv1a_long(value: Column, state: Column | None = None, size: int = 8) -> Column:
    """The hash of an integer's ``size`` bytes, most significant first."""
    parts = [F.shiftrightunsigned(value, 8 * k).bitwiseAND(F.lit(0xFF)) for k in reversed(range(size))]
    return F.aggregate(F.array(*parts), F.lit(BASIS) if state is None else state, fnv_step)


def uniform(hashed: Column) -> Column:
    """A value in [0, 1) from a hash's upper 53 bits."""
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))


def normal(seed: Column) -> Column:
    """A standard normal value from a hash: two uniform values, the second from the hash of the first, by Box and Muller."""
    u = 1 - uniform(seed)  # never 0
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(fnv1a_long(seed)))


def noise_draw(instance: Column, t_ms: Column, transform: int) -> Column:
    """The normal draw of an overlay's transform at an instant: equal for equal arguments on every machine."""
    return normal(fnv1a_long(F.lit(transform).cast("long"), fnv1a_long(t_ms, fnv1a(instance)), 4))


def ambient_noise(t_ms: Column) -> Column:
    """Degrees within the noise's half width, from the instant alone."""
    return (2 * uniform(fnv1a_long(t_ms)) - 1) * AMBIENT_NOISE
