"""Scalar functions of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal_int(a: Column, b: Column) -> Column:
    return (a == b).cast("int")


def greater_int(a: Column, b: Column) -> Column:
    return (a > b).cast("int")


def largest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def select(flag: Column, a: Column, b: Column) -> Column:
    return F.when(flag, a).otherwise(b)


def almost_equal(a: Column, b: Column, ulps: int = 2) -> Column:
    """Equal up to a few units in the last place."""
    return F.abs(a - b) <= F.lit(2.220446049250313e-16 * ulps) * F.abs(a + b)


def hash32(*parts: Column) -> Column:
    """The first 32 bits of the md5 of the parts, joined by colons: a random number that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def spread32(h: Column, place: int) -> Column:
    """The place-th of many 32-bit random numbers made from one (``hash32``): a counter, twice multiplied and folded, which any engine can repeat."""
    mask = F.lit(0xFFFFFFFF)
    x = (h + F.lit(place * 2654435769 % (1 << 32))).bitwiseAND(mask)
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(73244475)).bitwiseAND(mask)
    return x.bitwiseXOR(F.shiftright(x, 16))


def uniform_int(h: Column, bound: Column) -> Column:
    """A number in [0, bound); 0 where the bound is not positive."""
    return F.when(bound > 0, F.pmod(h, bound)).otherwise(F.lit(0)).cast("long")


def uniform_double(h: Column, bound: Column) -> Column:
    """A number in [0, bound) in steps of 1e-4; 0 where there is no step."""
    steps = F.floor(bound * 10000)
    return F.when(steps >= 1, F.pmod(h, steps) / F.lit(10000.0)).otherwise(F.lit(0.0))


def plogp(p: Column) -> Column:
    """-p ln p, and 0 at 0."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def checksum(data: Column) -> Column:
    """Complement of the sum of a binary's little-endian 16-bit words (an odd last byte counts by itself)."""
    n = F.octet_length(data)
    byte = lambda k: F.coalesce(F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("int"), F.lit(0))
    signed = lambda v: F.when(v >= 32768, v - 65536).otherwise(v)
    words = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), lambda k: F.when(2 * k + 1 < n, signed(byte(2 * k + 1) + 256 * byte(2 * k + 2))).when(2 * k < n, byte(2 * k + 1)).otherwise(F.lit(0)))
    return -F.aggregate(words, F.lit(0), lambda s, x: s + x.cast("int")) - 1


def encrypt(data: Column, key: str, iv: bytes | None = None) -> Column:
    """AES-GCM: iv, cipher text and tag. A random iv unless one is given."""
    return F.aes_encrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(iv)) if iv is not None else F.aes_encrypt(data, F.lit(key), F.lit("GCM"))


def decrypt(data: Column, key: str) -> Column:
    return F.aes_decrypt(data, F.lit(key), F.lit("GCM"))


def bit(flag: Column) -> Column:
    """A condition as 0 or 1; null as 0."""
    return F.coalesce(flag, F.lit(False)).cast("int")


def is_decoy(label: Column) -> Column:
    """Decoys are marked by labels below 0."""
    return label < 0


def mux(flag: Column, new: Column, old: Column) -> Column:
    """new where the flag is set, else old, for masks of conditions."""
    return (flag & new) | (~flag & old)
