"""Hash functions and congruential generators as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset basis and prime of 32-bit FNV-1a; multiplier and increment of the 32-bit congruential generator.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
LCG_MULTIPLIER, LCG_INCREMENT = 1664525, 1013904223
MASK = 4294967295


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points (over UTF-16 units it would differ outside the basic plane)."""
    codes = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(codes, F.lit(FNV_BASIS).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME).bitwiseAND(F.lit(MASK).cast("long")))


def fnv1a_of(text: str) -> int:
    """The same of a text at hand, for tokens that are hashed once."""
    h = FNV_BASIS
    for c in text:
        h = (h ^ ord(c)) * FNV_PRIME & MASK
    return h


def lcg(x: Column) -> Column:
    """The generator's next state, 0 to 2 ** 32 - 1."""
    return (x * LCG_MULTIPLIER + LCG_INCREMENT).bitwiseAND(F.lit(MASK).cast("long"))


def md5_bits(text: Column) -> Column:
    """60 bits of MD5, a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def gram_hash(seed: int, exact: bool) -> Callable[[str], int]:
    """For tasks: BLAKE2b of 8 bytes, little-endian and unsigned (there is no such builtin), or else the 60 bits of ``md5_bits``, of seed and gram."""
    if exact:
        return lambda gram: int.from_bytes(hashlib.blake2b(f"{seed}:{gram}".encode(), digest_size=8).digest(), "little")
    return lambda gram: int(hashlib.md5(f"{seed}:{gram}".encode()).hexdigest()[:15], 16)


def short_digest(text: Column) -> Column:
    """First 12 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def canonical_digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def draw(seed: int, *key: Column) -> Column:
    """A reproducible order: MD5 of seed and key as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))


def uniform(seed: int, *key: Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.conv(F.substring(draw(seed, *key), 1, 13), 16, 10).cast("double") / float(16**13)
