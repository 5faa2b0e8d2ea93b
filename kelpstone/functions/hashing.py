"""Hashes as column expressions: FNV-1a of 32 and 64 bits, CRC-32, shards.

ANSI arithmetic doesn't wrap, so a 64-bit state is carried as two halves of 32
bits; products then stay below 2**63.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public FNV-1a definition.
FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619
FNV64_OFFSET, FNV64_PRIME = 14695981039346656037, 1099511628211
_M = 0xFFFFFFFF


def byte_values(data: Column) -> Column:
    """The bytes of a binary or string column as an array of 0 to 255."""
    chars = F.split(F.decode(data.cast("binary"), "ISO-8859-1"), "")
    return F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def fnv1a32(data: Column, seed: int = 0) -> Column:
    """FNV-1a of 32 bits, the seed xor-ed into the offset, as a bigint."""
    return F.aggregate(byte_values(data), F.lit(FNV32_OFFSET ^ seed).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV32_PRIME).bitwiseAND(F.lit(_M).cast("long")))


def fnv1a64_halves(data: Column) -> Column:
    """FNV-1a of 64 bits as struct(hi, lo)."""
    mask = F.lit(_M).cast("long")
    low_prime, shift = FNV64_PRIME & _M, (FNV64_PRIME >> 32).bit_length() - 1  # the prime is 2**40 + 0x1B3

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        product = lo * low_prime
        hi = (F.shiftright(product, 32) + h["hi"] * low_prime + F.shiftleft(lo, shift)).bitwiseAND(mask)
        return F.struct(hi.alias("hi"), product.bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(FNV64_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV64_OFFSET & _M).cast("long").alias("lo"))
    return F.aggregate(byte_values(data), start, step)


def fnv1a64_hex(data: Column) -> Column:
    return F.transform(F.array(fnv1a64_halves(data)), lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0"))))[0]


def shard(data: Column, shards: int) -> Column:
    """FNV-1a of 64 bits modulo the number of shards."""
    return F.transform(F.array(fnv1a64_halves(data)), lambda h: ((h["hi"] % shards) * ((1 << 32) % shards) + h["lo"] % shards) % shards)[0].cast("int")


def crc32(data: Column) -> Column:
    return F.crc32(data.cast("binary"))
