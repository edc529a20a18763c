"""Bloom filter of keys: sizing and hashing as column expressions, and the packed form.

Double hashing: bit i is (crc32(key) + i * crc32(reversed bytes of key)) mod m.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.01


def num_bits(n: Column, rate: float = RATE) -> Column:
    m = F.ceil(-n.cast("double") * math.log(rate) / F.lit(math.log(2) ** 2))
    return F.greatest(m.cast("long"), F.lit(64).cast("long"))


def num_hashes(m: Column, n: Column) -> Column:
    k = F.round(m.cast("double") / n * F.lit(math.log(2)))
    return F.least(F.greatest(k.cast("long"), F.lit(1).cast("long")), F.lit(30).cast("long"))


def reversed_bytes(key: Column) -> Column:
    """Bytes of a key in reverse order; F.reverse would reverse characters."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(key.cast("binary")), F.lit(".."), F.lit(0))), ""))


def bit_positions(key: Column, m: Column | int, k: Column | int) -> Column:
    """The k bit numbers of a key in a filter of m bits."""
    m, k = (x if isinstance(x, Column) else F.lit(x) for x in (m, k))
    h1, h2 = F.crc32(key.cast("binary")), F.crc32(reversed_bytes(key))
    return F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda i: F.pmod(h1 + i * h2, m))


def build(keys: DataFrame, m: int, k: int) -> DataFrame:
    """(word, bits): the set 64-bit words of the filter, partially aggregated per task."""
    bits = keys.select(F.explode(bit_positions(F.col("key"), m, k)).alias("bit"))
    return bits.groupBy((F.floor(F.col("bit") / 64)).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits"))


def might_contain(probes: DataFrame, words: DataFrame, m: int, k: int) -> DataFrame:
    """(key, maybe) per distinct probe: whether all its bits are set."""
    each = probes.select("key").distinct().select("key", F.explode(bit_positions(F.col("key"), m, k)).alias("bit"))
    each = each.withColumn("word", F.floor(F.col("bit") / 64).cast("long"))
    hit = F.coalesce(F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))) != 0, F.lit(False))
    return each.join(words, "word", "left").groupBy("key").agg(F.bool_and(hit).alias("maybe"))


class BloomFilter:
    """The packed form, for block files."""

    def __init__(self, expected: int, rate: float = RATE):
        expected = max(1, expected)
        self.m = max(64, math.ceil(-expected * math.log(rate) / math.log(2) ** 2))
        self.k = min(30, max(1, math.floor(self.m / expected * math.log(2) + 0.5)))
        self.words = [0] * -(-self.m // 64)

    @classmethod
    def from_entries(cls, keys: Iterable[str], rate: float = RATE) -> BloomFilter:
        """A filter of the size that the keys need, holding them."""
        held = list(keys)
        out = cls(len(held), rate)
        for key in held:
            out.insert(key)
        return out

    def _positions(self, key: str):
        data = key.encode()
        h1, h2 = zlib.crc32(data), zlib.crc32(data[::-1])
        return ((h1 + i * h2) % self.m for i in range(self.k))

    def insert(self, key: str) -> None:
        for bit in self._positions(key):
            self.words[bit >> 6] |= 1 << (bit & 63)

    def might_contain(self, key: str) -> bool:
        return all(self.words[bit >> 6] >> (bit & 63) & 1 for bit in self._positions(key))

    def encode(self) -> bytes:
        return struct.pack(f"<II{len(self.words)}Q", self.m, self.k, *self.words)

    @classmethod
    def decode(cls, data: bytes) -> BloomFilter | None:
        if len(data) < 8:
            return None
        out = cls.__new__(cls)
        out.m, out.k = struct.unpack_from("<II", data)
        n = -(-out.m // 64)
        if len(data) < 8 + 8 * n:
            return None
        out.words = list(struct.unpack_from(f"<{n}Q", data, 8))
        return out
