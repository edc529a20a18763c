"""Column expressions over records, cache entries and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD_OVERHEAD = 9
CACHE_PREFIX = "cache:"


def record_size(key: Column, value: Column) -> Column:
    """Encoded size of a record: op and two lengths, key bytes, value bytes."""
    return (F.lit(RECORD_OVERHEAD) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def crc32(data: Column) -> Column:
    return F.crc32(data.cast("binary"))


def encode_entry(expires_at_ms: Column, value: Column) -> Column:
    return F.concat(expires_at_ms.cast("string"), F.lit(":"), value)


def expiry_of(raw: Column) -> Column:
    """Expiry of a raw cache entry as DECIMAL(20,0), which holds 64 unsigned bits; NULL if malformed."""
    head = F.substring_index(raw, ":", 1)
    valid = raw.contains(":") & head.rlike("^[+]?[0-9]{1,20}$")
    return F.when(valid, head.try_cast("decimal(20,0)"))


def value_of(raw: Column) -> Column:
    """Everything after the first colon."""
    return F.when(raw.contains(":"), F.substring(raw, F.locate(":", raw) + 1, F.length(raw)))


def is_expired(expires_at_ms: Column, now_ms: Column | int) -> Column:
    """Zero never expires; the boundary itself is expired."""
    return (expires_at_ms != 0) & (expires_at_ms <= now_ms)


def level_capacity(level: int, target: int, multiplier: int) -> int:
    return min(target * multiplier ** max(0, level - 1), 2**64 - 1)
