"""A cache with time to live over a store: keys under `cache:`, values `<expiry ms>:<value>`."""

from __future__ import annotations

import re
import threading
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.errors import CacheCorruption
from tideline.functions.records import CACHE_PREFIX, expiry_of, is_expired, value_of
from tideline.operators.resolve import DELETE, live
from tideline.options import Options
from tideline.store import Store

MAX_EXPIRY = 2**64 - 1


@dataclass(frozen=True)
class CacheStats:
    hits: int = 0
    misses: int = 0
    sets: int = 0
    deletes: int = 0
    expired: int = 0
    clears: int = 0


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def decode(raw: str) -> tuple[int, str]:
    head, colon, value = raw.partition(":")
    if not colon:
        raise CacheCorruption(f"no colon after the expiry: {raw!r}")
    if not re.fullmatch(r"\+?[0-9]+", head) or int(head) > MAX_EXPIRY:
        raise CacheCorruption(f"expiry is no 64-bit number: {head!r}")
    return int(head), value


class Cache:
    def __init__(self, store: Store, clock=now_ms):
        self.store, self.clock = store, clock
        self._stats, self._mutex = CacheStats(), threading.Lock()

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None, clock=now_ms) -> Cache:
        return cls(Store.open(spark, path, options), clock)

    def _count(self, **more: int) -> None:
        with self._mutex:
            self._stats = replace(self._stats, **{k: getattr(self._stats, k) + n for k, n in more.items()})

    def set(self, key: str, value: str, ttl_seconds: float = 0) -> None:
        """A ttl of zero never expires. One under a millisecond, or past 64 bits, is refused."""
        if ttl_seconds < 0 or 0 < ttl_seconds < 0.001:
            raise ValueError("a time to live is zero or at least one millisecond")
        expiry = self.clock() + int(ttl_seconds * 1000) if ttl_seconds else 0
        if expiry > MAX_EXPIRY:
            raise ValueError("time to live out of range")
        self.store.set(CACHE_PREFIX + key, f"{expiry}:{value}")
        self._count(sets=1)

    def get(self, key: str) -> str | None:
        """An expired entry is a miss and is deleted, unless it was set anew meanwhile."""
        found = self.store.get_with_seq(CACHE_PREFIX + key)
        if found is None:
            self._count(misses=1)
            return None
        expiry, value = decode(found[0])
        if expiry and expiry <= self.clock():
            self.store.delete_if(CACHE_PREFIX + key, found[1])
            self._count(misses=1, expired=1)
            return None
        self._count(hits=1)
        return value

    def exists(self, key: str) -> bool:
        """Like get: it counts and it expires."""
        return self.get(key) is not None

    def delete(self, key: str) -> bool:
        """Whether a record was there, expired or not."""
        existed = self.store.delete(CACHE_PREFIX + key)
        self._count(deletes=1)
        return existed

    def clear(self) -> None:
        """One batch of tombstones for all keys of the cache."""
        gone = self.store.prefix(CACHE_PREFIX).select("key").cache()
        try:
            n = gone.count()
            if n:
                self.store.write(gone.withColumn("op", F.lit(DELETE)).withColumn("value", F.lit(None).cast("string")))
        finally:
            gone.unpersist()
        self._count(deletes=n, clears=1)

    def entries(self, as_of_ms: int | None = None) -> DataFrame:
        """(key, value, expires_at_ms) of unexpired entries; malformed ones raise."""
        raw = live(self.store.log(CACHE_PREFIX).where(F.col("key").startswith(CACHE_PREFIX)))
        expiry = F.coalesce(expiry_of(F.col("value")), F.raise_error(F.concat(F.lit("cache corruption: "), F.col("value"))).cast("decimal(20,0)"))
        rows = raw.select(F.substring("key", len(CACHE_PREFIX) + 1, 1 << 30).alias("key"), value_of(F.col("value")).alias("value"), expiry.alias("expires_at_ms"))
        return rows.where(~is_expired(F.col("expires_at_ms"), F.lit(self.clock() if as_of_ms is None else as_of_ms)))

    def stats(self) -> CacheStats:
        return self._stats

    def close(self) -> None:
        self.store.close()
