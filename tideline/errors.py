"""Exceptions of the store, its codecs and the cache."""


class StoreError(Exception):
    """Base of all errors raised by the engine."""


class StoreIOError(StoreError, OSError):
    """The directory cannot be used, for instance because another process has it open."""


class LogCorruption(StoreError):
    """A log record fails its checksum or cannot be decoded."""


class LogIncomplete(StoreError):
    """A strict read met a torn tail."""


class BlockFileCorruption(StoreError):
    """A block file fails its checks."""


class InjectedFault(StoreError):
    """Raised by a configured fault point."""


class CacheCorruption(StoreError):
    """A cache entry has no valid expiry."""
