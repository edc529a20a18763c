"""Deterministic fault injection at the commit boundaries of a store."""

from __future__ import annotations

import os
from dataclasses import dataclass
from enum import Enum

from tideline.errors import InjectedFault


class FaultPoint(Enum):
    BEFORE_LOG_APPEND = "before_wal_append"
    AFTER_LOG_APPEND = "after_wal_append"
    AFTER_LOG_FSYNC = "after_wal_fsync"
    AFTER_MEMTABLE_UPDATE = "after_memtable_update"
    BEFORE_FILE_CREATION = "before_sstable_creation"
    AFTER_FILE_WRITE = "after_sstable_write"
    BEFORE_ATOMIC_RENAME = "before_atomic_rename"
    AFTER_ATOMIC_RENAME = "after_atomic_rename"
    BEFORE_METADATA_UPDATE = "before_metadata_update"
    AFTER_METADATA_UPDATE = "after_metadata_update"
    BEFORE_OBSOLETE_FILE_DELETE = "before_obsolete_file_delete"
    AFTER_OBSOLETE_FILE_DELETE = "after_obsolete_file_delete"
    BEFORE_LOG_TRUNCATION = "before_wal_truncation"
    AFTER_LOG_TRUNCATION = "after_wal_truncation"
    AFTER_COMPACTION_OUTPUT_CREATION = "after_compaction_output_creation"

    @classmethod
    def parse(cls, name: str) -> FaultPoint | None:
        return next((p for p in cls if p.value == name), None)


class FaultMode(Enum):
    ERROR = "error"
    ABORT = "abort"


@dataclass(frozen=True)
class Fault:
    """Fires on hit `at` of a point and on every later one."""

    point: FaultPoint
    at: int = 1
    mode: FaultMode = FaultMode.ERROR


class FaultInjector:
    def __init__(self, fault: Fault | None):
        self.fault, self.hits = fault, 0

    def hit(self, point: FaultPoint) -> None:
        if self.fault is None or self.fault.point is not point:
            return
        self.hits += 1
        if self.hits >= max(1, self.fault.at):
            if self.fault.mode is FaultMode.ABORT:
                os.abort()
            raise InjectedFault(f"injected fault: {point.value} at hit {self.hits}")
