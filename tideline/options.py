"""Tuning of a store. Values out of range are clamped."""

from __future__ import annotations

from dataclasses import dataclass

from tideline.faults import Fault


@dataclass(frozen=True)
class Options:
    """flush_threshold counts distinct keys of the memtable, deletes included."""

    flush_threshold: int = 1024
    l0_compaction_threshold: int = 4
    level_size_multiplier: int = 10
    target_level_size: int = 8 * 1024 * 1024
    target_file_size: int = 2 * 1024 * 1024
    fault: Fault | None = None

    def __post_init__(self):
        for name, least in (("l0_compaction_threshold", 1), ("level_size_multiplier", 2), ("target_level_size", 1), ("target_file_size", 1)):
            object.__setattr__(self, name, max(least, getattr(self, name)))
