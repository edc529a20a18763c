"""Leveled compaction: the picker over file metadata, and the merge of a job's inputs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.records import level_capacity, record_size
from tideline.operators.resolve import DRAWN, MAX_RANGES, SET, latest
from tideline.options import Options


@dataclass(frozen=True)
class FileMeta:
    id: int
    level: int
    smallest: str
    largest: str
    size: int
    records: int = 0
    path: str = ""


@dataclass(frozen=True)
class Plan:
    level: int
    inputs: tuple[int, ...]
    overlaps: tuple[int, ...]
    drop_tombstones: bool


def by_bytes(key: str) -> bytes:
    """Keys compare by UTF-8 bytes, as they do in Spark."""
    return key.encode()


def union_range(files: list[FileMeta]) -> tuple[str, str]:
    return min((f.smallest for f in files), key=by_bytes), max((f.largest for f in files), key=by_bytes)


def overlapping(files: list[FileMeta], level: int, smallest: str, largest: str) -> list[FileMeta]:
    return [f for f in files if f.level == level and by_bytes(f.smallest) <= by_bytes(largest) and by_bytes(smallest) <= by_bytes(f.largest)]


def pick_compaction(files: list[FileMeta], options: Options) -> Plan | None:
    """Level 0 by its number of files first, then the first level over its capacity.

    Tombstones are dropped only if no file lies below the output level.
    """
    if not files:
        return None
    deepest = max(f.level for f in files)

    def plan(level: int, inputs: list[FileMeta]) -> Plan:
        below = overlapping(files, level + 1, *union_range(inputs))
        newest_first = lambda fs: tuple(sorted((f.id for f in fs), reverse=True))
        return Plan(level, newest_first(inputs), newest_first(below), deepest <= level + 1)

    fresh = [f for f in files if f.level == 0]
    if len(fresh) >= options.l0_compaction_threshold:
        return plan(0, fresh)
    for level in range(1, deepest + 1):
        own = [f for f in files if f.level == level]
        if own and sum(f.size for f in own) > level_capacity(level, options.target_level_size, options.level_size_multiplier):
            return plan(level, [min(own, key=lambda f: f.id)])
    return None


def widened(plan: Plan, files: list[FileMeta], options: Options) -> tuple[list[FileMeta], int, bool]:
    """One job for a plan and those that would follow it: its inputs, output level, and whether tombstones go.

    Of a level over its capacity as many of the oldest files go as bring it back. If the output
    level would come to hold more than twice its capacity, the picker would move most of it on
    file by file; all of it goes down at once instead.
    """
    own = sorted((f for f in files if f.level == plan.level), key=lambda f: f.id)
    if plan.level == 0:
        inputs = own
    else:
        inputs, excess = [], sum(f.size for f in own) - level_capacity(plan.level, options.target_level_size, options.level_size_multiplier)
        while excess > sum(f.size for f in inputs):
            inputs.append(own[len(inputs)])
    output = plan.level + 1
    while True:
        there = [f for f in files if f.level == output]
        if sum(f.size for f in inputs + there) <= 2 * level_capacity(output, options.target_level_size, options.level_size_multiplier):
            return inputs + overlapping(files, output, *union_range(inputs)), output, max(f.level for f in files) <= output
        inputs, output = inputs + there, output + 1


def merge_runs(log: DataFrame, drop_tombstones: bool) -> DataFrame:
    """The newest record of each key of a job's inputs."""
    merged = latest(log)
    return merged.where(F.col("op") == SET) if drop_tombstones else merged


def ordered_files(log: DataFrame, n_parts: int) -> DataFrame:
    """Rows in n disjoint key ranges, each sorted: a written part is a file of a level, or several in order."""
    return log.repartitionByRange(n_parts, "key").sortWithinPartitions("key") if n_parts > 1 else log.coalesce(1).sortWithinPartitions("key")


def file_metadata(log: DataFrame, run: str = "run") -> DataFrame:
    """(run, lo, hi, n, bytes) of each run of a changelog's newest records."""
    return log.groupBy(run).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"), F.sum(record_size(F.col("key"), F.col("value"))).alias("bytes"))


def key_ranges(log: DataFrame, run: str = "run") -> DataFrame:
    """(run, lo, hi) of each run of a changelog. A key's older records do not widen a run, so they may stay."""
    return log.groupBy(run).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))


#: A block of ranges holds 2^height of them, aligned; this is the greatest height.
TOP = 5


def blocks_over(place: Column) -> Column:
    """The block of each height that holds a range."""
    return F.array(*[F.shiftright(place, h) + h * 2 * MAX_RANGES for h in range(TOP + 1)])


def blocks_within(first: Column, last: Column) -> Column:
    """The fewest blocks that hold the ranges from first to last, each in exactly one."""
    edges = []
    for h in range(TOP):
        low, high = F.shiftright(first + (2**h - 1), h), F.shiftright(last + 1, h)
        edges.append(F.when((low < high) & (low % 2 == 1), low + h * 2 * MAX_RANGES))
        edges.append(F.when((low < high) & (high % 2 == 1), high - 1 + h * 2 * MAX_RANGES))
    low, high = F.shiftright(first + (2**TOP - 1), TOP), F.shiftright(last + 1, TOP)
    whole = F.when(low < high, F.sequence(low + TOP * 2 * MAX_RANGES, high - 1 + TOP * 2 * MAX_RANGES)).otherwise(F.array().cast("array<int>"))
    return F.array_compact(F.concat(F.array(*edges), whole))


def json_array(values: list, kind: str) -> Column:
    """A constant array, sent to the session as one text."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def count_true(holds: Callable[[Column], Column]) -> Column:
    """How many of the first MAX_RANGES - 1 places hold; those that do come first. By bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((MAX_RANGES - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(holds(n + step - 1), n + step).otherwise(n))


def overlapping_runs(meta: DataFrame) -> DataFrame:
    """(a, b): pairs of runs whose closed key intervals overlap; meta holds one row per file.

    Of such a pair, the run that is later by (lo, run) begins inside the other. That order is cut
    into ranges of about equally many runs, even where many begin with one key. A run that begins
    is put into the blocks that hold its range, at most TOP + 1; an interval into the blocks that
    make it up. They meet in exactly one block, so beside the pairs themselves only runs that
    begin in one range are compared in vain.
    """
    meta = meta.select("run", "lo", "hi").where("run IS NOT NULL AND lo IS NOT NULL")
    drawn = sorted((r["lo"].encode(), r["run"]) for r in meta.select("lo", "run").orderBy(F.xxhash64("run"), "run").limit(DRAWN).collect())
    bounds = sorted({drawn[k * len(drawn) // MAX_RANGES] for k in range(1, MAX_RANGES)} if drawn else ())
    lows, kind = json_array([lo.decode() for lo, _ in bounds], "string"), meta.schema["run"].dataType.simpleString()
    numbers = json_array([run for _, run in bounds], kind)

    def begun(at: Column) -> Column:
        low = F.get(lows, at)
        return (low < F.col("lo")) | ((low == F.col("lo")) & (F.get(numbers, at) <= F.col("run")))

    meta = meta.withColumn("first", count_true(begun)).withColumn("last", count_true(lambda at: F.get(lows, at) <= F.greatest("lo", "hi")))
    n = int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    later = meta.select("run", "lo", "hi", F.explode(blocks_over(F.col("first"))).alias("block")).repartition(n, "block").alias("x")
    early = meta.select("run", "lo", "hi", F.explode(blocks_within(F.col("first"), F.col("last"))).alias("block")).repartition(n, "block").alias("y")
    after = (F.col("x.lo") > F.col("y.lo")) | ((F.col("x.lo") == F.col("y.lo")) & (F.col("x.run") > F.col("y.run")))
    meets = (F.col("x.block") == F.col("y.block")) & after & (F.col("x.run") != F.col("y.run")) & (F.col("x.lo") <= F.col("y.hi")) & (F.col("y.lo") <= F.col("x.hi"))
    return later.join(early, meets).select(F.least("x.run", "y.run").alias("a"), F.greatest("x.run", "y.run").alias("b"))
