"""Resolution of a changelog to the newest record per key.

LOG(key STRING, seq BIGINT, op TINYINT, value STRING, ts_ms BIGINT), with op 1 = set and
2 = delete, and seq unique. LATEST is the newest row per key, LIVE is LATEST where op = 1.

Two forms are used on purpose. Pairs use row_number() = 1, which Catalyst turns into a
partial and a final WindowGroupLimit, so only one row per key and map task is shuffled.
Keys, existence and counts use max_by(op, seq), a hash aggregate that never reads `value`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SET, DELETE = 1, 2


def latest(log: DataFrame) -> DataFrame:
    """The newest record of each key, tombstones included."""
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return log.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def live(log: DataFrame) -> DataFrame:
    """Visible pairs. The tombstone filter stays above the resolution."""
    return latest(log).where(F.col("op") == SET)


def latest_ops(log: DataFrame) -> DataFrame:
    """(key, op) of the newest record, without touching `value`."""
    return log.groupBy("key").agg(F.max_by("op", "seq").alias("op"))


def live_keys(log: DataFrame) -> DataFrame:
    return latest_ops(log).where(F.col("op") == SET).select("key")


def tombstones(log: DataFrame) -> DataFrame:
    """Keys whose newest record is a delete."""
    return latest_ops(log).where(F.col("op") == DELETE).select("key")


def within(column: Column, start: str | None = None, end: str | None = None, *, start_inclusive: bool = True, end_inclusive: bool = False) -> Column:
    """Bound predicate on a key. None is unbounded; start > end selects nothing."""
    out = F.lit(True)
    if start is not None:
        out = out & (column >= start if start_inclusive else column > start)
    if end is not None:
        out = out & (column <= end if end_inclusive else column < end)
    return out


def scan(log: DataFrame) -> DataFrame:
    """All live pairs, ascending by key bytes."""
    return live(log).select("key", "value").orderBy("key")


def keys(log: DataFrame) -> DataFrame:
    return live_keys(log).orderBy("key")


def get(log: DataFrame, key: str) -> DataFrame:
    """Zero or one (key, value) row. The key filter is pushed below the resolution."""
    return live(log.where(F.col("key") == key)).select("key", "value")


def multi_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, value) per distinct probe, value NULL if absent.

    The log is semi-joined first, so only probed keys are resolved.
    """
    wanted = probes.select("key").distinct()
    hits = live(log.join(wanted, "key", "left_semi")).select("key", "value")
    return wanted.join(hits, "key", "left")


def exists(log: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, present) per distinct probe."""
    wanted = probes.select("key").distinct()
    hits = live_keys(log.join(wanted, "key", "left_semi")).withColumn("hit", F.lit(True))
    return wanted.join(hits, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("present"))


def range_scan(log: DataFrame, start: str | None = None, end: str | None = None, **bounds: bool) -> DataFrame:
    """Live pairs within the bounds, ascending."""
    return scan(log.where(within(F.col("key"), start, end, **bounds)))


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    return scan(log.where(F.col("key").startswith(prefix)))


def seek(log: DataFrame, target: str, start: str | None = None, end: str | None = None, **bounds: bool) -> DataFrame:
    """The first live pair at or after target, inside both bounds."""
    inside = within(F.col("key"), start, end, **bounds) & (F.col("key") >= target)
    return live(log.where(inside)).select("key", "value").orderBy("key").limit(1)


#: Keys drawn by their hash, from whose order range bounds are taken; and the most ranges there are.
DRAWN, MAX_RANGES = 4096, 1024


def range_bounds(values: DataFrame, ranges: int) -> list[str]:
    """Sorted values that cut the one string column of `values` into about equal ranges.

    A function of the values alone, so that ranges are the same wherever they are computed.
    """
    name = values.columns[0]
    drawn = sorted((r[0] for r in values.orderBy(F.xxhash64(name), name).limit(DRAWN).collect()), key=str.encode)
    return sorted({drawn[k * len(drawn) // ranges] for k in range(1, ranges)} if drawn else (), key=str.encode)


def range_number(value: Column, bounds: list[str]) -> Column:
    """How many bounds are at most value."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= value)) if bounds else F.lit(0)


def seek_many(log: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, key): the next live key of each target, NULL when there is none.

    Targets and keys are merged in ranges of about equal numbers of keys. Within a range the next
    key is a running value in descending order, so the time is linear; beyond its last key it is
    the first key of the next range that has one, a list as short as the ranges.
    """
    n = min(MAX_RANGES, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stored = live_keys(log).select(F.col("key").alias("at"), F.lit(1).alias("is_key"))
    bounds = range_bounds(stored.select("at"), n)
    part = range_number(F.col("at"), bounds).alias("part")
    heads = {r["part"]: r["head"] for r in stored.groupBy(part).agg(F.min("at").alias("head")).collect()}
    later, following = None, []
    for k in range(len(bounds), -1, -1):
        following.insert(0, later)
        later = heads.get(k, later)
    probes = targets.select(F.col("target").alias("at")).distinct().withColumn("is_key", F.lit(0))
    descending = Window.partitionBy("part").orderBy(F.col("at").desc(), F.col("is_key").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.last(F.when(F.col("is_key") == 1, F.col("at")), ignorenulls=True).over(descending)
    rows = probes.unionByName(stored).select("at", "is_key", part).withColumn("here", here).where("is_key = 0")
    after = F.get(F.array(*[F.lit(x).cast("string") for x in following]), F.col("part"))
    return rows.select(F.col("at").alias("target"), F.coalesce("here", after).alias("key"))


def snapshot(log: DataFrame, seq: int) -> DataFrame:
    """Live pairs as of a sequence number."""
    return scan(log.where(F.col("seq") <= seq))


#: Sequence numbers of a stretch: what one group of delete_existed holds of a key at most.
STRETCH = 1 << 20


def delete_existed(log: DataFrame) -> DataFrame:
    """Per delete record, whether the key was live just before it.

    A key's history is cut into stretches of seq, each its own group, so that a key with most of
    the log is spread. The first record of a stretch follows the last one of the key's stretch
    before; those are one row for each stretch.
    """
    cut = log.select("key", "seq", "op", F.floor(F.col("seq") / STRETCH).alias("stretch"))
    within_stretch = Window.partitionBy("key", "stretch").orderBy("seq")
    rows = cut.withColumn("before", F.lag("op").over(within_stretch)).where(F.col("op") == DELETE)
    ends = cut.groupBy("key", "stretch").agg(F.max_by("op", "seq").alias("end"))
    ends = ends.select("key", "stretch", F.lag("end").over(Window.partitionBy("key").orderBy("stretch")).alias("end"))
    first = rows.where("before IS NULL").drop("before").join(ends, ["key", "stretch"]).withColumnRenamed("end", "before")
    every = rows.where("before IS NOT NULL").select("key", "seq", "before").unionByName(first.select("key", "seq", "before"))
    return every.select("key", "seq", F.coalesce(F.col("before") == SET, F.lit(False)).alias("existed"))


def merge_sources(sources: list[DataFrame], keep_tombstones: bool = False) -> DataFrame:
    """k-way merge of changelogs; index 0 is the newest source and wins ties of a key.

    With keep_tombstones the delete records stay, as compaction above the last level needs.
    """
    if not sources:
        raise ValueError("merge_sources needs at least one source")
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    order = Window.partitionBy("key").orderBy(F.col("_source").asc(), F.col("seq").desc())
    out = union.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_source")
    return out if keep_tombstones else out.where(F.col("op") == SET)
