import random

import pytest
from pyspark.sql import functions as F

from tideline.operators.compaction import TOP, FileMeta, blocks_over, blocks_within, overlapping_runs, pick_compaction, widened
from tideline.operators.resolve import MAX_RANGES
from tideline.options import Options

CONFIG = Options(l0_compaction_threshold=2, level_size_multiplier=2, target_level_size=100)


def meta(id, level, lo, hi, size=10):
    return FileMeta(id, level, lo, hi, size)


@pytest.mark.parametrize(
    ("files", "plan"),
    [
        ([], None),
        ([meta(1, 0, "a", "c")], None),
        ([meta(1, 0, "a", "c"), meta(2, 0, "b", "d")], (0, (2, 1), (), True)),
        ([meta(1, 0, "a", "c"), meta(2, 0, "b", "d"), meta(3, 1, "d", "e"), meta(4, 1, "f", "g")], (0, (2, 1), (3,), True)),
        ([meta(1, 0, "a", "c"), meta(2, 0, "b", "d"), meta(5, 2, "a", "z")], (0, (2, 1), (), False)),
        ([meta(3, 1, "a", "b", 60), meta(2, 1, "c", "d", 60), meta(9, 2, "d", "f")], (1, (2,), (9,), True)),
        ([meta(3, 1, "a", "b", 50), meta(2, 1, "c", "d", 50)], None),
        ([meta(7, 2, "a", "b", 150), meta(6, 2, "c", "d", 60), meta(8, 3, "a", "c")], (2, (6,), (8,), True)),
        ([meta(1, 0, "￿", "￿"), meta(2, 0, "a", "a"), meta(3, 1, "\U00010000", "\U00010000")], (0, (2, 1), (), True)),
    ],
)
def test_picker(files, plan):
    got = pick_compaction(files, CONFIG)
    assert (got and (got.level, got.inputs, got.overlaps, got.drop_tombstones)) == plan


def test_options_are_clamped():
    o = Options(l0_compaction_threshold=0, level_size_multiplier=1, target_level_size=0)
    assert (o.l0_compaction_threshold, o.level_size_multiplier, o.target_level_size) == (1, 2, 1)


def test_an_interval_over_all_ranges_takes_few_blocks(spark):
    """Long runs used to be put into each range that they reach, and compared in all of them."""
    spans = [(0, MAX_RANGES - 1), (1, MAX_RANGES - 2), (0, 0), (MAX_RANGES - 1, MAX_RANGES - 1), (31, 32), (5, 700), (33, 62)]
    rows = spark.createDataFrame(spans, "first int, last int").select("first", "last", blocks_within(F.col("first"), F.col("last")).alias("blocks"))
    over = [set(r[0]) for r in spark.range(MAX_RANGES).select(blocks_over(F.col("id").cast("int"))).collect()]
    for first, last, blocks in rows.collect():
        assert len(blocks) <= MAX_RANGES / 2**TOP + 2 * TOP and all(len(over[k] & set(blocks)) == (first <= k <= last) for k in range(MAX_RANGES))


def test_overlaps_of_long_runs_and_equal_begins(spark):
    r = random.Random(4)
    runs = [(k, f"{r.choice([0, 7, k]):04}", f"{r.choice([7, k, 9000, 9999]):04}") for k in range(1500)]
    runs = [(k, min(lo, hi), max(lo, hi)) for k, lo, hi in runs] + [(None, "0000", "9999"), (1500, None, None)]
    got = [tuple(x) for x in overlapping_runs(spark.createDataFrame(runs, "run long, lo string, hi string")).collect()]
    runs = runs[:1500]
    want = {(a, b) for a, lo, hi in runs for b, lo2, hi2 in runs[a + 1 :] if lo <= hi2 and lo2 <= hi}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize(
    ("files", "job"),
    [
        ([meta(1, 0, "a", "c"), meta(2, 0, "b", "d"), meta(3, 1, "d", "e"), meta(4, 1, "f", "g")], ({1, 2, 3}, 1, True)),
        ([meta(k, 1, f"a{k}", f"b{k}", 30) for k in range(1, 7)] + [meta(9, 2, "a2", "a4"), meta(10, 2, "x", "y"), meta(11, 3, "a", "z")], ({1, 2, 3, 9}, 2, False)),
        ([meta(1, 0, "a", "c", 900), meta(2, 0, "b", "d", 10), meta(3, 1, "x", "y"), meta(4, 2, "z", "zz"), meta(5, 4, "c", "e"), meta(6, 4, "zzz", "zzz"), meta(7, 5, "a", "b")], ({1, 2, 3, 4, 5}, 4, False)),
    ],
)
def test_a_job_takes_what_later_plans_would(files, job):
    inputs, output, drop = widened(pick_compaction(files, CONFIG), files, CONFIG)
    assert ({f.id for f in inputs}, output, drop) == job and len(inputs) == len(job[0])
