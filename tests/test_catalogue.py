"""Every registered query against its oracle, through DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from tideline.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    expected = duck.sql(catalogue.ORACLES[name])
    assert sorted(expected.columns) == columns
    assert "HUGEINT" not in map(str, expected.types)
    want = expected.select(",".join(f'"{c}"' for c in columns)).fetchall()
    assert normal(tuple(r[c] for c in columns) for r in df.collect()) == normal(want)


def test_tombstones_are_hidden_after_resolution(spark, sf_dir):
    """Filtering deletes before the newest record is chosen would show deleted keys."""
    log = catalogue.event_log(spark, sf_dir)
    wrong = log.where("op = 1").select("key").distinct().count()
    assert catalogue.QUERIES["keys"](spark, sf_dir).count() < wrong


def test_key_filter_reaches_the_scan(spark, tmp_path, sf_dir):
    catalogue.event_log(spark, sf_dir).write.parquet(str(tmp_path / "log"))
    from tideline.operators import resolve

    log = spark.read.parquet(str(tmp_path / "log"))
    plan = resolve.get(log, "user:000001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,user:000001)" in plan
    keys = resolve.keys(log)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in keys.split("ReadSchema")[1]


def test_seek_many_against_sorted_keys(spark):
    import bisect
    import random

    from tideline.operators import resolve

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcé\U00010000￿") for _ in range(r.randrange(6)))
    log = [(word(), k, r.choice([1, 1, 2]), "v") for k in range(600)]
    newest = {k: op for k, _, op, _ in log}
    live = sorted((k.encode() for k, op in newest.items() if op == 1))
    targets = {word() for _ in range(300)}
    got = resolve.seek_many(spark.createDataFrame(log, "key string, seq long, op int, value string"), spark.createDataFrame([(t,) for t in targets], "target string"))
    want = {t: (live[at].decode() if (at := bisect.bisect_left(live, t.encode())) < len(live) else None) for t in targets}
    assert {x["target"]: x["key"] for x in got.collect()} == want
    nothing = resolve.seek_many(spark.createDataFrame([], "key string, seq long, op int, value string"), spark.createDataFrame([("a",)], "target string"))
    assert [tuple(x) for x in nothing.collect()] == [("a", None)]


def test_overlaps_and_existence_against_brute_force(spark, monkeypatch):
    import random

    from tideline.operators import compaction, resolve

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 5)))
    runs = [(k, *sorted((word(), word()))) for k in range(120)]
    got = {tuple(x) for x in compaction.overlapping_runs(spark.createDataFrame(runs, "run int, lo string, hi string")).collect()}
    assert got == {(a, b) for a, lo, hi in runs for b, lo2, hi2 in runs if a < b and lo <= hi2 and lo2 <= hi}
    monkeypatch.setattr(resolve, "STRETCH", 16)
    log, live, want = [], {}, set()
    for seq in range(500):
        key, op = r.choice("aaaaaaab") + str(r.randrange(2)), r.choice([1, 2])
        log.append((key, seq, op))
        if op == 2:
            want.add((key, seq, live.get(key, False)))
        live[key] = op == 1
    assert {tuple(x) for x in resolve.delete_existed(spark.createDataFrame(log, "key string, seq long, op int")).collect()} == want


@pytest.fixture(scope="module")
def many_keys(spark, tmp_path_factory):
    """10,000 events of 3,000 users: far over the small levels of the store queries."""
    folder = str(tmp_path_factory.mktemp("many"))
    rows = spark.range(10_000).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts", "id * 7919 % 3001 AS user_id", "if(id % 9 = 0, 'error', 'view') AS event_type", "concat('{', id, '}') AS props")
    rows.write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["store_scan", "store_compact_full", "store_range"])
def test_store_queries_take_few_spark_jobs(spark, many_keys, name):
    """There were several jobs for each file of 2 KB that moved down a level, so they grew with the table."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{many_keys}/events.parquet/*.parquet'")
    sc = spark.sparkContext
    sc.setJobGroup(f"few-{name}", name)
    try:
        df = catalogue.QUERIES[name](spark, many_keys)
        columns = sorted(df.columns)
        got = normal(tuple(r[c] for c in columns) for r in df.collect())
        jobs = len(sc.statusTracker().getJobIdsForGroup(f"few-{name}"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == normal(con.sql(catalogue.ORACLES[name]).select(",".join(f'"{c}"' for c in columns)).fetchall())
    assert 0 < jobs < 100, jobs
