import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.errors import BlockFileCorruption, CacheCorruption, LogCorruption, LogIncomplete
from tideline.cache import decode
from tideline.functions.bloom import BloomFilter
from tideline.sources import wal
from tideline.sources.blockfile import BlockFile, encode, level_and_id
from tideline.sources.log_source import register

SEED = [wal.Record(wal.SET, "alpha", "1"), wal.Record(wal.SET, "beta", ""), wal.Record(wal.DELETE, "gämma"), wal.Record(wal.SET, "", "x")]
DATA = b"".join(r.encode() for r in SEED)


def test_round_trip():
    assert wal.read(DATA) == (SEED, len(DATA))
    assert wal.read(b"") == ([], 0)


@given(st.lists(st.tuples(st.text(max_size=8), st.one_of(st.none(), st.text(max_size=8))), max_size=12))
@settings(max_examples=60, deadline=None)
def test_round_trip_of_any_records(pairs):
    records = [wal.Record(wal.DELETE if v is None else wal.SET, k, v) for k, v in pairs]
    assert wal.read(b"".join(r.encode() for r in records))[0] == records


@given(st.integers(0, len(SEED) - 1), st.data())
@settings(max_examples=80, deadline=None)
def test_a_record_cut_at_any_offset_is_a_torn_tail(which, data):
    whole = SEED[which].encode()
    tail = whole[: data.draw(st.integers(1, len(whole) - 1))]
    assert wal.read(DATA + tail) == (SEED, len(DATA))
    with pytest.raises(LogIncomplete):
        wal.read(DATA + tail, strict=True)


@given(st.integers(4, 40))
@settings(max_examples=20, deadline=None)
def test_space_that_was_never_written_ends_a_log(n):
    assert wal.read(DATA + bytes(n)) == (SEED, len(DATA)) == wal.read(DATA + bytes(n), strict=True)


def test_damage_is_not_a_torn_tail():
    flipped = bytearray(DATA)
    flipped[14] ^= 1
    with pytest.raises(LogCorruption):
        wal.read(bytes(flipped))
    for length in (0, 5, 1 << 30):
        with pytest.raises(LogCorruption):
            wal.read(struct.pack("<I", length) + DATA[4:])


@pytest.mark.parametrize("body", [struct.pack("<BII", 3, 1, 0) + b"k", struct.pack("<BII", 2, 1, 1) + b"kv", struct.pack("<BII", 1, 9, 0) + b"k", struct.pack("<BII", 1, 1, 0) + b"\xff", b"\1\2"])
def test_bad_bodies(body):
    with pytest.raises(LogCorruption):
        wal.decode_body(body)


def test_block_file():
    entries = [(f"key_{i:03}", None if i % 7 == 0 else f"v{i}") for i in range(100)] + [("￿", "a"), ("\U00010000", "b"), ("", "empty")]
    f = BlockFile(encode(entries, 64))
    want = sorted(entries, key=lambda e: e[0].encode())
    assert list(f.entries()) == want
    assert f.record_count == 103 and f.block_count > 10 and f.key_range() == ("", "\U00010000")
    assert f.get("key_001") == (True, "v1") and f.get("key_007") == (True, None) and f.get("nope") == (False, None)
    assert BlockFile(encode([])).key_range() is None


def test_block_file_checks():
    data = bytearray(encode([("a", "1")]))
    for change in (b"short", bytes(data[:-1]), bytes(4) + bytes(data[4:]), bytes(data[:30]) + b"\xff" + bytes(data[31:])):
        with pytest.raises(BlockFileCorruption):
            BlockFile(change)
    assert level_and_id("sstable_L2_000017.sst") == (2, 17) and level_and_id("sstable_5.sst") == (0, 5) and level_and_id("x.sst") is None


@pytest.mark.parametrize("rate", [0.1, 0.01, 0.001])
def test_bloom_filter_keeps_its_rate(rate):
    """Filled as planned, false answers lie within five deviations of the rate; none is negative."""
    held, probes = [f"held/{k * k}" for k in range(2000)], 4000
    b = BloomFilter.from_entries(held, rate)
    assert all(map(b.might_contain, held))
    false = sum(b.might_contain(f"absent/{k}") for k in range(probes))
    assert false <= rate * probes + 5 * (rate * probes) ** 0.5
    again = BloomFilter.decode(b.encode())
    assert (again.m, again.k, again.words) == (b.m, b.k, b.words)
    assert BloomFilter.decode(b.encode()[:-1]) is None and BloomFilter.from_entries([]).m == 64


def test_an_empty_block_file_is_read(spark, tmp_path):
    from tideline.sources.blockfile import read_block_files

    (tmp_path / "sstable_L1_000001.sst").write_bytes(encode([]))
    (tmp_path / "sstable_L0_000002.sst").write_bytes(encode([("a", "1")]))
    assert [tuple(r) for r in read_block_files(spark, str(tmp_path)).collect()] == [("a", 1, "1", 0, 2)]


def test_bloom_columns_agree_with_the_packed_form(spark):
    from pyspark.sql import functions as F

    from tideline.functions import bloom

    keys = ["a", "", "käse", "日本", "user:000001"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r["key"]: r["p"] for r in df.select("key", bloom.bit_positions(F.col("key"), 977, 5).alias("p")).collect()}
    for k in keys:
        h1, h2 = zlib.crc32(k.encode()), zlib.crc32(k.encode()[::-1])
        assert got[k] == [(h1 + i * h2) % 977 for i in range(5)]


def test_cache_entries(spark):
    from pyspark.sql import functions as F

    from tideline.functions.records import expiry_of, value_of

    raw = ["0:still-here", "1:http://a:b", "not-an-entry", " 5 :x", f"{2**64 - 1}:max", "-1:x", ":"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select("raw", expiry_of(F.col("raw")).alias("e"), value_of(F.col("raw")).alias("v"))
    for r in df.collect():
        try:
            want = decode(r["raw"])
        except CacheCorruption:
            assert r["e"] is None
        else:
            assert (int(r["e"]), r["v"]) == want


def test_log_source(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(DATA)
    register(spark)
    rows = spark.read.format("tideline_wal").load(str(tmp_path)).orderBy("seq").collect()
    assert [(r["key"], r["op"], r["value"]) for r in rows] == [(r.key, r.op, r.value) for r in SEED]


def test_block_files_as_a_changelog(spark, tmp_path):
    from tideline.operators.resolve import scan
    from tideline.sources.blockfile import as_log, read_block_files

    (tmp_path / "sstable_L1_000009.sst").write_bytes(encode([("a", "old"), ("b", "1"), ("c", "1")]))
    (tmp_path / "sstable_L0_000002.sst").write_bytes(encode([("a", "new"), ("b", None)]))
    (tmp_path / "sstable_3.sst").write_bytes(encode([("a", "newest")]))
    rows = scan(as_log(read_block_files(spark, str(tmp_path)))).collect()
    assert [tuple(r) for r in rows] == [("a", "newest"), ("c", "1")]


@pytest.mark.parametrize("name", ["wal_recover", "block_files"])
def test_every_change_passes_through_the_codecs(spark, tmp_path, monkeypatch, name):
    from tideline.operators import resolve
    from tideline.plans import catalogue

    sf_dir = "/root/testdata/sf0.01"
    monkeypatch.setattr(catalogue, "scratch", lambda _: str(tmp_path))
    log = catalogue.event_log(spark, sf_dir)
    want = {tuple(r) for r in resolve.live(log).select("key", "value").collect()}
    got = catalogue.QUERIES[name](spark, sf_dir).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(set(got))
    files = [p.read_bytes() for p in tmp_path.iterdir() if p.suffix in (".log", ".sst")]
    if name.startswith("wal"):
        assert sum(len(wal.read(data)[0]) for data in files) == log.count()
        assert all(wal.read(data)[1] < len(data) for data in files)
    else:
        keys = [k for data in files for k, _ in BlockFile(data).entries()]
        assert set(keys) == {r["key"] for r in log.select("key").distinct().collect()}
