"""Registered queries of the store engine, each with its SQL oracle."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.cache import Cache
from tideline.errors import InjectedFault, LogIncomplete, StoreIOError
from tideline.faults import Fault, FaultPoint
from tideline.functions import bloom
from tideline.functions.records import crc32, encode_entry, expiry_of, is_expired, level_capacity, record_size, value_of
from tideline.operators import compaction, resolve
from tideline.options import Options
from tideline.session import ship
from tideline.sources import blockfile, log_source, wal
from tideline.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelog derived from `events`: a user's last event, deleted by an error."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    error = F.col("event_type") == "error"
    return events.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.col("event_id").alias("seq"),
        F.when(error, F.lit(resolve.DELETE)).otherwise(F.lit(resolve.SET)).cast("tinyint").alias("op"),
        F.when(~error, F.concat("event_type", F.lit("|"), "props")).alias("value"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
    )


LOG_SQL = """log AS (
  SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id AS seq,
         CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
         CASE WHEN event_type = 'error' THEN NULL ELSE event_type || '|' || props END AS value,
         epoch_us(ts) // 1000 AS ts_ms
  FROM events),
latest AS (SELECT key, seq, op, value, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
live AS (SELECT key, seq, value, ts_ms FROM latest WHERE op = 1)"""


def query(name: str, sql: str | None):
    """Registers fn(spark, sf_dir) under a name, with its oracle after WITH log, latest, live."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = f"WITH {LOG_SQL} {sql}"
        return fn

    return put


@query("scan", "SELECT key, value FROM live")
def _scan(spark, d):
    return resolve.scan(event_log(spark, d))


@query("keys", "SELECT key FROM live")
def _keys(spark, d):
    return resolve.keys(event_log(spark, d))


@query("get", "SELECT key, value FROM live WHERE key = 'user:000000'")
def _get(spark, d):
    return resolve.get(event_log(spark, d), "user:000000")


PROBES = ("user:000000", "user:000042", "user:999999")
PROBE_SQL = "probes(key) AS (VALUES ('user:000000'), ('user:000042'), ('user:999999'))"


def probes(spark: SparkSession, name: str = "key", values: tuple[str, ...] = PROBES) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@query("multi_get", f", {PROBE_SQL} SELECT p.key, live.value FROM probes p LEFT JOIN live ON p.key = live.key")
def _multi_get(spark, d):
    return resolve.multi_get(event_log(spark, d), probes(spark))


@query("exists", f", {PROBE_SQL} SELECT p.key, live.key IS NOT NULL AS present FROM probes p LEFT JOIN live ON p.key = live.key")
def _exists(spark, d):
    return resolve.exists(event_log(spark, d), probes(spark))


@query("range_incl_excl", "SELECT key, value FROM live WHERE key >= 'user:000010' AND key < 'user:000020'")
def _range_incl_excl(spark, d):
    return resolve.range_scan(event_log(spark, d), "user:000010", "user:000020")


@query("range_excl_incl", "SELECT key, value FROM live WHERE key > 'user:000010' AND key <= 'user:000020'")
def _range_excl_incl(spark, d):
    return resolve.range_scan(event_log(spark, d), "user:000010", "user:000020", start_inclusive=False, end_inclusive=True)


@query("range_from", "SELECT key, value FROM live WHERE key >= 'user:000005'")
def _range_from(spark, d):
    return resolve.range_scan(event_log(spark, d), "user:000005")


@query("range_to", "SELECT key, value FROM live WHERE key <= 'user:000008'")
def _range_to(spark, d):
    return resolve.range_scan(event_log(spark, d), None, "user:000008", end_inclusive=True)


@query("range_inverted", "SELECT key, value FROM live WHERE key >= 'user:000020' AND key < 'user:000010'")
def _range_inverted(spark, d):
    return resolve.range_scan(event_log(spark, d), "user:000020", "user:000010")


@query("prefix", "SELECT key, value FROM live WHERE starts_with(key, 'user:0000')")
def _prefix(spark, d):
    return resolve.prefix_scan(event_log(spark, d), "user:0000")


@query("seek", "SELECT key, value FROM live WHERE key >= 'user:000003' ORDER BY key LIMIT 1")
def _seek(spark, d):
    return resolve.seek(event_log(spark, d), "user:000003")


TARGETS = ("", "user:000003", "user:0000035", "user:000100", "zzz")


@query("seek_many", ", targets(target) AS (VALUES (''), ('user:000003'), ('user:0000035'), ('user:000100'), ('zzz')) SELECT target, (SELECT min(key) FROM live WHERE key >= target) AS key FROM targets")
def _seek_many(spark, d):
    return resolve.seek_many(event_log(spark, d), probes(spark, "target", TARGETS))


@query("snapshot_at_seq", ", s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE seq <= 500) WHERE rn = 1 AND op = 1) SELECT key, value FROM s")
def _snapshot(spark, d):
    return resolve.snapshot(event_log(spark, d), 500)


@query("tombstones", "SELECT key FROM latest WHERE op = 2")
def _tombstones(spark, d):
    return resolve.tombstones(event_log(spark, d))


@query("delete_existed", ", h AS (SELECT key, seq, op, lag(op) OVER (PARTITION BY key ORDER BY seq) AS before FROM log) SELECT key, seq, coalesce(before = 1, false) AS existed FROM h WHERE op = 2")
def _delete_existed(spark, d):
    return resolve.delete_existed(event_log(spark, d))


RUN = 1024
RUN_SQL = f"runs AS (SELECT key, seq, op, value, seq // {RUN} AS run FROM log), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) AS rn FROM runs) WHERE rn = 1)"
META_SQL = f"{RUN_SQL}, meta AS (SELECT run, min(key) AS lo, max(key) AS hi, count(*) AS n, CAST(sum(9 + strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM newest GROUP BY run)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest record per key of each fixed run of seq: what a flush per run would write."""
    log = event_log(spark, sf_dir).withColumn("run", F.floor(F.col("seq") / RUN))
    newest = Window.partitionBy("run", "key").orderBy(F.col("seq").desc())
    return log.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


@query("file_meta", f", {META_SQL} SELECT run, lo, hi, n, bytes FROM meta")
def _file_meta(spark, d):
    return compaction.file_metadata(runs(spark, d))


@query("overlap_join", f", {META_SQL} SELECT a.run AS a, b.run AS b FROM meta a JOIN meta b ON a.run < b.run AND a.lo <= b.hi AND b.lo <= a.hi")
def _overlap_join(spark, d):
    log = event_log(spark, d).withColumn("run", F.floor(F.col("seq") / RUN))
    return compaction.overlapping_runs(compaction.key_ranges(log))


ORDER_SQL = """o AS (SELECT 'o:' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS key, o_orderkey // 1000 AS part, o_custkey FROM orders),
meta AS (SELECT part * 2 + k AS run, min(key) AS lo, max(key) AS hi FROM o, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR o_custkey % 50 = 0 GROUP BY ALL)"""


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs for each thousand orders, all and a sparse part: each overlaps its twin alone."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.concat(F.lit("o:"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("key"), F.floor(F.col("o_orderkey") / 1000).alias("part"), "o_custkey", F.lit(None).cast("string").alias("value"))
    both = rows.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where("k = 0 OR o_custkey % 50 = 0")
    return both.withColumn("run", F.col("part") * 2 + F.col("k"))


@query("overlap_orders", None)
def _overlap_orders(spark, d):
    return compaction.overlapping_runs(compaction.key_ranges(order_runs(spark, d)))


ORACLES["overlap_orders"] = f"WITH {ORDER_SQL} SELECT a.run AS a, b.run AS b FROM meta a JOIN meta b ON a.run < b.run AND a.lo <= b.hi AND b.lo <= a.hi"


@query("union_range", f", {META_SQL} SELECT min(lo) AS lo, max(hi) AS hi, CAST(sum(bytes) AS BIGINT) AS bytes, min(run) AS oldest FROM meta")
def _union_range(spark, d):
    return compaction.file_metadata(runs(spark, d)).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("bytes").alias("bytes"), F.min("run").alias("oldest"))


@query("record_sizes", "SELECT key, CAST(9 + strlen(key) + coalesce(strlen(value), 0) AS BIGINT) AS bytes FROM latest")
def _record_sizes(spark, d):
    return resolve.latest(event_log(spark, d)).select("key", record_size(F.col("key"), F.col("value")).alias("bytes"))


@query("read_attribution", f", {RUN_SQL} SELECT run, count(*) AS n_keys FROM (SELECT key, max(run) AS run FROM newest GROUP BY key) GROUP BY run")
def _read_attribution(spark, d):
    return runs(spark, d).groupBy("key").agg(F.max("run").alias("run")).groupBy("run").agg(F.count("*").alias("n_keys"))


@query("shadowed", f", {RUN_SQL} SELECT count(*) AS n, CAST(sum(CASE WHEN run < top THEN 1 ELSE 0 END) AS BIGINT) AS shadowed FROM (SELECT run, max(run) OVER (PARTITION BY key) AS top FROM newest)")
def _shadowed(spark, d):
    each = runs(spark, d).groupBy("key").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.sum(F.col("n") - 1).alias("shadowed"))


@query("merge_keep_tombstones", "SELECT key, op, value FROM latest")
def _merge_keep(spark, d):
    log = event_log(spark, d)
    return resolve.merge_sources([log.where("seq >= 512"), log.where("seq < 512")], keep_tombstones=True).select("key", F.col("op").cast("int").alias("op"), "value")


@query("merge_hide_tombstones", "SELECT key, value FROM live")
def _merge_hide(spark, d):
    log = event_log(spark, d)
    return resolve.merge_sources([log.where("seq >= 512"), log.where("seq < 512")]).select("key", "value")


@query("compact_drop", f", {RUN_SQL}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r2 FROM newest) WHERE r2 = 1 AND op = 1) SELECT key, seq, value FROM m")
def _compact_drop(spark, d):
    return compaction.merge_runs(runs(spark, d), True).select("key", "seq", "value")


@query("write_amp", f", {META_SQL}, t AS (SELECT CAST(sum(bytes) AS BIGINT) AS flushed FROM meta), c AS (SELECT CAST(sum(9 + strlen(key) + strlen(value)) AS BIGINT) AS written FROM live) SELECT flushed, written, round(CASE WHEN flushed > 0 THEN CAST(flushed + written AS DOUBLE) / flushed END, 6) AS write_amplification FROM t, c")
def _write_amp(spark, d):
    size = record_size(F.col("key"), F.col("value"))
    flushed = runs(spark, d).select(size.alias("flushed"), F.lit(0).cast("long").alias("written"))
    merged = resolve.live(event_log(spark, d)).select(F.lit(0).cast("long").alias("flushed"), size.alias("written"))
    both = flushed.unionByName(merged).agg(F.sum("flushed").alias("flushed"), F.sum("written").alias("written"))
    return both.withColumn("write_amplification", F.round((F.col("flushed") + F.col("written")).cast("double") / F.nullif("flushed", F.lit(0)), 6))


@query("level_capacities", "SELECT CAST(i AS BIGINT) AS level, CAST(8388608 * power(10, greatest(i - 1, 0)) AS BIGINT) AS capacity FROM range(1, 8) t(i)")
def _level_capacities(spark, d):
    options = Options()
    return spark.createDataFrame([(k, level_capacity(k, options.target_level_size, options.level_size_multiplier)) for k in range(1, 8)], "level long, capacity long")


@query("stats_ops", "SELECT op, count(*) AS n, count(DISTINCT key) AS n_keys FROM log GROUP BY op")
def _stats_ops(spark, d):
    return event_log(spark, d).groupBy(F.col("op").cast("int").alias("op")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"))


@query("bloom_params", f", {META_SQL}, m AS (SELECT run, n, greatest(CAST(ceil(-n * ln(0.01::DOUBLE) / (ln(2.0::DOUBLE) * ln(2.0::DOUBLE))) AS BIGINT), 64) AS m FROM meta) SELECT run, n, m, CAST(least(greatest(round(m / n::DOUBLE * ln(2.0::DOUBLE)), 1), 30) AS BIGINT) AS k FROM m")
def _bloom_params(spark, d):
    sized = compaction.file_metadata(runs(spark, d)).select("run", "n", bloom.num_bits(F.col("n")).alias("m"))
    return sized.withColumn("k", bloom.num_hashes(F.col("m"), F.col("n")))


#: CRC-32 of a key of ASCII characters, and of its reversed bytes, by the table of the polynomial.
CRC_SQL = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS tab),
crc_bytes AS (SELECT key, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)) AS b FROM (SELECT DISTINCT key FROM asked)),
crc AS (SELECT key, xor(list_reduce(list_concat([4294967295], b), lambda x, y: xor(x >> 8, tab[xor(x & 255, y) + 1])), 4294967295) AS h1,
  xor(list_reduce(list_concat([4294967295], list_reverse(b)), lambda x, y: xor(x >> 8, tab[xor(x & 255, y) + 1])), 4294967295) AS h2 FROM crc_bytes, crc_table)"""


def asked_keys(spark, d) -> DataFrame:
    """Every key of the log, and as many that it does not hold."""
    keys = event_log(spark, d).select("key").distinct()
    return keys.unionByName(keys.select(F.concat(F.lit("absent:"), "key").alias("key")))


@query("bloom_membership", f""", asked AS (SELECT key FROM log UNION SELECT 'absent:' || key FROM log), {CRC_SQL},
n AS (SELECT count(DISTINCT key) AS n FROM log), m AS (SELECT n, greatest(CAST(ceil(-n * ln(0.01::DOUBLE) / (ln(2.0::DOUBLE) * ln(2.0::DOUBLE))) AS BIGINT), 64) AS m FROM n),
k AS (SELECT m, CAST(least(greatest(round(m / n::DOUBLE * ln(2.0::DOUBLE)), 1), 30) AS BIGINT) AS k FROM m),
bits AS (SELECT key, unnest(list_transform(range(k), lambda i: (h1 + i * h2) % m)) AS bit FROM crc, k),
held AS (SELECT DISTINCT bit FROM bits WHERE NOT starts_with(key, 'absent:'))
SELECT key, bool_and(held.bit IS NOT NULL) AS maybe FROM bits LEFT JOIN held USING (bit) GROUP BY key""")
def _bloom_membership(spark, d):
    """A filter of the size that the keys need, asked for them and for absent ones."""
    keys = event_log(spark, d).select("key").distinct()
    n = F.col("n")
    size = keys.agg(F.count("*").alias("n")).withColumn("m", bloom.num_bits(n)).select("m", bloom.num_hashes(F.col("m"), n).alias("k")).first()
    return bloom.might_contain(asked_keys(spark, d), bloom.build(keys, size["m"], size["k"]), size["m"], size["k"])


TTL_MS, AS_OF_MS = 86_400_000, 1_706_659_200_000


@query("ttl_state", f", s AS (SELECT CASE WHEN op = 2 THEN 'absent' WHEN ts_ms + {TTL_MS} <= {AS_OF_MS} THEN 'expired' ELSE 'live' END AS state FROM latest) SELECT state, count(*) AS n FROM s GROUP BY state")
def _ttl_state(spark, d):
    expired = is_expired(F.col("ts_ms") + TTL_MS, F.lit(AS_OF_MS))
    state = F.when(F.col("op") == resolve.DELETE, "absent").when(expired, "expired").otherwise("live")
    return resolve.latest(event_log(spark, d)).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("ttl_entries", f"SELECT key, ts_ms + {TTL_MS} AS expires_at_ms, value FROM live WHERE ts_ms + {TTL_MS} > {AS_OF_MS}")
def _ttl_entries(spark, d):
    """Entries through the text form of the cache and back."""
    raw = resolve.live(event_log(spark, d)).select("key", encode_entry(F.col("ts_ms") + TTL_MS, F.col("value")).alias("raw"))
    rows = raw.select("key", expiry_of(F.col("raw")).cast("long").alias("expires_at_ms"), value_of(F.col("raw")).alias("value"))
    return rows.where(~is_expired(F.col("expires_at_ms"), F.lit(AS_OF_MS)))


@query("key_checksums", f", asked AS (SELECT key FROM log), {CRC_SQL} SELECT key, h1, h2 FROM crc")
def _key_checksums(spark, d):
    """CRC-32 of keys and of their reversed bytes, as the filters hash them."""
    keys = event_log(spark, d).select("key").distinct()
    return keys.select("key", crc32(F.col("key")).alias("h1"), F.crc32(bloom.reversed_bytes(F.col("key"))).alias("h2"))


def scratch(spark: SparkSession) -> str:
    """A folder for the files of a query, gone when the process ends: on the mounted path that the
    cluster names, else temporary. A store locks and renames files, so it needs such a path."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        folder = tempfile.mkdtemp(prefix="tideline-")
    else:
        scheme, mark, rest = base.partition(":")
        if mark and "/" not in scheme and scheme != "file":
            raise StoreIOError(f"a store needs a mounted folder, which {base} is not")
        path = "/" + rest.lstrip("/") if mark and scheme == "file" else base
        folder = os.path.join(path, f"store-{uuid.uuid4().hex}")
        os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def loaded_store(spark: SparkSession, sf_dir: str, parts: int = 5) -> Store:
    """A store that received the changelog in consecutive bulk commits, compacted on the way."""
    log = event_log(spark, sf_dir)
    top = log.agg(F.max("seq")).first()[0] + 1
    store = Store.open(spark, scratch(spark), Options(l0_compaction_threshold=2, target_level_size=4096, target_file_size=2048))
    for k in range(parts):
        part = log.where((F.col("seq") >= top * k // parts) & (F.col("seq") < top * (k + 1) // parts))
        store.write(resolve.latest(part).select("key", "op", "value"))
    return store


@query("store_scan", "SELECT key, value FROM live")
def _store_scan(spark, d):
    """Through flushes and leveled compaction in files."""
    with loaded_store(spark, d) as store:
        return store.scan()


@query("store_range", "SELECT key, value FROM live WHERE key > 'user:000002' AND key <= 'user:000015'")
def _store_range(spark, d):
    with loaded_store(spark, d) as store:
        return store.range("user:000002", "user:000015", start_inclusive=False, end_inclusive=True)


@query("store_compact_full", "SELECT key, value FROM live")
def _store_compact_full(spark, d):
    with loaded_store(spark, d) as store:
        store.compact_full()
        files = store.files()
        if any(f.level != 1 for f in files) or any(a.largest >= b.smallest for a, b in zip(files, files[1:], strict=False)):
            raise AssertionError("a full compaction leaves one run of level 1")
        return store.scan()


@query("store_levels", "SELECT count(*) AS n_keys, true AS disjoint FROM live")
def _store_levels(spark, d):
    """Files of each level from 1 on have disjoint key ranges."""
    with loaded_store(spark, d) as store:
        files, keys = [f for f in store.files() if f.level], store.keys()
    meta = spark.createDataFrame([(f.level * 1_000_000 + f.id, f.level, f.smallest, f.largest) for f in files], "run long, level int, lo string, hi string")
    same = compaction.overlapping_runs(meta).join(meta.select(F.col("run").alias("a"), "level"), "a").join(meta.select(F.col("run").alias("b"), F.col("level").alias("l2")), "b").where("level = l2")
    n = same.agg((F.count("*") == 0).alias("disjoint"))
    return keys.agg(F.count("*").alias("n_keys")).withColumn("disjoint", F.lit(n.first()[0]))


def written_parts(rows: DataFrame, encode: Callable[[list, int], tuple[str, bytes]], folder: str) -> None:
    """One file of each partition's rows, written by its task; encode gives its name and bytes."""
    ship(rows.sparkSession)
    columns = rows.columns

    def run(batches):
        held = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
        if held:
            name, data = encode(held, TaskContext.get().partitionId())
            draft = os.path.join(folder, f"{uuid.uuid4().hex}.tmp")
            with open(draft, "wb") as f:
                f.write(data)
            os.replace(draft, os.path.join(folder, name))  # a repeated task puts the same file
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def recovered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes as segments of one log, each with a torn tail, read back through the data source.

    A segment is a range of seq, so a busy key is no hot file; segments are named in order.
    """
    folder = scratch(spark)

    def encode(rows, part):
        return f"part-{part:06d}.log", b"".join(wal.Record(op, key, value).encode() for key, op, value, _ in rows) + b"\x40\0\0\0torn"

    log = event_log(spark, sf_dir).select("key", "op", "value", "seq")
    written_parts(log.repartitionByRange("seq").sortWithinPartitions("seq"), encode, folder)
    log_source.register(spark)
    segment = F.regexp_extract("file", r"part-(\d+)\.log$", 1).cast("long")
    return spark.read.format("tideline_wal").load(folder).withColumn("seq", F.struct(segment, "seq"))


def block_file_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes through two generations of block files, the older one a level below.

    The files of a generation hold disjoint ranges of keys.
    """
    folder = scratch(spark)
    log = event_log(spark, sf_dir)
    middle = log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    for level, part in ((1, log.where(F.col("seq") <= middle)), (0, log.where(F.col("seq") > middle))):

        def encode(rows, k, level=level):
            return f"sstable_L{level}_{2 * k + 2 - level:06d}.sst", blockfile.encode(rows)

        written_parts(resolve.latest(part).select("key", "value").repartitionByRange("key"), encode, folder)
    return blockfile.as_log(blockfile.read_block_files(spark, folder))


@query("wal_recover", "SELECT key, value FROM live")
def _wal_recover(spark, d):
    return resolve.scan(recovered_log(spark, d))


@query("block_files", "SELECT key, value FROM live")
def _block_files(spark, d):
    return resolve.scan(block_file_log(spark, d))


# Single operations, one call each on the driver, over the whole of a small table: `nation`.
# Key n:<name>, value <region key>|<name>. Keys of nations whose number divides by 5 are deleted,
# those whose number divides by 3 are set a second time, in this order.

NATION_SQL = """nations AS (SELECT 'n:' || n_name AS key, CAST(n_regionkey AS VARCHAR) || '|' || n_name AS value, CAST(n_nationkey AS BIGINT) AS id FROM nation),
state AS (SELECT key, id, CASE WHEN id % 3 = 0 THEN 'again|' || value WHEN id % 5 = 0 THEN NULL ELSE value END AS value FROM nations)"""


def nations(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, int]]:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_regionkey", "n_nationkey").collect()
    return sorted((f"n:{r[0]}", f"{r[1]}|{r[0]}", r[2]) for r in rows)


def nation_changes(rows: list[tuple[str, str, int]]) -> list[tuple[str, str | None]]:
    """(key, value) of each change in order; a value of None deletes."""
    return [(k, v) for k, v, _ in rows] + [(k, None) for k, _, i in rows if i % 5 == 0] + [(k, f"again|{v}") for k, v, i in rows if i % 3 == 0]


def nation_store(spark: SparkSession, sf_dir: str, flush_threshold: int = 8, folder: str | None = None) -> tuple[Store, list, dict[str, bool]]:
    """An open store after all changes, the rows, and what each delete returned."""
    store, rows, existed = Store.open(spark, folder or scratch(spark), flush_threshold=flush_threshold), nations(spark, sf_dir), {}
    for key, value in nation_changes(rows):
        if value is None:
            existed[key] = store.delete(key)
        else:
            store.set(key, value)
    return store, rows, existed


@query("store_single", f", {NATION_SQL} SELECT key, value, value IS NOT NULL AS present, id % 5 = 0 AS existed FROM state UNION ALL SELECT 'absent', NULL, false, false")
def _store_single(spark, d):
    """set, delete, flushes on the way, reopening, then get and exists of each key."""
    folder = scratch(spark)
    store, rows, existed = nation_store(spark, d, folder=folder)
    store.close()
    with Store.open(spark, folder) as store:
        got = [(k, store.get(k), store.exists(k), existed.get(k, False)) for k in [*(r[0] for r in rows), "absent"]]
    return spark.createDataFrame(got, "key string, value string, present boolean, existed boolean")


@query("store_log_replay", f", {NATION_SQL} SELECT key, value FROM state WHERE value IS NOT NULL")
def _store_log_replay(spark, d):
    """Nothing is flushed: after reopening all comes from the log."""
    folder = scratch(spark)
    nation_store(spark, d, 10**9, folder)[0].close()
    with Store.open(spark, folder) as store:
        if store.files():
            raise AssertionError("records were flushed")
        return store.scan()


@query("cursor_seek", f", {NATION_SQL}, l AS (SELECT key FROM state WHERE value IS NOT NULL AND key >= 'n:B' AND key < 'n:T'), t(target) AS (VALUES (''), ('n:CHINA'), ('n:G'), ('n:Q'), ('n:S'), ('z')) SELECT target, (SELECT min(key) FROM l WHERE key >= target) AS key, (SELECT count(*) FROM l WHERE key >= target) AS n_left FROM t")
def _cursor_seek(spark, d):
    """Seeks of an ordered cursor stay in its bounds; what is left is walked to the end."""
    store, _, _ = nation_store(spark, d)
    with store:
        cursor, out = store.cursor("n:B", "n:T"), []
        for target in ("", "n:CHINA", "n:G", "n:Q", "n:S", "z"):
            cursor.seek(target)
            out.append((target, cursor.key(), sum(1 for _ in cursor)))
    return spark.createDataFrame(out, "target string, key string, n_left long")


@query("store_stats", f""", {NATION_SQL}, c AS (SELECT key, value, 1 AS op FROM nations UNION ALL SELECT key, '', 2 FROM nations WHERE id % 5 = 0 UNION ALL SELECT key, 'again|' || value, 1 FROM nations WHERE id % 3 = 0),
newest AS (SELECT key, CASE WHEN id % 3 = 0 THEN 'again|' || value WHEN id % 5 = 0 THEN '' ELSE value END AS value FROM nations)
SELECT (SELECT count(*) FROM newest) AS memtable_entries, (SELECT CAST(sum(strlen(key) + strlen(value)) AS BIGINT) FROM newest) AS memtable_bytes, (SELECT CAST(sum(17 + strlen(key) + strlen(value)) AS BIGINT) FROM c) AS wal_size,
  (SELECT count(*) FROM state WHERE value IS NOT NULL) AS memtable_hits, 1::BIGINT AS flushed_files, (SELECT CAST(sum(9 + strlen(key) + strlen(value)) AS BIGINT) FROM newest) AS bytes_flushed, 0::BIGINT AS wal_after, 0::BIGINT AS entries_after""")
def _store_stats(spark, d):
    """Figures of a store with all records in memory, read once each, and after its flush."""
    store, rows, _ = nation_store(spark, d, 10**9)
    with store:
        for key, _, _ in rows:
            store.get(key)
        before = store.stats()
        store.flush()
        after = store.stats()
    names = "memtable_entries long, memtable_bytes long, wal_size long, memtable_hits long, flushed_files long, bytes_flushed long, wal_after long, entries_after long"
    return spark.createDataFrame([(before.memtable_entries, before.memtable_bytes, before.wal_size, before.memtable_hits, after.sst_count, after.bytes_flushed, after.wal_size, after.memtable_entries)], names)


@query("compaction_metrics", f""", {NATION_SQL}, b AS (SELECT CAST(sum(9 + strlen(key) + strlen(value)) AS BIGINT) AS flushed FROM nations), t AS (SELECT CAST(sum(CASE WHEN id % 5 = 0 THEN 9 + strlen(key) ELSE 9 + strlen(key) + 6 + strlen(value) END) AS BIGINT) AS flushed FROM nations WHERE id % 5 = 0 OR id % 3 = 0),
w AS (SELECT CAST(sum(9 + strlen(key) + strlen(CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN 'again|' || value ELSE value END)) AS BIGINT) AS written FROM nations WHERE id % 5 <> 0)
SELECT 1::BIGINT AS full_compactions, 2::BIGINT AS input_files, b.flushed + t.flushed AS bytes_read, written AS bytes_written, round(CAST(b.flushed + t.flushed + written AS DOUBLE) / (b.flushed + t.flushed), 6) AS write_amplification FROM b, t, w""")
def _compaction_metrics(spark, d):
    """Two flushed files, the second with deletes and newer values, merged by a full compaction."""
    rows = nations(spark, d)
    with Store.open(spark, scratch(spark), Options(flush_threshold=10**9, l0_compaction_threshold=10**6)) as store:
        for key, value, _ in rows:
            store.set(key, value)
        store.flush()
        for key, value, i in rows:
            if i % 5 == 0:
                store.delete(key)
            elif i % 3 == 0:
                store.set(key, f"again|{value}")
        store.flush()
        store.compact_full()
        s = store.stats()
    return spark.createDataFrame([(s.full_compactions, s.compaction_input_files, s.compaction_bytes_read, s.compaction_bytes_written, round(s.write_amplification, 6))], "full_compactions long, input_files long, bytes_read long, bytes_written long, write_amplification double")


@query("cache_state", f""", {NATION_SQL}, e AS (SELECT key, value, CASE WHEN id % 4 = 0 THEN 0 ELSE 1000 * (1 + id % 4) END AS ttl FROM nations WHERE id % 7 <> 0)
SELECT n.key, CASE WHEN e.key IS NULL THEN 'miss' WHEN ttl <> 0 AND ttl <= 3000 THEN 'expired' ELSE 'hit' END AS state, CASE WHEN ttl = 0 OR ttl > 3000 THEN e.value END AS value FROM nations n LEFT JOIN e ON n.key = e.key
UNION ALL SELECT 'counts', count(*) || ' sets ' || count(CASE WHEN ttl = 0 OR ttl > 3000 THEN 1 END) || ' hits ' || ((SELECT count(*) FROM nations) - count(CASE WHEN ttl = 0 OR ttl > 3000 THEN 1 END)) || ' misses ' || count(CASE WHEN ttl <> 0 AND ttl <= 3000 THEN 1 END) || ' expired', CAST(count(CASE WHEN ttl = 0 OR ttl > 3000 THEN 1 END) AS VARCHAR) FROM e""")
def _cache_state(spark, d):
    """set with a time to live, delete, get at a later time; then the counters, and what clear removed."""
    rows, now = nations(spark, d), [1_000_000]
    cache = Cache.open(spark, scratch(spark), clock=lambda: now[0])
    for key, value, i in rows:
        if i % 7:
            cache.set(key, value, 0 if i % 4 == 0 else 1 + i % 4)
    now[0] += 3000
    out = []
    for key, _, _ in rows:
        before = cache.stats().expired
        value = cache.get(key)
        out.append((key, "expired" if cache.stats().expired > before else "miss" if value is None else "hit", value))
    s = cache.stats()
    cache.clear()
    out.append(("counts", f"{s.sets} sets {s.hits} hits {s.misses} misses {s.expired} expired", str(cache.stats().deletes)))
    if cache.stats().clears != 1 or cache.exists(rows[0][0]):
        raise AssertionError("clear leaves nothing")
    cache.close()
    return spark.createDataFrame(out, "key string, state string, value string")


@query("block_file_get", f", {NATION_SQL} SELECT key, true AS found, value FROM state UNION ALL SELECT 'no:' || key, false, NULL FROM nations")
def _block_file_get(spark, d):
    """Point reads of one block file of small blocks, through filter and index, present or not."""
    rows = nations(spark, d)
    data = blockfile.BlockFile(blockfile.encode(dict(nation_changes(rows)).items(), 128))
    got = [(k, *data.get(k)) for k in [*(r[0] for r in rows), *("no:" + r[0] for r in rows)]]
    return spark.createDataFrame(got, "key string, found boolean, value string")


@query("wal_strict", f", {NATION_SQL} SELECT key, count(*) AS n_records FROM (SELECT key FROM nations UNION ALL SELECT key FROM nations WHERE id % 5 = 0 UNION ALL SELECT key FROM nations WHERE id % 3 = 0) GROUP BY key UNION ALL SELECT 'torn: incomplete', 1")
def _wal_strict(spark, d):
    """A log read strictly: all of it, and refused once its last record is cut."""
    changes = nation_changes(nations(spark, d))
    data = b"".join(wal.Record(resolve.DELETE if v is None else resolve.SET, k, v).encode() for k, v in changes)
    records, _ = wal.read(data, strict=True)
    rows = [(r.key,) for r in records]
    try:
        wal.read(data[:-3], strict=True)
        rows.append(("torn: accepted",))
    except LogIncomplete:
        rows.append(("torn: incomplete",))
    return spark.createDataFrame(rows, "key string").groupBy("key").agg(F.count("*").alias("n_records"))


@query("store_faults", "SELECT point, true AS recovered FROM (VALUES " + ",".join(f"('{p.value}')" for p in FaultPoint) + ") t(point)")
def _store_faults(spark, d):
    """Each fault point hit once while the nations are written; reopened, the store holds all that was acknowledged."""
    changes, out = nation_changes(nations(spark, d)), []
    for point in FaultPoint:
        folder, model, doubt = scratch(spark), {}, None
        options = Options(flush_threshold=20, l0_compaction_threshold=2, fault=Fault(point, 1))
        try:
            with Store.open(spark, folder, options) as store:
                for doubt in changes:
                    key, value = doubt
                    store.delete(key) if value is None else store.set(key, value)
                    model[key] = value
                doubt = None
        except InjectedFault:
            pass
        with Store.open(spark, folder) as store:
            held = {r["key"]: r["value"] for r in store.scan().collect()}
        live = {k: v for k, v in model.items() if v is not None}
        after = dict(model, **({doubt[0]: doubt[1]} if doubt else {}))
        out.append((point.value, held in (live, {k: v for k, v in after.items() if v is not None})))
    return spark.createDataFrame(out, "point string, recovered boolean")
