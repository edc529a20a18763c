"""Shared pieces of the llm operators: word hashing in numpy, durable cuts of lineage."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M1, M2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15F39CC0605CEDC835 & (2**64 - 1) | 1
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, B, B^2, ... of the polynomial hash modulo 2^64, at least n of them."""
    base = _INVERSE if inverse else _BASE
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + (1 << 12)), base, np.uint64)
        steps[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(steps)
    return have


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = B^s * hash(data[s:e]) modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * powers(len(data))[: len(data)], out=out[1:])
    return out


#: Longer ranges are hashed one by one.
LONG_RANGE = 512
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_ranges(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end].

    Eight bytes at a time go through the finalizer and are added again under a key, so that it
    is no polynomial of the bytes: no family of texts collides by its structure.
    """
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * GOLDEN + M2)
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), data + bytes(8), strides=(1,))
    at, key = np.flatnonzero((sizes > 0) & (sizes <= LONG_RANGE)), int(M1)
    offset = 0
    while len(at):
        key = key * 0xD1342543DE82EF95 + 1 & (2**64 - 1)
        left = sizes[at] - offset
        x = eight[starts[at] + offset] & _KEEP[np.minimum(left, 8)]
        out[at] = mix(out[at] ^ x) + x * np.uint64(key | 1)
        offset += 8
        at = at[left > 8]
    for k in np.flatnonzero(sizes > LONG_RANGE):
        out[k] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]], int(M1)))
    return mix(out)


_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word [^\\x20\\x09-\\x0D]+ of one chunk, A-Z lower-cased."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.diff(IS_SPACE[b].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return hash_ranges(data.translate(_LOWER), starts, ends), starts


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all docs in order, and the number of words of each.

    Works in chunks of about CHUNK bytes cut at white space, so memory beyond the result
    stays bounded however long a document is.
    """
    counts, parts, held, sizes = np.zeros(len(docs), np.int64), [], [], []

    def flush() -> None:
        if held:
            hashes, starts = hash_words(b"\n".join(held))
            parts.append(hashes)
            bounds = np.cumsum([0] + [len(x) + 1 for x in held])
            for k, n in zip(sizes, np.diff(np.searchsorted(starts, bounds)), strict=True):
                counts[k] += n
            held.clear()
            sizes.clear()

    size = 0
    for k, doc in enumerate(docs):
        at = 0
        while at < len(doc):
            end = len(doc)
            if end - at > CHUNK:
                end = at + CHUNK
                while end < len(doc) and doc[end] not in b" \t\n\x0b\x0c\r":
                    end += 1
            if held and size + end - at > CHUNK:
                flush()
                size = 0
            held.append(doc[at:end])
            sizes.append(k)
            size += end - at
            at = end
    flush()
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words in one document; fewer words make one run."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    span = min(n, width)
    out = np.full(n - span + 1, span * int(GOLDEN) & (2**64 - 1), np.uint64)
    key = _BASE
    for j in range(span):
        key = key * 0xD1342543DE82EF95 + 1 & (2**64 - 1)
        out += words[j : n - span + 1 + j] * np.uint64(key | 1)
    return mix(out)


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; a null becomes empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def blocks(docs: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of docs of about `limit` bytes each."""
    start = size = 0
    for k, doc in enumerate(docs):
        if k > start and size + len(doc) > limit:
            yield start, k
            start, size = k, 0
        size += len(doc)
    if start < len(docs):
        yield start, len(docs)


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if len(values):
        starts = np.flatnonzero(values[1:] != values[:-1]) + 1
        yield from zip([0, *starts.tolist()], [*starts.tolist(), len(values)], strict=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A temporary folder serves only where the setting is absent, as in local tests.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tideline-"))
    return folder


_local: dict[str, str] = {}


_cuts: list[list[str]] = []


def cut(df: DataFrame, result: bool = False) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: lineage ends there.

    Inside passing_cuts the table goes at its end; a result stays until that of the caller. The
    shuffle files of the write go with it: nothing reads them once the table is committed.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tideline-{uuid.uuid4().hex}"
    if len(_cuts) > result:
        _cuts[-1 - result].append(path)
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextlib.contextmanager
def passing_cuts(spark: SparkSession):
    """Deletes the tables that `cut` writes inside, but results; nothing lazy may read them later.

    Spark keeps the shuffle files of a finished query until the driver's heap is collected, which
    a small driver may put off for the whole job: what is unreachable by now goes first.
    """
    spark._jvm.System.gc()
    _cuts.append([])
    try:
        yield
    finally:
        for name in _cuts.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Takes the place of a null doc_id in comparisons: such rows come after all others.
NO_ID = 2**63 - 1


def known_id(name: str = "doc_id"):
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def listed(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of driver rows, as an expression of built-in functions."""
    each = F.explode(F.from_json(F.lit(json.dumps([list(r) for r in rows])), "array<array<string>>")).alias("r")
    names = [part.strip().split(" ") for part in schema.split(",")]
    return spark.range(1).select(each).select(*[F.get("r", F.lit(k)).cast(kind).alias(name) for k, (name, kind) in enumerate(names)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Bounds the bytes of an Arrow batch for the jobs started inside."""
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size):
        yield


def stable_unit(column, seed: str):
    """A number in [0, 1) from md5 of seed and a value's text; the same in other engines."""
    digest = F.md5(F.concat(F.lit(seed + ":"), column.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
