"""Benchmark decontamination by spaced-seed hashing.

Tokens are words after ASCII punctuation becomes white space, A-Z lowered. Each fixed mask
covers a few positions of a token window and ignores the rest, so a substituted token in an
ignored position leaves the hash equal. Test hashes are joined with training hashes; around
each hit the two token sequences are aligned and the best segment (match +1, mismatch -2) is
taken. It counts if at least MIN_MATCHED tokens agree (all but MAX_MISSES of a shorter item)
and they are at least MIN_IDENTITY of the segment.

Scale: the benchmark is the stated query set. It is read in blocks of about BLOCK_WORDS words,
whose number follows its measured size; each block's sorted hashes are broadcast and joined
with all documents as they are scanned, one block after the other. Equal hashes are reduced to
(document, item, shift) in pieces of HITS pairs, so repetitive texts do not multiply in memory.
Documents are never shuffled by text; only hits are, which are few.

Defined cases: null or empty text has no hit; equal items count as one, named by the smallest
item_id; items without item_id are left out, as nothing could name them; an item shorter than
the shortest mask must occur as a whole; rows with equal doc_id, or without one, are judged one
by one; texts of any length are taken whole; empty tables give no hit; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import GOLDEN, blocks, cut, mix, runs, texts_of, word_hashes
from tideline.session import ship

MASKS = ("1110110111", "1101110011", "1011001111011")
MIN_MATCHED, MAX_MISSES, MIN_IDENTITY = 10, 1, 0.75
BLOCK_WORDS = 1_000_000
PUNCTUATION = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))
TABLE_BITS = 22
#: Pairs of positions held at once while hits are reduced to shifts.
HITS = 1_000_000


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([x.translate(PUNCTUATION) for x in texts])


def seeds(words: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per mask: positions at which it fits (left: tokens to the document's end) and their hashes."""
    out = []
    for m, mask in enumerate(MASKS):
        n = len(words) - len(mask) + 1
        if n <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            continue
        h = np.full(n, m + 1, np.uint64)
        key = int(GOLDEN)
        for j, bit in enumerate(mask):
            if bit == "1":
                key = key * 0xD1342543DE82EF95 + 1 & (2**64 - 1)
                h += words[j : j + n] * np.uint64(key | 1)
        at = np.flatnonzero(left[:n] >= len(mask))
        out.append((at, mix(h[at])))
    return out


def remaining(counts: np.ndarray) -> np.ndarray:
    """For each token, the tokens from it to its document's end, itself included."""
    ends = np.repeat(np.cumsum(counts), counts)
    return ends - np.arange(len(ends))


class Benchmark:
    """Sorted seed hashes of a block of items, and their tokens."""

    def __init__(self, items: list[tuple[int, str]]):
        first: dict[bytes, int] = {}
        for item, text in sorted(items):
            first.setdefault(text.encode(), item)
        self.ids = np.array(list(first.values()), np.int64)
        self.words, counts = tokens(list(first))
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.owner = np.repeat(np.arange(len(counts)), counts)
        hashes, places = [], []
        for at, h in seeds(self.words, remaining(counts)):
            hashes.append(h)
            places.append(at)
        shortest = min(map(len, MASKS))
        for k in np.flatnonzero((counts > 0) & (counts < shortest)):
            hashes.append(whole(self.words[self.starts[k] : self.ends[k]]))
            places.append(np.array([self.starts[k]]))
        self.short = sorted({int(n) for n in counts if 0 < n < shortest})
        h, at = np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(places or [np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        self.hashes, self.places = h[order], at[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def hits(self, at: np.ndarray, h: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
        """(document, item, shift) of equal hashes, each once; built in pieces of HITS pairs."""
        likely = self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        at, h = at[likely], h[likely]
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        out, start, ends = np.zeros((0, 3), np.int64), 0, np.cumsum(n)
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HITS, "right")))
            m = n[start:stop]
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            places, spots = self.places[np.repeat(lo[start:stop], m) + inner], np.repeat(at[start:stop], m)
            found = np.stack([np.searchsorted(doc_ends, spots, "right"), self.owner[places], spots - places], axis=1)
            out, start = distinct_rows(np.concatenate([out, distinct_rows(found)])), stop
        return out

    def match(self, words: np.ndarray, start: int, end: int, item: int, shifts: np.ndarray):
        """(first token, end token, matched) of the accepted alignment of an item and a document that matches most."""
        a, b, best = self.starts[item], self.ends[item], None
        for shift in shifts.tolist():
            lo, hi = max(a, start - shift), min(b, end - shift)
            if best is not None and hi - lo <= best[2]:
                continue
            same = self.words[lo:hi] == words[lo + shift : hi + shift]
            score = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
            gain = score - np.minimum.accumulate(score)
            stop = int(np.argmax(gain))
            first = stop - int(np.argmin(score[: stop + 1][::-1]))
            matched = int(same[first:stop].sum())
            if matched >= min(MIN_MATCHED, max(1, b - a - MAX_MISSES)) and matched >= MIN_IDENTITY * (stop - first) and (best is None or matched > best[2]):
                best = (int(lo + shift - start + first), int(lo + shift - start + stop), matched)
        return best


def distinct_rows(rows: np.ndarray) -> np.ndarray:
    """The rows in order, each once."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new]


def whole(words: np.ndarray) -> np.ndarray:
    """Hash of each full run, for items shorter than any mask."""
    return mix(np.array([sum(int(w) * (2 * j + 3) for j, w in enumerate(words)) + len(words) & (2**64 - 1)], np.uint64))


def text_key():
    """Tells texts of a doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _block_leaks(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        bench = Benchmark(held.value)
        for batch in batches:
            ids, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))
            rows = []
            for x, y in blocks(texts, 1 << 20):
                words, counts = tokens(texts[x:y])
                ends, left = np.cumsum(counts), remaining(counts)
                found = [bench.hits(at, h, ends) for at, h in seeds(words, left)]
                for n in bench.short:
                    at = np.flatnonzero(left >= n)
                    h = np.full(len(at), n, np.uint64)
                    for j in range(n):
                        h += words[at + j] * np.uint64(2 * j + 3)
                    found.append(bench.hits(at, mix(h), ends))
                found = distinct_rows(np.concatenate(found))
                for lo, hi in runs(found[:, 0] * len(bench.ids) + found[:, 1]):
                    d, item, _ = found[lo]
                    best = bench.match(words, int(ends[d] - counts[d]), int(ends[d]), item, found[lo:hi, 2])
                    if best:
                        rows.append((ids[x + d], keys[x + d], int(bench.ids[item]), *best))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_key", "item_id", "first", "last", "matched"])

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, item_id long, first long, last long, matched long")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, first, last, matched): the best accepted overlap of each text and
    item, in token positions, end exclusive."""
    ship(docs.sparkSession)
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    n_blocks, out = 1 + total // BLOCK_WORDS, None
    for b in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b)
        part = _block_leaks(docs, [(r[0], r[1]) for r in block.collect()])
        if n_blocks > 1:
            part = cut(part)  # so that the driver holds one block at a time
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: contaminated, n_items, most matched tokens, and the matched item ids."""
    found = leaks(docs, benchmark).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("matched").alias("matched"))
    found = found.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_key", "hit_key")
    out = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"))
    out = out.join(found, (F.col("text_key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("matched", F.lit(0)).cast("long").alias("n_matched"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows without an accepted overlap, columns as given; each row is judged by its own text."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("__tl_hit"), F.col("text_key").alias("__tl_hit_key")).distinct()
    keyed = docs.withColumn("__tl_key", text_key())
    return keyed.join(bad, (F.col("__tl_key") == F.col("__tl_hit_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__tl_hit")), "left_anti").select(*docs.columns)
