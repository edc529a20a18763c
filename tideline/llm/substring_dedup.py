"""Exact substring deduplication by prefix-free parsing.

Removed is each byte covered by a SPAN-byte string that also starts in a document with a
smaller doc_id. Documents are UTF-8 bytes; strings never cross documents.

Parsing. The trigger of a SPAN-byte window is the smallest rolling hash of its GRAM-byte
substrings, so it depends on the window's bytes alone. A phrase is a maximal run of windows
with the same trigger, consecutive phrases overlap by SPAN - 1 bytes, and each window of a
document lies in exactly one phrase. Equal windows have equal triggers, so only phrases of
equal trigger need to be ordered against each other.

Order. A window is the SPAN-byte prefix of a phrase's suffix; its place in corpus order is
settled by the suffix array of the phrase dictionary, and the parse decides no tie, because
windows never reach past their phrase.

1. parse: each group of documents sends its distinct (trigger, phrase hash) with the smallest
   doc_id to the bucket of the trigger, as packed arrays.
2. dictionary: a bucket sorts them. A phrase that occurs in an earlier document is repeated in
   whole. A phrase first seen here, whose trigger has other phrases, may be repeated in part:
   the document that holds its first occurrence is asked for its bytes.
3. suffixes: buckets sort the suffixes of the asked phrases (SPAN bytes deep) and return, for
   each, the window ranges that start in an earlier document.
4. the groups turn both answers into removed bytes.

A passage of between GRAM and SPAN bytes that many documents hold within different text gives
one trigger a distinct phrase in each of them. A first pass finds such hot triggers; their
windows become phrases of their own, triggered by a hash of all their bytes, so that they
spread over all buckets and need no suffixes: equal ones are equal as a whole.

Scale: groups are hashed by doc_id to about GROUP_BYTES each, so a hot passage is sent once
by each group however many documents hold it, and no pairs are formed. Texts are shuffled
once; that exchange is reused by all passes. Groups and buckets grow in number with the
corpus, not in size, but for 16 bytes a group for each phrase that all groups hold; a task
holds one of them at a time; a single larger document is parsed in pieces. A lost executor
costs the recomputation of its partitions.

Phrase identity is 32 bits of the trigger, the bucket and 64 bits of the phrase's hash.

Defined cases: null text is empty: nothing removed, sha256 of no bytes; text shorter than
SPAN bytes is kept; rows of equal doc_id are one document number and never remove each other,
and so are rows without doc_id, which come after all others (a doc_id of 2^63 - 1 is level with
them); texts of any length are taken whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import CHUNK, blocks, hash_ranges, known_id, mix, powers, prefix_hash, runs, texts_of
from tideline.session import ship

SPAN, GRAM = 50, 26
WINDOW = SPAN - GRAM + 1
#: Text of a group of documents and of a task's groups, and the text whose phrases make a bucket.
GROUP_BYTES, TASK_BYTES, BUCKET_BYTES = 4_000_000, 6_000_000, 12_000_000
NONE = np.uint64(0)
#: A trigger with more distinct phrases is hot, once a group holds LOCAL of them; at most MAX_HOT are.
HOT_PHRASES, LOCAL, MAX_HOT = 20_000, 8, 500_000


class Parse:
    """Phrases of a list of documents: trigger, hash, first window, windows and document of each.

    Windows whose trigger is among `hot` (sorted) are triggered by a hash of their own bytes.
    """

    def __init__(self, docs: list[bytes], hot: np.ndarray | None = None):
        lengths = np.array([len(d) for d in docs], np.int64)
        self.data = b"".join(docs)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        windows = len(self.data) - SPAN + 1
        if windows <= 0:
            self.trigger, self.hash, self.first, self.count, self.doc = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
            return
        buffer = np.frombuffer(self.data, np.uint8)
        cuts, triggers, last = [], [], None
        for at in range(0, windows, CHUNK):
            stop = min(windows, at + CHUNK)
            p = prefix_hash(buffer[at : stop + SPAN - 1])
            h = mix((p[GRAM:] - p[:-GRAM]) * powers(len(p), True)[: len(p) - GRAM])
            low, width = h, 1
            while width < WINDOW:
                step = min(width, WINDOW - width)
                low = np.minimum(low[:-step], low[step:])
                width += step
            low |= np.uint64(1)  # 0 marks windows that cross documents
            if hot is not None and len(hot):
                k = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low)
                low[k] = hash_ranges(self.data[at : stop + SPAN - 1], k, k + SPAN) | np.uint64(1)
            a, b = np.searchsorted(self.ends, at - SPAN, "right"), np.searchsorted(self.starts, stop, "left")
            for k in range(a, b):
                low[max(0, self.ends[k] - SPAN + 1 - at) : max(0, min(stop, self.ends[k]) - at)] = NONE
            new = np.empty(stop - at, bool)
            new[1:] = low[1:] != low[:-1]
            new[0] = last is None or low[0] != last
            edge = self.starts[a:b]
            new[edge[(edge >= at) & (edge < stop)] - at] = True
            where = np.flatnonzero(new)
            cuts.append(where + at)
            triggers.append(low[where])
            last = low[-1]
        first, trigger = np.concatenate(cuts), np.concatenate(triggers)
        count = np.diff(np.append(first, windows))
        valid = trigger != NONE
        self.trigger, self.first, self.count = trigger[valid], first[valid], count[valid]
        self.hash = hash_ranges(self.data, self.first, self.first + self.count + SPAN - 1)
        self.doc = np.searchsorted(self.ends, self.first, "right")

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.first[k] : self.first[k] + self.count[k] + SPAN - 1]


def bucket_of(trigger: np.ndarray, buckets: int) -> np.ndarray:
    return ((trigger >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def short(trigger: np.ndarray) -> np.ndarray:
    return (trigger & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def distinct(parse: Parse, ids: np.ndarray, buckets: int):
    """Distinct phrases of a group in the order of bucket, trigger and hash: representative phrase, and smallest doc_id."""
    bucket, t = bucket_of(parse.trigger, buckets), short(parse.trigger)
    owner = ids[parse.doc]
    order = np.lexsort((owner, parse.hash, t, bucket))
    b, t, h = bucket[order], t[order], parse.hash[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return order[new], entry


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def narrow(ids: np.ndarray) -> tuple[bytes, int]:
    if len(ids) and 0 <= ids.min() and ids.max() < 2**32:
        return pack(ids.astype(np.uint32)), 4
    return pack(ids), 8


def unpack_ids(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if width == 4 else np.int64).astype(np.int64)


def texts_and_ids(pdf: pd.DataFrame) -> tuple[list[bytes], np.ndarray]:
    return [bytes(x) if x is not None else b"" for x in pdf["data"]], pdf["doc_id"].to_numpy(np.int64)


def hot_triggers(docs: DataFrame, total: int) -> np.ndarray:
    """Sorted triggers with so many distinct phrases that one bucket should not hold them."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in blocks(texts, GROUP_BYTES):
                parse = Parse(texts[a:b])
                order = np.lexsort((parse.hash, parse.trigger))
                t, h = parse.trigger[order], parse.hash[order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
                values, n = np.unique(t[new], return_counts=True)
                many = n >= LOCAL
                yield pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(n[many])], ["trigger", "n"])

    limit = max(HOT_PHRASES, total // (WINDOW // 2) // MAX_HOT)
    counted = docs.select("text").mapInArrow(run, "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > limit).select("trigger").toPandas()["trigger"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def message_rows(pdf: pd.DataFrame, buckets: int, hot: np.ndarray) -> pd.DataFrame:
    docs, ids = texts_and_ids(pdf)
    parse = Parse(docs, hot)
    rep, _ = distinct(parse, ids, buckets)
    b = bucket_of(parse.trigger[rep], buckets)
    grp = int(pdf["grp"].iloc[0])
    rows = []
    for lo, hi in runs(b):
        own = rep[lo:hi]
        owners, width = narrow(ids[parse.doc[own]])
        rows.append((int(b[lo]), grp, pack(short(parse.trigger[own])), pack(parse.hash[own]), owners, width))
    return pd.DataFrame(rows, columns=["bucket", "grp", "triggers", "hashes", "owners", "width"])


MESSAGE = "bucket long, grp long, triggers binary, hashes binary, owners binary, width int"
#: repeated: per distinct phrase of the group, the smallest doc_id that holds it, if some other group has a smaller one.
#: asked: positions of phrases whose bytes are wanted. Both count within the group's message to the bucket.
ANSWER = "grp long, kind int, bucket long, positions binary, values binary"


def dictionary(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 2 for one bucket."""
    sizes = np.array([len(x) // 4 for x in pdf["triggers"]])
    t = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["triggers"]])
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]])
    owner = np.concatenate([unpack_ids(x, w) for x, w in zip(pdf["owners"], pdf["width"], strict=True)])
    source = np.repeat(np.arange(len(sizes)), sizes)
    position = np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((owner, h, t))
    t, h, owner, source, position = t[order], h[order], owner[order], source[order], position[order]
    new_trigger = np.ones(len(t), bool)
    new_trigger[1:] = t[1:] != t[:-1]
    new_phrase = new_trigger.copy()
    new_phrase[1:] |= h[1:] != h[:-1]
    heads = np.flatnonzero(new_phrase)
    first = owner[heads][np.cumsum(new_phrase) - 1]
    group = np.cumsum(new_trigger) - 1
    several = np.bincount(group[heads])[group] > 1
    repeated = first < owner
    asked = new_phrase & several
    rows = []
    by_source = np.argsort(source, kind="stable")
    ends = np.cumsum(sizes)
    for k, (lo, hi) in enumerate(zip(ends - sizes, ends, strict=True)):
        mine = by_source[lo:hi]
        r, a = mine[repeated[mine]], mine[asked[mine]]
        grp, bucket = int(pdf["grp"].iloc[k]), int(pdf["bucket"].iloc[k])
        if len(r):
            rows.append((grp, 0, bucket, pack(position[r].astype(np.int32)), pack(first[r])))
        if len(a):
            rows.append((grp, 1, bucket, pack(position[a].astype(np.int32)), b""))
    return pd.DataFrame(rows, columns=["grp", "kind", "bucket", "positions", "values"])


REQUEST = "kind int, key long, grp long, bucket long, positions binary, values binary, owners binary, lengths binary"


def answered(parse: Parse, ids: np.ndarray, buckets: int, answers: pd.DataFrame):
    """The distinct phrases of a group, and for each answer row the entries that its positions mean."""
    rep, entry = distinct(parse, ids, buckets)
    b = bucket_of(parse.trigger[rep], buckets)
    starts = np.searchsorted(b, answers["bucket"].to_numpy(np.int64), "left")
    found = [s + np.frombuffer(x, np.int32) for s, x in zip(starts, answers["positions"], strict=True)]
    return rep, entry, found


def phrase_rows(left: pd.DataFrame, right: pd.DataFrame, buckets: int, hot: np.ndarray) -> pd.DataFrame:
    """Step 3 for one group: bytes of the asked phrases, and the other answers passed on."""
    rows = []
    if len(left):
        docs, ids = texts_and_ids(left)
        parse = Parse(docs, hot) if (right["kind"] == 1).any() else None
        found = answered(parse, ids, buckets, right) if parse is not None else None
        for k, (grp, kind, bucket, positions, values) in enumerate(right[["grp", "kind", "bucket", "positions", "values"]].itertuples(index=False)):
            if kind == 0:
                rows.append((0, grp, grp, bucket, positions, values, b"", b""))
                continue
            own = found[0][found[2][k]]
            data = [parse.bytes_of(x) for x in own]
            rows.append((1, bucket, grp, bucket, positions, b"".join(data), pack(ids[parse.doc[own]]), pack(np.array([len(x) for x in data], np.int64))))
    return pd.DataFrame(rows, columns=["kind", "key", "grp", "bucket", "positions", "values", "owners", "lengths"])


def suffix_ranges(data: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, from, to) of window ranges that also start in a phrase of an earlier document.

    The suffixes of all phrases that hold SPAN bytes are sorted by those bytes; in each run
    of equal ones the smallest owner is the first occurrence.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = lengths - SPAN + 1
    phrase = np.repeat(np.arange(len(n)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = starts[phrase] + inner
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = []
    for offset in (0, 8, 16, 24, 32, 40):
        word = np.zeros(len(at), np.uint64)
        for j in range(8):
            word = (word << np.uint64(8)) | padded[at + offset + j]
        keys.append(word)
    keys.append((padded[at + 48].astype(np.uint64) << np.uint64(8)) | padded[at + 49])
    owner = owners[phrase]
    order = np.lexsort((owner, *keys[::-1]))
    new = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        sorted_key = key[order]
        same &= sorted_key[1:] == sorted_key[:-1]
    new[1:] = ~same
    first = owner[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else owner
    hit = np.zeros(len(order), bool)
    hit[order] = first < owner[order]
    edge = hit & np.concatenate([[True], ~hit[:-1] | (phrase[1:] != phrase[:-1])]) if len(hit) else hit
    stop = hit & np.concatenate([~hit[1:] | (phrase[1:] != phrase[:-1]), [True]]) if len(hit) else hit
    a, b = np.flatnonzero(edge), np.flatnonzero(stop)
    return phrase[a], inner[a], inner[b] + 1


def suffixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 3 for one key: kind 0 passes, kind 1 is a bucket of asked phrases."""
    columns = ["grp", "kind", "bucket", "positions", "values"]
    if pdf["kind"].iloc[0] == 0:
        return pdf[columns]
    lengths = [np.frombuffer(x, np.int64) for x in pdf["lengths"]]
    sizes = np.array([len(x) for x in lengths])
    owners = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["owners"]])
    data = np.frombuffer(b"".join(pdf["values"]), np.uint8)
    phrase, a, b = suffix_ranges(data, np.concatenate(lengths), owners)
    position = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["positions"]])
    source = np.repeat(np.arange(len(sizes)), sizes)[phrase]
    rows = []
    for lo, hi in runs(source):
        k = source[lo]
        rows.append((int(pdf["grp"].iloc[k]), 2, int(pdf["bucket"].iloc[k]), pack(position[phrase[lo:hi]]), pack(np.stack([a[lo:hi], b[lo:hi]]).astype(np.int64))))
    return pd.DataFrame(rows, columns=columns)


RESULT = "doc_id long, missing boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def removed_rows(left: pd.DataFrame, right: pd.DataFrame, buckets: int, hot: np.ndarray) -> pd.DataFrame:
    """Step 4 for one group."""
    columns = ["doc_id", "missing", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    if not len(left):
        return pd.DataFrame([], columns=columns)
    docs, ids = texts_and_ids(left)
    ranges: list[tuple[np.ndarray, np.ndarray]] = []
    parse = Parse(docs, hot)
    rep, entry, found = answered(parse, ids, buckets, right)
    first = ids[parse.doc[rep]].copy() if len(rep) else np.zeros(0, np.int64)  # the group's own smallest doc_id of each phrase
    for k in np.flatnonzero(right["kind"].to_numpy() == 0):
        np.minimum.at(first, found[k], np.frombuffer(right["values"].iloc[k], np.int64))
    whole = first[entry] < ids[parse.doc]
    ranges.append((parse.first[whole], parse.first[whole] + parse.count[whole] + SPAN - 1))
    by_entry = None
    for k in np.flatnonzero(right["kind"].to_numpy() == 2):
        a, b = np.frombuffer(right["values"].iloc[k], np.int64).reshape(2, -1)
        if by_entry is None:
            by_entry = np.argsort(entry, kind="stable")
            heads = np.searchsorted(entry[by_entry], np.arange(len(rep) + 1))
        # all occurrences of the phrase in the group; those in later documents are removed in whole anyway
        n = heads[found[k] + 1] - heads[found[k]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        base = parse.first[by_entry[np.repeat(heads[found[k]], n) + inner]]
        ranges.append((base + np.repeat(a, n), base + np.repeat(b, n) + SPAN - 1))
    depth = np.zeros(len(parse.data) + 1, np.int32)
    for a, b in ranges:
        np.add.at(depth, a, 1)
        np.add.at(depth, b, -1)
    gone = np.cumsum(depth[:-1]) > 0
    rows = []
    for doc, missing, data, s, e in zip(ids, left["missing"], docs, parse.starts, parse.ends, strict=True):
        g = gone[s:e]
        n = int(g.sum())
        edges = np.flatnonzero(np.diff(g.view(np.int8), prepend=np.int8(0), append=np.int8(0))) if n else np.zeros(0, np.int64)
        kept = np.frombuffer(data, np.uint8)[~g].tobytes() if n else data
        rows.append((int(doc), bool(missing), len(data), n, len(edges) // 2, hashlib.sha256(kept).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)]))
    return pd.DataFrame(rows, columns=columns)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs (also as offsets), sha256 of the rest."""
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = 1 + total // GROUP_BYTES
    # with about one and a half groups and half a bucket for each partition, few of them meet in one task
    tasks, buckets = int(1 + total // TASK_BYTES), int(1 + total // BUCKET_BYTES)
    hot = docs.sparkSession.sparkContext.broadcast(hot_triggers(docs, total))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")
    grp = F.pmod(F.xxhash64(known_id()), F.lit(groups)).alias("grp")
    left = docs.select(grp, known_id().alias("doc_id"), F.col("doc_id").isNull().alias("missing"), data).repartition(tasks, "grp")

    messages = left.groupBy("grp").applyInPandas(lambda pdf: message_rows(pdf, buckets, hot.value), MESSAGE)
    answers = messages.repartition(2 * buckets, "bucket").groupBy("bucket").applyInPandas(dictionary, ANSWER)
    asked = left.groupBy("grp").cogroup(answers.repartition(tasks, "grp").groupBy("grp")).applyInPandas(lambda a, b: phrase_rows(a, b, buckets, hot.value), REQUEST)
    final = asked.repartition(tasks + 2 * buckets, "kind", "key").groupBy("kind", "key").applyInPandas(suffixes, ANSWER)
    out = left.groupBy("grp").cogroup(final.repartition(tasks, "grp").groupBy("grp")).applyInPandas(lambda a, b: removed_rows(a, b, buckets, hot.value), RESULT)
    return out.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing")


def dedup(docs: DataFrame) -> DataFrame:
    return repeated_spans(docs).drop("spans")
