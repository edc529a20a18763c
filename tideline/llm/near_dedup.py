"""MinHash near-deduplication with SuperMinHash signatures.

A document's set is its distinct 5-word shingles (words [^\\x20\\x09-\\x0D]+, A-Z lowered);
with fewer words it is the whole sequence as one shingle. SuperMinHash gives each shingle a
random permutation of the slots and ranks that are correlated within it: slot perm[j] gets
j + uniform. A document stops as soon as every slot holds a value of a finished level. The
signature is cut in bands; documents sharing a band are candidates, which are verified on
their full shingle sets; links are grouped by union-find style star contraction.

Scale: texts equal in their sets collapse to one class before banding. Members of a bucket
meet leaders, never each other pairwise. First each document meets the one leader it shares
most buckets with. Then, in buckets that still hold several components, leaders meet members
of other components and leave the bucket, until no bucket is mixed: no link is lost to the
choice of leaders. The join that lets them meet drops pairs that cannot reach the threshold
by a bitmap of each set: an exact bound, so what it emits follows the links, not the pairs.

Defined cases: null, empty or blank text has n_shingles 0 and is linked with nothing; rows that
repeat a doc_id share a component, which holds whatever any of their texts is linked with; a row
without doc_id is a document of its own, and its component_id is null unless a document with
doc_id is in the component; texts of any length are taken whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import GOLDEN, blocks, cut, mix, passing_cuts, shingle_hashes, small_batches, texts_of, word_hashes
from tideline.llm.components import connected_components
from tideline.session import ship

WIDTH, BANDS, ROWS, THRESHOLD = 5, 32, 4, (75, 100)
SLOTS = BANDS * ROWS
EMPTY = np.uint64(2**64 - 1)
GROUP = 30_000
#: Words of the bitmap in which a set's shingles are marked.
BITMAP = 32
#: Leaders of a bucket in the first round, and how many times more in each further one.
LEADERS = 32


def superminhash(elements: np.ndarray, owner: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """(docs, slots) signatures of the sets given as hashes with their owner's number."""
    sig = np.full(docs * slots, EMPTY, np.uint64)
    filled = np.zeros(docs, bool)
    perm = None
    for j in range(slots):
        draw = mix(elements + np.uint64((j + 1) * int(GOLDEN) & (2**64 - 1)))
        rank = (np.uint64(j) << np.uint64(56)) | (draw >> np.uint64(8))
        pick = (j + (((draw * GOLDEN) >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32))).astype(np.int64)
        if j == 0:
            slot = pick
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
                perm[rows, first] = 0
                perm[:, 0] = first
            rows = np.arange(len(elements))
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig, owner * slots + slot, rank)
        filled = (sig.reshape(docs, slots) != EMPTY).all(axis=1)
        active = ~filled[owner]
        if not active.any():
            break
        if not active.all():
            elements, owner = elements[active], owner[active]
            if perm is not None:
                perm = perm[active]
        if j == 0:
            rows, first = np.arange(len(elements)), pick[active]
    return sig.reshape(docs, slots)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    return [np.unique(shingle_hashes(words[e - n : e], WIDTH)) for e, n in zip(ends, counts, strict=True)]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands): the set's size, its 128-bit digest, band hashes."""

    def run(batches):
        keys = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
        salt = mix(np.arange(100, 100 + BANDS, dtype=np.uint64))
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for a, b in blocks(texts, 1 << 20):
                sets = shingle_sets(texts[a:b])
                sizes = np.array([len(s) for s in sets])
                sig = np.full((len(sets), SLOTS), EMPTY, np.uint64)
                start = 0
                while start < len(sets):
                    stop, total = start + 1, sizes[start]
                    while stop < len(sets) and total + sizes[stop] <= GROUP:
                        total += sizes[stop]
                        stop += 1
                    if total:
                        own = np.repeat(np.arange(stop - start), sizes[start:stop])
                        sig[start:stop] = superminhash(np.concatenate(sets[start:stop]), own, stop - start)
                    start = stop
                band = mix((sig.reshape(-1, BANDS, ROWS) * keys).sum(axis=2, dtype=np.uint64) + salt)
                values = pa.array(band.ravel().view(np.int64))
                offsets = pa.array(np.arange(0, band.size + 1, BANDS, dtype=np.int32))
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "n_shingles", "set_id", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, bands array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """(set_id, shingles, bits): the sorted set as packed 64-bit hashes, and its bitmap."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in blocks(texts, 1 << 20):
                sets = shingle_sets(texts[a:b])
                marks = np.zeros((len(sets), 64 * BITMAP), np.uint8)
                for k, s in enumerate(sets):
                    marks[k, (s % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
                bits = np.packbits(marks, axis=1).view(np.int64)
                offsets = pa.array(np.arange(0, bits.size + 1, BITMAP, dtype=np.int32))
                packed = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in packed], pa.binary()), pa.array(packed, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bits.ravel()))], ["set_id", "shingles", "bits"])

    return docs.select("text").mapInArrow(run, "set_id binary, shingles binary, bits array<long>")


def _confirmed(pairs: DataFrame) -> DataFrame:
    """Keeps pairs (a, b, set_a, set_b) whose full sets reach the threshold."""
    part, whole = THRESHOLD[1], THRESHOLD[0]

    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(part * both >= whole * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return cut(_confirmed(pairs.join(left, "a").join(right, "b")))


def _words(bits: str, to: str = "w") -> list[Column]:
    """The bitmap's words as columns, and how many bits are set."""
    words = [F.coalesce(F.get(F.col(bits), F.lit(k)), F.lit(0).cast("long")) for k in range(BITMAP)]
    return [*(x.alias(f"{to}{k}") for k, x in enumerate(words)), sum((F.bit_count(x) for x in words), F.lit(0)).alias(f"{to}_set")]


def _may_reach(n: str, own: str, m: str, other: str) -> Column:
    """Whether sets of n and m elements may reach the threshold, by their bitmaps.

    Each bit of one set that the other lacks stands for an element that is not shared.
    """
    both = sum((F.bit_count(F.col(f"{own}{k}").bitwiseAND(F.col(f"{other}{k}"))) for k in range(BITMAP)), F.lit(0))
    shared = both + F.least(F.col(n) - F.col(f"{own}_set"), F.col(m) - F.col(f"{other}_set"))
    return shared * sum(THRESHOLD) >= (F.col(n) + F.col(m)) * THRESHOLD[0]


def _joined_components(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links; only the components that links tie are contracted."""
    if comp is None:
        return cut(connected_components(links))
    name = lambda end: links.select("a", "b").join(comp.select(F.col("node").alias(end), F.col("component").alias("c")), end, "left").select("a", "b", F.coalesce("c", end).alias(f"c{end}"))
    ties = name("a").join(comp.select(F.col("node").alias("b"), F.col("component").alias("c")), "b", "left").select(F.col("ca").alias("a"), F.coalesce("c", "b").alias("b"))
    moved = cut(connected_components(ties))
    old = comp.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut(old.unionByName(moved.join(comp.select("node"), "node", "left_anti")))


def _labelled(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members with their component as it is now."""
    named = members.drop("comp").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return named.withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, with their number."""
    buckets = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("bucket", "size")
    return members.drop("size").join(buckets, "bucket")


def group_near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs."""
    spark = docs.sparkSession
    ship(spark)
    with small_batches(spark), passing_cuts(spark):
        return cut(_grouped(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), result=True)


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, group, component_id): group names a component, null without a set."""
    marks = cut(signatures(docs))
    # equal sets are one node, whatever documents hold them
    nodes = cut(marks.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    entries = nodes.select(F.col("node").alias("rep"), "n_shingles", F.posexplode("bands").alias("band", "h")).select("rep", "n_shingles", F.xxhash64("band", "h").alias("bucket"))
    leaders = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where("n > 1").select("bucket", "leader")
    members = cut(entries.join(leaders, "bucket"))
    involved = cut(nodes.select("node", "set_id", "least").join(members.select(F.col("rep").alias("node")).distinct(), "node", "left_semi"))
    # documents without doc_id pass with any that could be theirs; the sets decide
    rank = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias("rank")
    texts = docs.select(rank("doc_id"), "text").join(involved.select(rank("least")).distinct(), "rank", "left_semi")
    sets = cut(sets_of(texts).join(involved.select("set_id", "node"), "set_id").select("node", "shingles", "bits").dropDuplicates(["node"]))
    # texts under one doc_id are tied
    held = marks.where("n_shingles > 0 AND doc_id IS NOT NULL").join(nodes.select("set_id", "node"), "set_id").select("doc_id", "node")
    several = held.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b <> top").select("doc_id", "b")
    ties = held.join(several, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    # first, each node meets the leader that it shares most buckets with
    best = members.where("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("n")).groupBy("rep").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("b")).withColumnRenamed("rep", "a")
    comp = _joined_components(None, _links(best, sets).unionByName(ties))
    members = cut(_mixed(_labelled(members.drop("leader"), comp)).join(sets.select(F.col("node").alias("rep"), *_words("bits")), "rep"))
    per_bucket = LEADERS
    while not members.isEmpty():
        # the next leaders meet the rest of their bucket and leave it
        order = F.xxhash64("rep", F.lit(per_bucket))
        drawn = members.withColumns({"more": (F.pmod(order, F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / per_bucket))) == 0)})
        least = members.groupBy("bucket").agg(F.min_by("rep", F.struct(order, "rep")).alias("rep")).withColumn("least", F.lit(True))
        chosen = cut(drawn.join(least, ["bucket", "rep"], "left").where("more OR least").select("bucket", F.col("rep").alias("leader"), F.col("comp").alias("lcomp"), F.col("n_shingles").alias("ln"), *(F.col(f"w{k}").alias(f"l{k}") for k in (*range(BITMAP), "_set"))))
        possible = (F.col("comp") != F.col("lcomp")) & _may_reach("n_shingles", "w", "ln", "l")
        met = members.join(chosen, (members["bucket"] == chosen["bucket"]) & possible).select(F.greatest("rep", "leader").alias("a"), F.least("rep", "leader").alias("b")).distinct()
        found = _links(met, sets)
        rest = members.join(chosen.select("bucket", F.col("leader").alias("rep")), ["bucket", "rep"], "left_anti")
        if not found.isEmpty():
            comp = _joined_components(comp, found)
            rest = _labelled(rest, comp)
        members = cut(_mixed(rest))
        per_bucket *= LEADERS
    labelled = nodes.select("set_id", "node", "least").join(comp, "node", "left").select("set_id", "least", F.coalesce("component", "node").alias("group"))
    smallest = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    full = marks.select("doc_id", "n_shingles", "set_id").join(labelled.join(smallest, "group").select("set_id", "group", "component_id"), "set_id", "left")
    # rows without words belong to the other texts of their doc_id, if there are any
    alone = full.where("n_shingles = 0").select("doc_id", "n_shingles", "set_id")
    own = full.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("group").alias("group"), F.min("component_id").alias("component_id"))
    blank = alone.join(own, "doc_id", "left").select("doc_id", "n_shingles", "set_id", "group", F.coalesce("component_id", "doc_id").alias("component_id"))
    return full.where("n_shingles > 0").select(*blank.columns).unionByName(blank)


def clean(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest doc_id; columns as in docs.

    Rows that repeat a doc_id are one document, of which one row stays. Of a group without any
    doc_id one row stays too; rows without doc_id and without words all stay.
    """
    spark = docs.sparkSession
    ship(spark)
    with small_batches(spark), passing_cuts(spark):
        grouped = cut(_grouped(docs), result=True)
        kept = grouped.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__tl_id")).agg(F.count("*").alias("__tl_n"))
        rows = docs.withColumn("__tl_id", F.col("doc_id").cast("long")).join(kept, "__tl_id")
        single, repeated = rows.where("__tl_n = 1"), rows.where("__tl_n > 1").dropDuplicates(["__tl_id"])
        out = single.unionByName(repeated).select(*docs.columns)
        nameless = grouped.where("doc_id IS NULL AND component_id IS NULL")
        if not nameless.isEmpty():
            missing = docs.where("doc_id IS NULL")
            marked = _set_ids(missing).join(nameless.select(F.col("set_id").alias("__tl_set"), F.col("group").alias("__tl_group")).distinct(), "__tl_set")
            lone, tied = marked.where("__tl_group IS NULL"), marked.where("__tl_group IS NOT NULL").dropDuplicates(["__tl_group"])
            out = out.unionByName(lone.unionByName(tied).select(*docs.columns))
        return out


def _set_ids(docs: DataFrame) -> DataFrame:
    """docs with __tl_set, the digest of a text's set."""

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh3_128_digest(shingle_sets([(t or "").encode()])[0].tobytes()) for t in texts], dtype=object)

    return docs.withColumn("__tl_set", digest("text"))
