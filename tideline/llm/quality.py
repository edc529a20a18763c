"""Quality rules: base counts, and cross-document line frequency per host.

A line is normalised (lower case, runs of digits and white space become one space, trimmed)
and hashed. Per host (`source`), the distinct documents that hold it are counted; documents
of equal text count once. A line in more than max(MIN_DOCS, MAX_SHARE of the host's distinct
documents) is removed, and a document that keeps less than MIN_LEFT of its words is depleted
and rejected. Lines without a word never count.

Scale: a text is read once; what the rest needs (line hashes, word counts) is written to the
shared folder. Line counts are pre-aggregated before each shuffle. The join with frequent
lines is on (host, hash): Spark broadcasts them only if their measured size is small, else
AQE splits the hot keys of the larger side.

Defined cases: null text counts as empty and fails the base rule; a null source is the host
''; rows with equal doc_id are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, known_id
from tideline.llm.exprs import SPACE, WORD, let, repeated_words, words

MIN_DOCS, MAX_SHARE, MIN_LEFT = 20, 0.05, 0.2
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = r"[^#*$%&|<>]+"


def line_hash(line):
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), r"[0-9\x20\x09-\x0D]+", " ")))


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, a digest of its text, hashes and word counts of its lines."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("host"), text.alias("text"), words(text).alias("w"), lines.alias("l"))
    base = base.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("digest"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.transform("l", lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"))).alias("lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return base.withColumn("base_failed", failed).withColumn("row", F.monotonically_increasing_id())


def frequent_lines(measured: DataFrame) -> DataFrame:
    """(host, h) of the lines above their host's limit."""
    seen = measured.select("host", "digest", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    held = seen.distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > MIN_DOCS)
    hosts = measured.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("n_docs"))
    return held.join(hosts, "host").where(F.col("n") > MAX_SHARE * F.col("n_docs")).select("host", "h")


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, kept, n_removed_words and the removed line hashes of each document."""
    measured = cut(measure(docs))
    hits = measured.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.h", "x.n").join(frequent_lines(measured), ["host", "h"])
    lost = hits.groupBy("row").agg(F.sum("n").alias("lost"), F.collect_set("h").alias("removed"))
    out = measured.drop("lines").join(lost, "row", "left")
    out = out.withColumn("n_removed_words", F.coalesce("lost", F.lit(0)).cast("long"))
    enough = F.col("n_words") - F.col("n_removed_words") >= F.lit(MIN_LEFT) * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & enough).drop("row", "lost")


def quality(docs: DataFrame) -> DataFrame:
    return judge(docs).drop("removed", "digest", "host")


def clean(docs: DataFrame) -> DataFrame:
    """Documents that pass, without their lines above the limits; columns as in docs."""
    keys = ["__tl_id", "__tl_digest", "__tl_host"]
    verdict = judge(docs).where("kept").select(known_id().alias(keys[0]), F.col("digest").alias(keys[1]), F.col("host").alias(keys[2]), F.col("removed").alias("__tl_removed")).dropDuplicates(keys)
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("__tl_removed", line_hash(x)))
    text = F.when(F.size("__tl_removed") > 0, F.array_join(lines, "\n")).otherwise(F.col("text"))
    keyed = docs.withColumns({keys[0]: known_id(), keys[1]: F.xxhash64(F.coalesce("text", F.lit(""))), keys[2]: F.coalesce("source", F.lit(""))})
    joined = keyed.join(verdict, keys).withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, host, text, x, trim(regexp_replace(lower(x), '[0-9\x20\x09-\x0D]+', ' ', 'g')) AS h, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
       FROM (SELECT doc_id, host, text, unnest(l) AS x FROM w)),
hosts AS (SELECT host, count(DISTINCT text) AS n_docs FROM d GROUP BY host),
freq AS (SELECT ln.host, h FROM ln JOIN hosts USING (host) GROUP BY ln.host, h, n_docs HAVING count(DISTINCT text) > {MIN_DOCS} AND count(DISTINCT text) > {MAX_SHARE} * n_docs),
lost AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM ln JOIN freq USING (host, h) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
       NOT base_failed AND n_words - n_removed_words >= {MIN_LEFT} * n_words AS kept FROM f
"""
