"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased, everything but letters becomes a space; n-grams of 1 to 3
characters are hashed to 2^BITS features. Weights are (1 + log tf) * idf, length 1. The
model is trained with follow-the-regularised-leader (per-coordinate rates, L1 and L2), then
a temperature is fitted on rows the weights have not seen.

Training rows have a non-null lang and crc32(doc_id as text) mod 3 <> 1. Document frequencies
count all of them, by partial sums per task. The weights are fitted on a bounded sample: of
each language at most about SAMPLE_PER_LANG rows, those first in a hashed order, and about
SAMPLE_BYTES bytes of text in all. A prediction reads the text only.

Scale: two passes over the texts, no shuffle of texts. What reaches the driver are features,
bounded by the two parameters and by 2^BITS a row, and 2^BITS counts.

Defined cases: texts of any length are taken whole; an empty table gives no rows; null text, or text without a letter, is `und` with score 0; without training
rows every text is `und`; a row without doc_id is not held out, and never learned from; rows
with equal doc_id are judged one by one; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import ship


BITS, GRAMS = 15, (1, 2, 3)
SAMPLE_PER_LANG, SAMPLE_BYTES = 1000, 24_000_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 2e-3, 1e-3, 3
HELD_OUT = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) = 1"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Per code point: itself if a letter, else a space."""
    if not _letters:
        points = np.arange(0x110000, dtype=np.uint32)
        is_letter = np.fromiter((chr(i).isalpha() if i < 0xD800 or i > 0xDFFF else False for i in range(0x110000)), bool, 0x110000)
        _letters.append(np.where(is_letter, points, np.uint32(32)))
    return _letters[0]


#: Characters worked on at once; results do not depend on it.
PIECE = 1 << 18


def counts_of(text: str, out: np.ndarray) -> bool:
    """Adds a text's n-gram counts to out; whether it has a letter.

    A piece starts with the last characters of the one before, whose n-grams are not counted again.
    """
    table, letters, low = letter_table(), False, f" {text.lower()} "
    held = np.zeros(0, np.uint32)
    for at in range(0, len(low), PIECE):
        c = table[np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "replace"), np.uint32)]
        letters = letters or bool((c != 32).any())
        # squeeze runs of spaces, so that digits and marks between words leave one
        before = np.concatenate([held[-1:] if len(held) else c[:1] * 0, c[:-1]])
        c = np.concatenate([held, c[(c != 32) | (before != 32)]])
        h = np.zeros(len(c), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = (h[:m] + c[n - 1 : n - 1 + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n in GRAMS:
                new = h[max(0, len(held) - n + 1) :]
                out += np.bincount(((new + np.uint32(n)) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS), minlength=1 << BITS)
        held = c[len(c) - min(len(c), max(GRAMS) - 1) :]
    return letters


def sparse(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    counts = np.zeros(1 << BITS, np.int64)
    if not counts_of(text, counts):
        return None
    at = np.flatnonzero(counts)
    return at, counts[at]


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def document_frequency(training: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and rows holding each feature, over all training rows."""

    def run(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = sparse(text or "")
                if found:
                    df[found[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["feature", "n"])

    rows = training.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << BITS)
    n = 0
    for r in rows:
        if r["feature"] < 0:
            n = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return n, df


Example = tuple[str, np.ndarray, np.ndarray]


def sample(training: DataFrame) -> list[Example]:
    """The bounded training sample, (lang, features, counts), in a hashed order.

    Texts become features where they lie: a row that reaches the driver has 2^BITS of them at most.
    """
    sizes = {r["lang"]: (r["n"], r["bytes"]) for r in training.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    expected = sum((b or 0) * min(1.0, SAMPLE_PER_LANG / n) for n, b in sizes.values())
    shrink = min(1.0, SAMPLE_BYTES / max(expected, 1))
    shares = [(lang, min(1.0, SAMPLE_PER_LANG / n) * shrink) for lang, (n, _) in sizes.items()]
    if not shares:
        return []
    limit = F.create_map(*[F.lit(x) for pair in shares for x in pair])[F.col("lang")]
    rank = (F.xxhash64(F.lit("langid"), "doc_id").bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))

    def run(batches):
        for batch in batches:
            found = [sparse(t or "") for t in batch.column(2).to_pylist()]
            keep = pa.array([f is not None for f in found])
            found = [f for f in found if f is not None]
            at, n = ([f[k].astype(t).tobytes() for f in found] for k, t in ((0, np.uint16), (1, np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["rank", "lang", "at", "n"])

    drawn = training.withColumn("rank", rank).where(F.col("rank") < limit).select("rank", "lang", "text")
    rows = drawn.mapInArrow(run, "rank double, lang string, at binary, n binary").collect()
    ordered = sorted(rows, key=lambda r: (r["rank"], r["lang"], bytes(r["at"]), bytes(r["n"])))
    return [(r["lang"], np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.uint32).astype(np.int64)) for r in ordered]


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return weigh(at, n, self.idf) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = sparse(text) if text and self.langs else None
        if not found:
            return "und", 0.0
        p = softmax(self.logits(*found) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(min(1.0, max(0.0, p[k])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[Example], n_docs: int, df: np.ndarray) -> Model:
    """Follow-the-regularised-leader with elastic net; every tenth row calibrates the temperature."""
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    langs = sorted({lang for lang, _, _ in rows})
    number = {lang: k for k, lang in enumerate(langs)}
    data = [(number[lang], at, weigh(at, n, idf)) for lang, at, n in rows]
    k = len(langs)
    z, g2 = np.zeros(((1 << BITS) + 1, k)), np.zeros(((1 << BITS) + 1, k))

    def solve(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2))

    spared = data[::10] if len(data) >= 50 else data
    used = [x for i, x in enumerate(data) if i % 10] if len(data) >= 50 else data
    for _ in range(EPOCHS):
        for y, at, x in used:
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            w = solve(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA
            z[at] += g - sigma * w
            g2[at] += g * g
    w = solve(slice(None))
    model = Model(langs, idf, w[:-1], w[-1], 1.0)
    if spared and k:
        logits = np.stack([x @ w[at] + w[-1] for _, at, x in spared])
        truth = np.array([y for y, _, _ in spared])
        grid = np.exp(np.linspace(np.log(0.05), np.log(10), 60))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame) -> Model:
    training = docs.where(f"lang IS NOT NULL AND text IS NOT NULL AND NOT ({HELD_OUT})").select("doc_id", "lang", "text")
    n, df = document_frequency(training)
    return fit(sample(training), n, df)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches):
        model = held.value
        for batch in batches:
            out = [model.predict(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
