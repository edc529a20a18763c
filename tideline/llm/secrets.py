"""Secret scan: pattern spans, and dictionary-primed zstandard novelty.

Base spans, leftmost and non-overlapping per kind over the whole text:
assign  (password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+), keyword
        in either ASCII case, group 2 of 6 or more characters
access  AKIA[A-Z0-9]+ of 20 or more characters
hex     [0-9a-f]+ of 24 or more characters
A match that fails its length test still consumes its characters.

The method adds kind `novel`: a candidate of MIN_TOKEN or more characters with a digit and a
letter, at most REACH characters after a sensitive word. The compressor is primed with a
dictionary of common code and identifiers, followed by the candidate's surroundings. Its
marginal cost is size(surroundings + candidate) - size(surroundings); a cost of MIN_NOVELTY
bytes per character or more is reported, unless a base span overlaps it.

Scale: one pass over the texts without any shuffle, in time linear in the text; memory is a
batch and a few hundred bytes per candidate. Defined cases: null text is empty and has no span;
texts of any length are scanned whole; rows with equal doc_id are scanned one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import ship

MIN_TOKEN, REACH, AROUND, MIN_NOVELTY = 16, 48, 256, 0.55
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"secret|token|passw|passphrase|api.?key|private.?key|access.?key|signing.?key|encryption.?key|credential|bearer|authorization|client.?id|webhook", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.\-]{16,}")
LETTER_DIGIT = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.S)
#: What code and configuration commonly hold: it primes the compressor, so ordinary identifiers cost little.
IDENTIFIERS = """import from return self class function const static public private void string int float bool true false null None
config settings environment variable process.env os.environ getenv default username password token secret api_key client_id client_secret
access_key_id secret_access_key authorization bearer header request response session cookie http https www example com org net localhost
127.0.0.1 0.0.0.0 test dummy placeholder changeme your_api_key_here xxxxxxxxxxxxxxxx 1234567890 0123456789 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ version 1.0.0 2020-01-01T00:00:00 index.html main.py utils.js package.json node_modules site-packages
password = "password" token = "token" secret = "secret" key = value user@example.com /usr/local/bin /home/user/.config"""


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Novelty:
    """Marginal compressed bytes of a string, given its surroundings and the dictionary."""

    def __init__(self):
        import zstandard

        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.size = lambda data, c=zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False): len(c.compress(data))

    def __call__(self, text: str, start: int, end: int) -> float:
        near = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode("utf-8", "replace")
        token = text[start:end].encode("utf-8", "replace")
        return (self.size(near + token) - self.size(near)) / len(token)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Words and candidates are each found once and walked together."""
    out, done, k = [], 0, 0
    words = list(SENSITIVE.finditer(text))
    tokens = [m.span() for m in CANDIDATE.finditer(text)] if words else []
    taken: list[tuple[int, int]] = []  # base spans, overlapping ones made one
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    for word in words:
        while k < len(tokens) and tokens[k][1] <= max(word.end(), done):
            k += 1
        while k < len(tokens):
            start, end = max(tokens[k][0], word.end(), done), tokens[k][1]
            if end - start >= MIN_TOKEN:
                if start - word.end() > REACH:
                    break
                done = end
                near = bisect.bisect_right(taken, (start, math.inf)) - 1
                clear = (near < 0 or taken[near][1] <= start) and (near + 1 == len(taken) or taken[near + 1][0] >= end)
                if clear and LETTER_DIGIT.match(text, start, end) and novelty(text, start, end) >= MIN_NOVELTY:
                    out.append((start, 3, end))
            k += 1
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) per row of docs."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            ids, rows = batch.column(0), []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                new = novel_spans(text, base, novelty)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, len(new), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + new)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
