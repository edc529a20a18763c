import hashlib
import random
import re

import pytest

from tideline.llm import decontam, licenses, secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_match_the_patterns(docs):
    r = random.Random(4)
    bits = ["token", "TOKEN", "api_key", "ApiKey", "secret", "ſecret", "toKen", " = ", ":", '"', "'", "abcdef", "0123456789abcdef" * 2, "AKIA", "ABCDEFGH12345678", " ", "\n", "é", "x-", "=", "12345", "password"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(30)))) for i in range(400)]
    for row in secrets.scan(docs(rows)).collect():
        want = base(dict(rows)[row["doc_id"]])
        kinds = [sum(k == x for _, k, _ in want) for x in range(3)]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == kinds
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(row["spans"].split(","))


def test_novel_spans(docs):
    secret = "q7Zp0XvB3kLm9TtR2sWyA8dF"
    rows = [(1, f"the client credential is {secret} for prod"), (2, f"plain words {secret} and nothing sensitive"), (3, "the credential is your_api_key_here_1234567890"), (4, f"bearer {secret}"), (5, f"token = {secret}")]
    got = {r["doc_id"]: r for r in secrets.scan(docs(rows)).collect()}
    at = rows[0][1].index(secret)
    assert got[1]["spans"] == f"novel:{at}:{at + len(secret)}" and got[1]["n_novel"] == 1
    assert got[2]["spans"] == "" and got[3]["n_novel"] == 0 and got[4]["n_novel"] == 1
    assert got[5]["n_assign"] == 1 and got[5]["n_novel"] == 0


def plain_novel(text, novelty):
    """The reported candidates by the rule itself: for each word, all that start within reach."""
    covered = [False] * len(text)
    for s, _, e in base(text):
        covered[s:e] = [True] * (e - s)
    out, done = [], 0
    for word in secrets.SENSITIVE.finditer(text):
        at = max(word.end(), done)
        while (m := secrets.CANDIDATE.search(text, at)) and m.start() - word.end() <= secrets.REACH:
            at = done = m.end()
            if any(c in "0123456789" for c in m[0]) and any(c.isalpha() for c in m[0]) and not any(covered[m.start() : m.end()]):
                near = (text[max(0, m.start() - secrets.AROUND) : m.start()] + text[m.end() : m.end() + secrets.AROUND]).encode()
                if (novelty.size(near + m[0].encode()) - novelty.size(near)) / len(m[0]) >= secrets.MIN_NOVELTY:
                    out.append((m.start(), 3, m.end()))
    return out


def test_novel_spans_match_the_rule():
    r, novelty, found = random.Random(12), secrets.Novelty(), 0
    key = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(r.randrange(10, 40)))
    for _ in range(300):
        parts = [r.choice([key(), key(), "token", "credential", "bearer ", "secret=", "word ", "0123456789abcdef01234567", "password: ", " " * 30, "plain_identifier_name_1", "\n", "é"]) for _ in range(r.randrange(1, 25))]
        text = r.choice(["", " "]).join(parts)
        got = secrets.novel_spans(text, secrets.base_spans(text), novelty)
        assert got == plain_novel(text, novelty)
        found += len(got)
    assert found > 100


def test_long_texts_are_scanned_in_linear_time():
    import time

    novelty = secrets.Novelty()
    for text in ("token " * 500_000, "token secret " * 200_000 + "q7Zp0XvB3kLm9TtR2sWyA8dF", "token=abcdefgh " * 200_000 + "the credential q7Zp0XvB3kLm9TtR2sWyA8dF"):
        start = time.perf_counter()
        secrets.novel_spans(text, secrets.base_spans(text), novelty)
        assert time.perf_counter() - start < 20


def test_secret_edges(edges, empty):
    rows = secrets.scan(edges).collect()
    assert len(rows) == edges.count()
    assert {r["spans"] for r in rows if r["doc_id"] != 8} == {""}
    assert next(r for r in rows if r["doc_id"] == 8)["n_hex"] == 1  # sixty thousand times `a`
    assert secrets.scan(empty).count() == 0


@pytest.fixture(scope="module")
def benchmark(spark):
    r = random.Random(9)
    words = [f"b{k}" for k in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(40)).capitalize() + ".") for i in range(8)]
    rows += [(8, rows[0][1]), (9, None), (10, ""), (11, "tiny test item"), (None, "no id here at all")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks(docs, benchmark):
    r = random.Random(2)
    items = {i: t for i, t in benchmark.collect() if i is not None}
    filler = lambda n: " ".join(f"f{r.randrange(5000)}" for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        item = r.randrange(8)
        w = items[item].split()
        if i % 3 == 0:  # the whole item with substituted words
            for k in range(r.randrange(8), len(w), 8):
                w[k] = "changed"
        elif i % 3 == 1:  # a passage of it
            w = w[5:25]
        else:
            w = []
        rows.append((i, f"{filler(20)} {' '.join(w).upper()}\n{filler(20)}"))
        want[i] = i % 3 != 2
    got = {x["doc_id"]: x for x in decontam.decontaminate(docs(rows), benchmark).collect()}
    assert {i: x["contaminated"] for i, x in got.items()} == want
    assert 8 not in {k for x in got.values() for k in x["items"]}
    assert decontam.clean(docs(rows), benchmark).count() == 20


def test_repetitive_texts_do_not_multiply():
    import time

    import numpy as np

    bench = decontam.Benchmark([(1, "a " * 300), (2, "a b " * 150), (3, " ".join(f"x{k}" for k in range(60)))])
    words, counts = decontam.tokens([b"a " * 200_000, b"b a " * 50_000, " ".join(f"x{k}" for k in range(20, 50)).encode()])
    start, ends = time.perf_counter(), np.cumsum(counts)
    found = decontam.distinct_rows(np.concatenate([bench.hits(at, h, ends) for at, h in decontam.seeds(words, decontam.remaining(counts))]))
    got = {}
    for d, item in {(int(x[0]), int(x[1])) for x in found}:
        shifts = found[(found[:, 0] == d) & (found[:, 1] == item), 2]
        got[d, item] = bench.match(words, int(ends[d] - counts[d]), int(ends[d]), item, shifts)[2]
    assert got == {(0, 0): 300, (1, 1): 300, (2, 2): 30}
    assert time.perf_counter() - start < 60


def test_leaks_in_blocks(docs, benchmark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 50)
    items = {i: t for i, t in benchmark.collect() if i is not None}
    rows = [(1, items[3]), (2, "A tiny, test item!"), (3, "tiny test")]
    got = {x["doc_id"]: x for x in decontam.decontaminate(docs(rows), benchmark).collect()}
    assert got[1]["items"] == [3] and got[2]["items"] == [11] and not got[3]["contaminated"]


def test_leaks_of_rows_without_doc_id(docs, benchmark):
    item = dict(benchmark.collect())[3]
    table = docs([(None, item), (None, "clean words"), (2**63 - 1, "other words"), (4, item), (4, "clean too")])
    assert sorted((str(r["doc_id"]), r["contaminated"]) for r in decontam.decontaminate(table, benchmark).collect()) == [("4", False), ("4", True), (str(2**63 - 1), False), ("None", False), ("None", True)]
    assert sorted(r["text"] for r in decontam.clean(table, benchmark).collect()) == ["clean too", "clean words", "other words"]


def test_leak_edges(edges, empty, benchmark):
    got = decontam.decontaminate(edges, benchmark)
    assert got.count() == edges.count() and got.where("contaminated").count() == 0
    assert decontam.decontaminate(empty, benchmark).count() == 0
    assert decontam.decontaminate(edges, benchmark.where("item_id < 0")).where("contaminated").count() == 0
    assert decontam.clean(edges, benchmark).columns == edges.columns


def test_licenses(docs):
    mit = next(t for n, t in licenses.TEMPLATES if n == "mit" and len(t) > 100)
    rows = [(1, "text\nReleased under the MIT license!\nmore"), (2, mit.replace(" free of charge,", "").upper()), (3, "Licensed under CC-BY-NC 4.0\nAll rights reserved."), (4, "a licence to speak about mit"), (5, mit.replace(", ", ",\n")), (6, "Licensed under CC BY 4.0.")]
    got = {r["doc_id"]: r for r in licenses.scan(docs(rows)).collect()}
    assert [got[k]["licenses"] for k in range(1, 7)] == ["mit", "mit", "all-rights-reserved,cc-by-nc-4.0", "", "mit", "cc-by-4.0"]
    assert got[1]["best_score"] == 1.0 and got[4]["best_score"] == 0.0


def test_whole_licences(docs):
    """Every whole text is told by its name, alone, after a copyright line, and wrapped otherwise."""
    import os

    folder = os.path.join(os.path.dirname(licenses.__file__), "license_texts")
    names = sorted(os.listdir(folder))
    texts = [open(os.path.join(folder, n), encoding="utf-8").read() for n in names]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, "Copyright 2020 Jane Doe\n\n" + re.sub(r"\s+", " ", t).upper()) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in licenses.scan(docs(rows)).collect()}
    for k, name in enumerate(names):
        assert name.removesuffix(".txt") in got[k]["licenses"].split(",") and got[k]["best_score"] == 1.0
        assert got[100 + k]["licenses"] == name.removesuffix(".txt")


def plain_scan(text):
    units = {*text.split("\n"), *re.split(r"\n[\x20\x09-\x0D]*\n", text), text}
    found = []
    for u in units:
        b = set(licenses.bigrams(u))
        scores = [(-2 * len(b & set(t)) / (len(b) + len(t)), name) for name, t in licenses.templates()] if b else []
        best = min(scores, default=(0, ""))
        if best[0] <= -licenses.THRESHOLD:
            found.append(best)
    return len(found), ",".join(sorted({n for _, n in found})), round(-min((s for s, _ in found), default=0.0), 6)


def test_units_match_brute_force(docs):
    r = random.Random(21)
    lines = [t for _, t in licenses.TEMPLATES]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 6)):
            w = r.choice(lines).split()
            for _ in range(r.randrange(len(w) // 4 + 1)):
                w[r.randrange(len(w))] = r.choice(["x", "the", "license"])
            parts.append(" ".join(w[r.randrange(3) :]))
        rows.append((i, r.choice(["\n", "\n\n", " "]).join(parts)))
    got = {x["doc_id"]: (x["n_units"], x["licenses"], x["best_score"]) for x in licenses.scan(docs(rows)).collect()}
    assert got == {i: plain_scan(t) for i, t in rows}


def test_license_edges(edges, empty):
    assert licenses.scan(edges).where("n_licenses = 0").count() == edges.count()
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize("name, kind, version, thing", [("gpl-2.0", "General", "2", "program"), ("gpl-3.0", "General", "3", "program"), ("agpl-3.0", "Affero General", "3", "program"), ("lgpl-2.1", "Lesser General", "2.1", "library"), ("lgpl-3.0", "Lesser General", "3", "library")])
def test_headers_of_the_gnu_licences_are_told_apart(docs, name, kind, version, thing):
    from tideline.llm import licenses

    text = f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    got = licenses.scan(docs([(1, f"Tool\n\n{text}\n\ncode")])).first()
    assert (got["licenses"], got["best_score"]) == (name, 1.0)
