import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from test_dedup import brute_groups
from test_native import verdicts, normal, WORD
from tideline.llm import decontam, mixing, pii, quality
from tideline.llm.decontam import MAX_MISSES, MIN_IDENTITY, MIN_MATCHED

PUNCTUATION = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def tokens(text):
    return WORD.findall((text or "").translate(PUNCTUATION).translate(LOWER))


def leaked(doc, item):
    """Any alignment with an accepted segment, by trying all of them."""
    if not set(zip(doc, doc[1:], strict=False)) & set(zip(item, item[1:], strict=False)):
        return False
    d, t = np.array(doc), np.array(item)
    same = d[:, None] == t[None, :]
    for shift in range(-len(t) + 1, len(d)):
        line = np.diagonal(same, -shift)
        best, at, gain, start = 0, (0, 0), 0, 0
        for k, x in enumerate(line):
            gain += 1 if x else -2
            if gain <= 0:
                gain, start = 0, k + 1
            elif gain > best:
                best, at = gain, (start, k + 1)
        matched = int(line[at[0] : at[1]].sum())
        if matched and matched >= min(MIN_MATCHED, max(1, len(t) - MAX_MISSES)) and matched >= MIN_IDENTITY * (at[1] - at[0]):
            return True
    return False


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Each stage written as Parquet and read again, as the driver does."""
    out, docs = [], spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_columns_and_names(stages):
    assert [s[0] for s in stages] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "personal_data", "source_mixing"]
    assert all(a.columns == b.columns for _, a, b in stages[:-1])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3][2].collect())


def test_quality_stage(stages):
    _, before, after = stages[0]
    judged, frequent = verdicts(rows(before))
    keep = {x[0] for x in judged if x[-1]}
    want = {(i, "\n".join(x for x in t.split("\n") if not (WORD.search(x) and (s or "", normal(x)) in frequent))) for i, t, _, s in rows(before) if i in keep}
    assert {r[:2] for r in rows(after)} == want


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    groups = brute_groups([r[:2] for r in rows(before)])
    assert sorted(rows(after)) == sorted(r for r in rows(before) if groups[r[0]][1] == r[0])


def test_decontamination_stage(spark, sf_dir, stages):
    _, before, after = stages[2]
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in rows(before) if any(leaked(tokens(r[1]), t) for t in items)}
    assert bad and sorted(rows(after)) == sorted(r for r in rows(before) if r[0] not in bad)


def test_personal_data_stage(stages):
    _, before, after = stages[3]
    java = re.compile(pii.EMAIL + "|" + pii.PHONE + "|" + pii.IP + "|" + pii.CARD)
    texts = {r[0]: r[1] for r in rows(after)}
    changed = 0
    for i, t, _, _ in rows(before):
        assert java.sub("@", t) == java.sub("@", texts[i])
        changed += t != texts[i]
    assert len(texts) == before.count() and changed


def test_mixing_stage(stages, tmp_path):
    _, before, after = stages[4]
    before.coalesce(1).write.parquet(str(tmp_path / "d"))
    want = duckdb.sql(mixing.oracle(f"'{tmp_path}/d/*.parquet'", result="SELECT doc_id, prob FROM o WHERE sampled")).fetchall()
    got, want = ({r[0]: r[1] for r in rows} for rows in (after.select("doc_id", "prob").collect(), want))
    assert got == pytest.approx(want, abs=1e-6)  # the oracle shows six places


def test_run_gives_the_same(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[-1][2].collect()))


def test_edges(spark, sf_dir, edges, empty):
    for docs in (edges, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.count()
    assert quality.clean(edges).count() <= edges.count() and decontam.clean is not None
