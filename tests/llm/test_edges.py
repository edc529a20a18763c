"""Very long texts and clashing column names through every operator and stage."""

import hashlib
import re

import pytest

import corpus_pipeline
from tideline.llm import common, decontam, langid, licenses, mixing, near_dedup, pii, quality, secrets, substring_dedup

#: Names that operators use for columns of their own.
NAMES = ("prob", "tokens", "node", "rep", "bucket", "removed", "digest", "grp", "kind", "canon", "matched", "held_out", "host", "row", "l", "t", "a", "b")


@pytest.fixture(scope="module")
def long_rows():
    words = " ".join(f"word{k * 7919 % 1_000_003}" for k in range(110_000))  # 1.2 MB
    return [(1, words, "en", "s"), (2, words + " tail", "en", "s"), (3, "b" * 1_200_000, "de", "s"), (4, "12 ab " * 200_000, "en", "s"), (5, "password = abcdef99 " + "x\n" * 600_000, None, None), (6, "short text of a person, Mr. Adam Smith", "en", "s")]


@pytest.fixture(scope="module")
def table(spark, long_rows):
    rows = [(i, t, la, s, len(t), *NAMES) for i, t, la, s in long_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)).repartition(2)


@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    """Six documents contradict their targets; how closely they are met is tested elsewhere."""
    monkeypatch.setattr(mixing, "MAX_ROUNDS", 2)


@pytest.mark.filterwarnings("ignore:targets are not met")
def test_long_texts(spark, table, long_rows, sf_dir):
    text = {i: t for i, t, _, _ in long_rows}
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    near = by(near_dedup.group_near_duplicates(table))
    assert near[1]["n_shingles"] == 110_000 - 4 and near[2]["component_id"] == 1 and near[3]["n_shingles"] == 1 and near[4]["n_shingles"] == 2
    spans = by(substring_dedup.dedup(table))
    assert spans[1]["n_removed"] == 0 and spans[2]["n_removed"] == len(text[1]) and spans[2]["kept_sha256"] == hashlib.sha256(b" tail").hexdigest() and spans[3]["n_removed"] == 0
    good = by(quality.quality(table))
    assert [good[i]["n_repeat_words"] for i in (1, 2, 3, 4)] == [0, 0, 0, 400_000] and good[5]["n_dup_lines"] == 600_000 - 2
    found = by(secrets.scan(table))
    assert found[5]["n_assign"] == 1 and found[3]["n_hex"] == 1 and found[1]["spans"] == ""
    hidden = by(pii.pseudonymize(table))
    assert hidden[6]["n_name"] == 1 and all(hidden[i]["text"] == text[i] for i in (1, 2, 3, 5))
    assert {r["lang_pred"] for r in langid.identify(table).collect()} <= {"en", "de"}
    assert {r["n_licenses"] for r in licenses.scan(table).collect()} == {0}
    assert by(mixing.probabilities(table))[1]["tokens"] == 110_000
    assert not any(r["contaminated"] for r in decontam.decontaminate(table, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect())


@pytest.mark.filterwarnings("ignore:targets are not met")
def test_clashing_names_pass_all_stages(spark, table, sf_dir):
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == table.columns, name
        assert all([r[n] for n in NAMES] == list(NAMES) for r in docs.select(*NAMES).collect())
    mixed = corpus_pipeline.STAGES[-1][1](spark, table, sf_dir)
    assert mixed.columns == [*table.columns, "prob_"]
    assert all(re.fullmatch("prob", r["prob"]) for r in mixed.collect())


def test_tables_of_cuts_are_deleted(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    table = docs([(k, f"some words of text number {k % 5} and more " * 12, "en", f"s{k % 3}") for k in range(40)])
    tables = lambda: len(list(tmp_path.iterdir()))
    assert near_dedup.group_near_duplicates(table).count() == 40 and tables() == 1
    assert pii.clean(table).count() == 40 and tables() == 3
    assert mixing.probabilities(table).count() == 40 and tables() == 5
