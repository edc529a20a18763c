import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) rows, with an extra column."""

    def make(rows, parts=2):
        rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
        data = [(i, t, la, s, None if t is None else len(t), "extra") for i, t, la, s in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, rep string").repartition(parts)

    return make


#: Nulls, blanks, ties, repeats and a long text, for every operator.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text here " * 3, "en", "s"), (6, "same text here " * 3, "en", "s"), (6, "same text here " * 3, "en", "s"), (7, "ß日本 " * 20000, None, "s"), (8, "a" * 60000, "de", None), (None, "no id " * 60, "en", "s")]


@pytest.fixture(scope="session")
def edges(docs):
    return docs(EDGES)


@pytest.fixture(scope="session")
def empty(docs, spark):
    return docs([(1, "x")]).where("doc_id < 0")
