"""SQL oracles of the native operators, and the registration of all eleven queries."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from tideline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want.select(",".join(columns)).fetchall()))


def test_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names


def test_other_missing_modules_are_no_reason_to_leave_queries_out():
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    done = subprocess.run([sys.executable, "-c", "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__"], cwd=root, capture_output=True, text=True, timeout=60)
    assert done.returncode != 0 and "xxhash" in done.stderr
