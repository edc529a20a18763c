import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tideline.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
from tideline.plans import catalogue
assert set(e.queries()) == set(catalogue.QUERIES) and set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_the_optional_subpackage():
    done = subprocess.run([sys.executable, "-c", BLOCK], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["key", "value"] and df.count() > 0
