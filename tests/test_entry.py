"""The entry module, whole and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tarn.llm"):
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 40 and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_corpus_operators():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_them():
    for path in [*ROOT.glob("tarn/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != "test_entry.py":
            assert "tarn.llm" not in path.read_text(), path


def test_flagship(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["n_name", "revenue"] and rows.count() == 25
