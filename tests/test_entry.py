"""The driver contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["pid", "level", "value"] and df.count() > 0
    assert {*entry.oracle_sql()} <= {*entry.queries()}


def test_imports_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q30_bilinear' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)


def test_a_missing_library_costs_the_corpus_operators_only(tmp_path):
    """A library that cannot be imported leaves all gridded queries."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'q30_bilinear' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert {*e.oracle_sql()} <= {*q}"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for top, _, names in os.walk(os.path.join(ROOT, "gridloom")):
        if os.sep + "llm" in top:
            continue
        for n in names:
            if n.endswith(".py"):
                assert "gridloom.llm" not in open(os.path.join(top, n), encoding="utf-8").read()
