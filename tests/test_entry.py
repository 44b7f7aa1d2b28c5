import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"


def count(folder):
    r = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, env=os.environ | {"PYTHONPATH": folder}, capture_output=True, text=True)
    assert r.returncode == 0, r.stderr
    return int(r.stdout)


def test_import_needs_no_session_and_no_training_operators(tmp_path):
    whole, part = count(ROOT), tmp_path / "part"
    shutil.copytree(ROOT, part, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    from factloom.queries import QUERIES

    assert count(str(part)) == len(QUERIES) <= whole


def test_flagship(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) >= {"diff", "classification", "severity"}
