"""Every query against its SQL on the smallest tables, and the entry points' behaviour without the corpus subpackage."""

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from skein.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def shown(v):
    if v is None or v != v:
        return "~"
    return repr(round(float(v), 6) + 0.0) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(t)[:-8]} AS FROM '{t}'")
    want = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("also_gone", [(), ("corpus_pipeline.py",)])
def test_entry_points_without_the_corpus_subpackage(tmp_path, also_gone):
    """The whole repository without the two folders, and without the pipeline's module."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.pyc"))
    for folder in ("skein/llm", "tests/llm"):
        shutil.rmtree(copy / folder)
    for name in also_gone:
        (copy / name).unlink()
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op1_') for n in q) and len(q) > 50 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_the_subpackage_without_the_pipeline(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.pyc", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
