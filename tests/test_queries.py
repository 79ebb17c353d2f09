"""Every registered graph query against its SQL."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from centra.plans import queries


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = queries.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in queries.ORACLE:
        assert rows
        return
    said = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr([plain(v) for v in r]) for r in said.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/centra", tmp_path / "centra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'betweenness' in e.queries() and 'pipeline' not in e.queries() and not any(q.startswith('op') for q in e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
