"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from turnframe.plans import more, rest  # noqa: F401
from turnframe.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_same_rows(spark, con, name):
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(own.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_entry_imports_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['turnframe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'turn_merge' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_entry_imports_where_the_folders_are_deleted(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=lambda d, names: [n for n in names if n in ("llm", "corpus_pipeline.py", ".git", "__pycache__")])
    code = "import __spark_entry__ as e; q = e.queries(); assert 'turn_merge' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert e.__file__.startswith(%r)" % str(tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120, env=env)
