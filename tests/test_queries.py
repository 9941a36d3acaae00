"""Every registered query of the engine against its SQL on the smallest tables, and what happens without the optional subpackage."""

import collections
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from larder.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return repr(v) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLE:
        got = db.sql(ORACLE[name])
        assert sorted(got.columns) == columns
        order = [got.columns.index(c) for c in columns]
        assert rows == collections.Counter(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in got.fetchall())


def test_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for p in ("larder", "__spark_entry__.py"):
        (shutil.copytree if (root / p).is_dir() else shutil.copy)(root / p, tmp_path / p)
    shutil.rmtree(tmp_path / "larder/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
