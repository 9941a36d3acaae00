"""Every registered query of the subpackage that SQL can state, against its SQL on the smallest tables."""

import collections
from pathlib import Path

import duckdb
import pytest

from larder.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = con.sql(ORACLE[name])
    assert sorted(got.columns) == columns
    order = [got.columns.index(c) for c in columns]
    rows = collections.Counter(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert rows == collections.Counter(repr(tuple(r[i] for i in order)) for r in got.fetchall()) and rows
