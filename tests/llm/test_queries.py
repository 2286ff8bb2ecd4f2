"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from skimlight.llm.queries import ORACLES, QUERIES

from ..conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        found = con.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} from ({ORACLES[name]})").fetchall()
        assert rows == sorted(map(repr, found))
