"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import pytest

from skimlight.queries import ORACLES, QUERIES

from .conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    wanted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(duck.sql(ORACLES[name]).columns) == columns
    assert rows == sorted(map(repr, duck.sql(f"select {wanted} from ({ORACLES[name]})").fetchall()))


STORED = "match_all stored_by_id autocomplete_table index_size boosted_query topk_paged topk_relevance fuzzy_neighbours posting_scan".split()


@pytest.mark.parametrize("name", STORED)
def test_stored_index_with_odd_texts(spark, tmp_path_factory, name):
    """Documents without a text, with an empty one or without terms, and equal ones, which only their ids order."""
    duckdb = pytest.importorskip("duckdb")
    texts = [None, "", " ... ", "THE the and", "that thatt hatt", "thät tha", "and a"]
    path = str(tmp_path_factory.getbasetemp() / "odd")
    rows = spark.range(70).selectExpr("id as doc_id", f"element_at(array({', '.join('null' if t is None else repr(t) for t in texts)}), int(id % 7) + 1) as text")
    full = rows.selectExpr("*", "'en' as lang", "'src1' as source", "cast(coalesce(length(text), 0) as bigint) as n_chars")
    full.write.mode("ignore").parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, path)
    wanted = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.sql(f"select {wanted} from ({ORACLES[name]})").fetchall()))
