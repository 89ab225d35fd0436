import importlib
import sys

import pytest

import __spark_entry__
from factorlake.plans import queries as engine

SF = "/root/testdata/sf0.001"


def test_queries_and_oracles_agree_in_names():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(engine.QUERIES) <= set(q) and set(s) <= set(q) and len(engine.SQL) > 45


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["j", "h"] and df.count() > 0


@pytest.mark.parametrize("name", ["matrix_info", "filter_rows", "stored_losses", "ari", "score_test", "nnls_project", "stream_windows"])
def test_some_queries_against_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = engine.QUERIES[name](spark, SF).toPandas(), con.execute(engine.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_imports_without_the_text_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("factorlake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "factorlake.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    try:
        m = importlib.reload(__spark_entry__)
        assert "pipeline" not in m.queries() and "gram" in m.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
