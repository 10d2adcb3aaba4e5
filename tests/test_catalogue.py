"""Every registered query with SQL gives the rows that DuckDB gives."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import pandas as pd

from stratalog.operators import graph
from stratalog.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df):
    def plain(v):
        return None if pd.isna(v) else round(float(v), 9) if isinstance(v, float) else v if isinstance(v, (str, bool)) else int(v) if hasattr(v, "__int__") else v

    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert rows(got) == rows(db.execute(catalogue.ORACLE_SQL[name]).df())


def test_entry_imports_and_lists():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_part(monkeypatch):
    import sys

    import __spark_entry__ as e

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("stratalog.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "stratalog.llm", None)
    import stratalog

    monkeypatch.delattr(stratalog, "llm", raising=False)
    assert set(e.queries()) == set(catalogue.QUERIES)


def test_ranks(spark):
    """The whole table's orders, by plain walks over dictionaries."""
    from stratalog.plans.views import commits

    rows = [(r.oid, list(r.parents), r.committer_ts) for r in commits(spark, DATA).select("oid", "parents", "committer_ts").collect()]
    dfs = {r.oid: r.visit_rank for r in catalogue.QUERIES["dfs_rank"](spark, DATA).collect()}
    assert dfs == {o: k for k, o in enumerate(graph.walk({o: p for o, p, _ in rows}, [max(o for o, _, _ in rows)]))}
    topo = {r.oid: r.topo_rank for r in catalogue.QUERIES["topo_order"](spark, DATA).collect()}
    left, done, want = {o: (set(p), t) for o, p, t in rows}, set(), []
    known = set(left)
    while left:
        ready = min(((t, o) for o, (p, t) in left.items() if not (p & known) - done), default=None)
        want.append(ready[1])
        done.add(ready[1])
        del left[ready[1]]
    assert topo == {o: k for k, o in enumerate(want)}


def test_crc(spark):
    import zlib

    crc = {r[0]: r[1] for r in catalogue.QUERIES["crc_of_blob"](spark, DATA).collect()}
    for i, t in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(20).collect():
        assert crc[i] == zlib.crc32(t.encode())
