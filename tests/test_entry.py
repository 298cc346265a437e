"""The entry point: names, SQL for known queries, results equal to SQL on the smallest tables."""

import os
import pathlib

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = sorted(k for k in entry.oracle_sql())


def test_names():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and all(callable(f) for f in queries.values())


def test_core_does_not_import_llm():
    root = pathlib.Path(entry.__file__).parent / "tidemark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tidemark.llm" not in p.read_text()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*names).collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_models_beat_chance(spark):
    r = entry.queries()["ml1_triage"](spark, "/root/testdata/sf0.01").collect()
    assert len(r) == 5 and sum(x.roc_auc for x in r) / 5 > 0.7


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_recall_of_cells(spark):
    exact, found = ({(r.query_id, r.doc_id) for r in entry.queries()[k](spark, "/root/testdata/sf0.1").collect()} for k in ("r8_dense", "r8_cells"))
    assert len(exact) == len(found) and len(exact & found) >= 0.9 * len(exact)
