"""Registered queries against their SQL, and that all works without the pipeline subpackage."""

import glob
import math
import os
import subprocess
import sys
import textwrap

import duckdb
import pytest
from heliograph.queries import ORACLES, QUERIES

from .conftest import REPO

DATA = os.environ.get("HELIOGRAPH_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(x) for x in r) for r in df.select(cols).collect())
    if name in ORACLES:
        r = duck.execute(ORACLES[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(norm(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_entry_without_the_pipeline(tmp_path):
    """The entry imports, with all other queries, where the subpackage and the pipeline are gone."""
    code = f"""
    import sys
    sys.path.insert(0, {REPO!r})
    class Gone:
        def find_spec(self, name, *rest):
            if name in ("heliograph.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(name)
    sys.meta_path.insert(0, Gone())
    import __spark_entry__ as e
    assert "pipeline" not in e.queries() and not any(q.startswith("op") and q[2].isdigit() for q in e.queries())
    assert "top_nations" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=tmp_path, timeout=120)


def test_shortest_path_over_the_whole_table(spark):
    """Each part of the size is a start, those with ids of 60 and more too."""
    parts = {r["p_partkey"] for r in spark.read.parquet(f"{DATA}/part.parquet").where("p_size = 9 and p_partkey > 1").collect()}
    got = QUERIES["shortest_path"](spark, DATA).collect()
    assert {r["a"] for r in got} == parts and max(parts) >= 60
    assert {(r["a"], r["b"], r["hops"]) for r in got} == {(a, a >> h, h) for a in parts for h in (1, 2, 3) if a >> h}


@pytest.mark.parametrize("name", ["detach_document", "document_updates"])
def test_documents_of_all_events(spark, name):
    ids = sorted(r["event_id"] for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id").collect())
    assert sorted(r["id"] for r in QUERIES[name](spark, DATA).select("id").collect()) == ids and len(ids) > 200
