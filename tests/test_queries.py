"""Every registered query with SQL against that SQL in DuckDB, on the smallest tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from causeway.plans.oracle import ORACLE
from causeway.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows, columns):
    show = lambda v: "null" if v is None or v != v else f"{v:.7g}" if isinstance(v, float) else str(v)
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(show(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), list(want.columns))


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(ORACLE) <= set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["addr_exact_green", "green_r2", "precision_r2", "bounded_r2", "block_bootstrap"])
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_graph_queries_have_the_default_caps():
    from causeway.plans import queries as q

    assert (q.FIELDS.cap, q.BOUNDED.cap, q.BOUNDED.fallback_cap, q.ADDRESS_CAP) == (100, 100, 30, 50)


@pytest.mark.parametrize("missing", ["causeway.llm", "corpus_pipeline", "public_tokenizers", "tiktoken"])
def test_entry_without_what_the_corpus_needs(missing, tmp_path):
    """The event queries stay when the corpus subpackage, or a library that only it imports, cannot be imported."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; assert set(e.queries()) == set(e.plans.QUERIES) >= set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__)), check=True)
