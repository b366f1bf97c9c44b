"""Every registered graph query against its DuckDB twin."""

import os
import subprocess
import sys

import duckdb
import pytest

from loomgraph import catalog, catalog_build, catalog_more  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(found):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_its_twin(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = con.sql(catalog.ORACLES[name])
    assert columns == sorted(relation.columns)
    expected = con.sql(f"select {', '.join(columns)} from ({catalog.ORACLES[name]})").fetchall()
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(expected)


def test_entry_needs_no_llm(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_entry_without_what_the_operators_need():
    """Where a module that the operators import is missing, all other queries are there."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; n = set(e.queries()); assert 'get_node' in n and 'op7_simhash' not in n and 'pipeline' not in n; assert not set(e.oracle_sql()) - n"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
