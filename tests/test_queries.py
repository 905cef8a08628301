import os
from pathlib import Path

import duckdb
import pytest
from support import plain, rows

from tideset.catalog import QUERIES
from tideset.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {Path(name).stem} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    found = QUERIES[name](spark, SF)
    wanted = tables.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    want = [tuple(plain(r[wanted.columns.index(c)]) for c in columns) for r in wanted.fetchall()]
    got = rows(found, *columns)
    assert got == sorted(want, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
    assert got or name in ("affected_nodes", "scc_edges", "sketch_update")  # few rows there


def test_the_entry_names_every_query():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
