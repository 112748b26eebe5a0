"""Registered queries against their SQL."""

import duckdb
import pytest

from siltstone.plans.oracle import SQL
from siltstone.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "lineitem", "nation", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith("T4") or n == "T4_restore_hsf_rank_bib"])
def test_query(spark, db, name):
    want = db.sql(SQL[name])
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    rows = sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == rows
