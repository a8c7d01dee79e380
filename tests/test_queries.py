"""Every query against its SQL in DuckDB, on the driver's smallest tables."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa
import pytest

from millrace.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def values(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted((tuple(map(repr, row)) for row in zip(*(table.column(n).to_pylist() for n in names), strict=True)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    if name not in ORACLES:
        assert got.num_rows > 0
        return
    want = duck.execute(ORACLES[name]).fetch_arrow_table() if hasattr(duck, "fetch_arrow_table") else duck.execute(ORACLES[name]).to_arrow_table()
    want = want.read_all() if not isinstance(want, pa.Table) else want
    assert sorted(got.column_names) == sorted(want.column_names)
    assert values(got) == values(want)
