"""Every registered query against its SQL on the same parquet files."""

import glob
import math
import os

import duckdb
import pytest

from isoplane import registry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "none"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in out.collect()]
    if name not in ORACLES:
        assert rows
        return
    expected = duck.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(out.columns) == sorted(names)
    assert comparable(out.columns, rows) == comparable(names, expected.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
