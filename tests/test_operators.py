"""Every query with an oracle equals it at sf0.001; the others give rows at sf0.01 (fitting needs the longer series)."""

import math
import os

import duckdb
import pytest

from tessera.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if hasattr(v, "as_tuple"):
            v = float(v)
        return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else str(v)

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir if name in SQL else "/root/testdata/sf0.01")
    rows = got.collect()
    if name in SQL:
        want = con.execute(SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert plain(rows, got.columns) == plain(want.fetchall(), names)
    else:
        assert rows
