"""Every station and raster query against its SQL in DuckDB; those without SQL must run."""

import duckdb
import pytest

from aerogrid import catalog
from aerogrid.sources.fixtures import GIVEN

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def _plain(rows):
    def one(v):
        if v is None or v != v:
            return ""
        return str(int(v)) if isinstance(v, bool) else repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if name not in SQL:
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert _plain(rows) == _plain([tuple(r[i] for i in at) for r in cursor.fetchall()])
