"""Every ledger query beside its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from ledgerloom.plans.queries import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF.iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"stream_ledger"}))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, str(SF))
    columns = sorted(frame.columns)
    own = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert own == sorted(repr(tuple(r[k] for k in at)) for r in got.fetchall())
