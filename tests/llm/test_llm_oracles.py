"""Text queries beside their SQL in DuckDB, and the registered contract of every query."""

from pathlib import Path

import duckdb
import pytest

from ledgerloom.llm.queries import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")

CONTRACT = {
    1: "doc_id bigint, held_out boolean, score double, predicted int",
    2: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    3: "doc_id bigint, held_out boolean, lang_pred string, score double",
    4: "page_id bigint, url string, text string, n_chars bigint",
    5: "doc_id bigint, item_id bigint",
    6: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    7: "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    8: "source string, lang string, tokenizer string, docs bigint, tokens bigint",
    9: "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    10: "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    frame = QUERIES[name](spark, str(SF))
    types = dict(frame.dtypes)
    for column in CONTRACT[int(name[2:].split("_")[0])].split(", "):
        assert types[column.split()[0]] == column.split()[1]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in SF.iterdir():
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = QUERIES[name](spark, str(SF))
    columns = sorted(frame.columns)
    own = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert own == sorted(repr(tuple(r[k] for k in at)) for r in got.fetchall())
