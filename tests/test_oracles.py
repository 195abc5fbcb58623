"""Every query of the library against DuckDB on the smallest tables; no SQL: that it runs and its schema holds."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

from corvex import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    rows = df.collect()
    if name not in SQL:
        assert rows and df.columns
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert Counter(plain(tuple(r)) for r in rows) == Counter(plain(tuple(r[i] for i in at)) for r in want.fetchall())


def test_names():
    assert set(SQL) <= set(QUERIES)


def test_sizes_round_halves_as_sql_does(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = [4096 * i for i in range(40)] + [1638, 1639, None]
    pq.write_table(pa.table({"doc_id": list(range(len(n))), "text": [""] * len(n), "n_chars": pa.array(n, pa.int64())}), tmp_path / "documents.parquet")
    documents = duckdb.connect().sql(SQL["f15_sizes"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["f15_sizes"](spark, str(tmp_path)).collect())) == sorted(documents)
