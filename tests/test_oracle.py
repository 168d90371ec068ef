"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from brindle.queries.all import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if isinstance(value, float) and math.isnan(value) else str(value) if isinstance(value, int) and abs(value) >= 1e5 else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    columns, rows = sorted(df.columns), df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    found = oracle.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    expected = sorted("|".join(plain(r[i]) for i in place) for r in found.fetchall())
    assert sorted("|".join(plain(r[c]) for c in columns) for r in rows) == expected
