"""The numbered operators that SQL expresses, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from brindle.llm import queries

URLS = [
    "https://example.com/en/a", "http://WWW.Example.COM/en/b?x=1", "http://a.www.example.com/en/", "http://example.com", "http://badexample.com/en/",
    "https://shop.net/es/1", "https://shop.net/fr/#x", "http://net/de/", "ftp://x.org/?u=http://example.com/en/", "no scheme/en/", "", None, "http://example.com/en/a\nb",
]


def rows_of(frame, names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op7_url_filters"}))
def test_same_rows_as_sql_on_given_tables(spark, name):
    con, data = duckdb.connect(), "/root/testdata/sf0.001"
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    asked = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(names) and rows_of(got, names) == sorted(asked.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["op7_url_filters"])
def test_same_rows_as_sql(spark, tmp_path, name):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    asked = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    want = [dict(zip(names, r, strict=True)) for r in asked.fetchall()]
    key = lambda r: r["page_id"]
    assert sorted((r.asDict() for r in got.collect()), key=key) == sorted(want, key=key)
