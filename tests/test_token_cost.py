"""What a text's words cost, by the query and by its SQL, where the tables have no such texts."""

import duckdb

from brindle.queries.all import ORACLE_SQL, QUERIES

TEXTS = [
    None, "", " ", "\n\t \r\f", "\v", " \v\v ", "one\vword", "two words", " a\v bbbbbbbbbb\v\n", "a\x1cb\x85c\xa0d e　f",
    "été 😀😀😀😀😀😀😀😀 好", "\x00 \x00\x00", "x " * 300_000, " ".join("y" * (i % 23) for i in range(200_000)),
]


def both(spark, texts, folder):
    """The costs of a table of texts by the query and by its SQL."""
    texts.write.parquet(f"file://{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = QUERIES["token_cost"](spark, f"file://{folder}").select("doc_id", "cost").collect()
    return {r["doc_id"]: r["cost"] for r in found}, dict(con.execute(f"SELECT doc_id, cost FROM ({ORACLE_SQL['token_cost']})").fetchall())


def test_white_space_and_texts_without_words(spark, tmp_path):
    costs, expected = both(spark, spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), tmp_path)
    assert costs == expected
    assert [costs[i] for i in range(9)] == [None, None, None, None, 1.35, 1.35, 2.0, 2.7, 4.1]


def test_long_texts_are_rounded_alike(spark, tmp_path):
    # The sum of the first is 3971631.4500499996: times 10000 it's halfway, as a decimal number it isn't.
    texts = spark.sql("SELECT id AS doc_id, concat(repeat(concat('x ', repeat('y', 15), ' '), 778751 + int(id)), 'x') AS text FROM range(3)")
    costs, expected = both(spark, texts, tmp_path)
    assert costs == expected and costs[0] == 3971631.4501
