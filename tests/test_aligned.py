"""Claims held against windows of their evidence, not against all of it."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.operators import answers
from brindle.queries import evidence, registry

FAR = "The boiler was serviced on Monday. " + "Other things were said at length here. " * 20 + "Payment reached Leeds in autumn."
LONG = "one two three four five six seven eight nine ten " * 30
CASES = [
    ("The boiler was serviced on Monday.", FAR, None),
    ("The boiler serviced reached Leeds autumn.", FAR, "unsupported"),
    ("The boilers were serviced on Monday.", "The boiler was serviced on Monday.", None),
    ("The boiler was not serviced on Monday.", FAR, "negation"),
    ("They paid 2,373 pounds for the new boiler.", "They paid 2373 pounds for the new boiler.", None),
    ("They paid 2,374 pounds for the new boiler.", "They paid 2373 pounds for the new boiler.", "number"),
    ("The lease of the shop ends in May.", "The lease of the shop ends on 2024-05-31 in full.", None),
    ("The lease of the shop ends in June.", "The lease of the shop ends in May.", "month"),
    ("The lease may end soon for the shop.", "The lease may end soon for the shop.", None),
    ("The offer came from Jonathan by letter.", "The offer came from Miriam by letter.", "name"),
    ("The offer came from Miriam by letter.", "The offer came from MIRIAM by letter.", None),
    ('The letter says "pay us now" to all tenants.', "The letter says “pay  us\nnow” to all tenants.", None),
    ('The letter says "us pay now" to all tenants.', "The letter says “pay us now” to all tenants.", "quotation"),
    ("Hm.", FAR, "too little"), ("", FAR, "too little"), (None, FAR, "too little"),
    ("The boiler was serviced.", "", "unsupported"), ("The boiler was serviced.", None, "unsupported"),
    ("alpha omega", "alpha " + LONG + "omega", "unsupported"), ("alpha one two three", "alpha " + LONG, None),
    ("First half here. ", "First\n\nhalf here and there.", None),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, s, e) for i, (s, e, _) in enumerate(CASES)], "n int, sentence string, evidence string")
    found = {r["n"]: r for r in answers.aligned(rows).collect()}
    told = {i: found[i]["reason"] for i in found}
    assert told == {i: why for i, (_, _, why) in enumerate(CASES)}
    assert all(found[i]["accepted"] == (told[i] is None) for i in found)
    assert found[0]["receipt"] == "The boiler was serviced on Monday." and found[0]["support"] == 1.0


#: Words that begin or end as a denial or a month does, beside real ones.
BORDERS = ["noé wrote of the boiler", "the boiler of Sánchez is no", "ñno boiler is here", "no_one boiler", "They can’t", "they can’té stay", "Mayó is here", "in may", "mars, décembre", "on 2024-05-31é"]


def test_word_borders_are_those_of_the_sql(spark):
    duck = duckdb.connect()
    rows = spark.createDataFrame([(s,) for s in BORDERS], "s string")
    seen = rows.select(F.col("s").rlike(answers.NEGATION).alias("denies"), answers.months(F.col("s"), True).alias("months")).collect()
    assert [r["denies"] for r in seen] == [duck.execute(f"SELECT {evidence.NEGATED % '?'}", [s]).fetchone()[0] for s in BORDERS]
    assert [r["denies"] for r in seen] == [False, True, False, False, True, False, False, False, False, False]
    assert [r["months"] for r in seen] == [[]] * 10


def test_sql_of_aligned_has_all_tests(spark, tmp_path):
    bench = ["The lease of the shop ends in June for all. The letter says \"us pay now\" to all tenants. We met on a day in May. It is noé of a boiler at home."]
    docs = [(4, "The lease of the shop ends in May for all. We met on a day in May. The letter says \"pay us now\" to all tenants. It is noé of a boiler at home.")]
    spark.createDataFrame([(1, t) for t in bench], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    for t in ("benchmark", "documents"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = registry.QUERIES["answer_aligned"](spark, str(tmp_path)).select("n", "receipt", "support", "reason").orderBy("n").collect()
    assert [tuple(r) for r in got] == duck.execute(f"SELECT n, receipt, support, reason FROM ({registry.ORACLE_SQL['answer_aligned']}) ORDER BY n").fetchall()
    assert [r["reason"] for r in got] == ["month", "quotation", None, None]


@pytest.mark.parametrize("seed", range(2))
def test_windows_equal_brute_force(spark, seed):
    r = random.Random(seed)
    words = "bal cor dun fen gor hil".split()
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", ". ", "! ", "\n\n"]) for _ in range(n)).strip()
    cases = [(i, " ".join(r.sample(words, 4)), text(r.randrange(1, 40))) for i in range(80)]
    found = {x["n"]: x for x in answers.aligned(spark.createDataFrame(cases, "n int, sentence string, evidence string")).collect()}
    for i, sentence, evidence in cases:
        pieces = [p for p in evidence.replace(". ", ".\x01").replace("! ", "!\x01").replace("\n\n", "\x01").split("\x01") if p.strip()]
        windows = [(k, w, " ".join(p.strip() for p in pieces[k : k + w])) for k in range(len(pieces)) for w in (1, 2) if k + w <= len(pieces)]
        have = lambda t: len(set(sentence.split()) & set(t.replace(".", " ").replace("!", " ").split()))
        best = max(windows, key=lambda x: (have(x[2]), -len(x[2]), -x[0], -x[1]))
        assert (found[i]["receipt"], found[i]["support"]) == (best[2], have(best[2]) / 4)
