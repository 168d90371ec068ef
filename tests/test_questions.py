from brindle.plans import questions as Q


def test_kinds():
    assert Q.kind_of("How many PDFs from Dave in 2019?") == "aggregate"
    assert Q.kind_of("compare the two budgets") == "compare"
    assert Q.kind_of("is there a lease for the flat") == "absence"
    assert Q.kind_of("boiler quote") == "find" and Q.kind_of("newest photos of the garden") == "aggregate"


def test_counting_questions():
    a = Q.parse_aggregate("How many PDFs from Dave in 2019 about boilers?")
    assert (a.op, a.types, a.people, a.year, a.topics) == ("count", ("pdf",), ("dave",), 2019, ("boilers",))
    assert Q.parse_aggregate("boiler quote") is None
    assert Q.parse_aggregate("how much space do my photos use").op == "size"


def test_answers(spark):
    from brindle.sources.corpus import Corpus

    corpus = Corpus(spark, "/root/testdata/sf0.001")
    spec = Q.parse_aggregate("how many pdfs in 2022")
    got = Q.answer(corpus.files, spec, corpus).first()["n"]
    want = corpus.files.filter("ext = 'pdf' and status in ('INDEXED', 'NAME_ONLY') and mtime_ns between 1640995200000000000 and 1672531199999999000").count()
    assert got == want
