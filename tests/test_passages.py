"""Windows of passages by hand-made cases, stems by Porter's examples."""

import random

from brindle.operators import passages as P


def texts(text, **options):
    return [text[a:b] for a, b in P.passages(text, **options)]


def test_short_texts_are_one_passage():
    assert P.passages("") == [] and P.passages(" \n ") == []
    assert texts(" one two ") == ["one two"]


def test_windows_end_at_sentences_and_repeat_some_words():
    # Each word costs 1.35: 7 fit 10 tokens; the last fifth (2 words) holds the sentence's end.
    words = ["a1", "a2", "a3", "a4", "a5", "a6.", "b1", "b2", "b3", "b4", "b5", "b6", "b7", "b8"]
    got = texts(" ".join(words), target=10, overlap=2, short=1)
    assert got[0] == "a1 a2 a3 a4 a5 a6."
    # Two words are repeated (1.35 is less than 2); no sentence begins among them.
    assert got[1] == "a5 a6. b1 b2 b3 b4 b5"


def test_a_paragraph_goes_before_a_sentence():
    text = "a1 a2 a3 a4 a5\n\nb1. c1 c2 c3 c4 c5 c6 c7"
    assert texts(text, target=10, overlap=0, short=1)[0] == "a1 a2 a3 a4 a5"


def test_a_short_end_joins_the_last_window():
    text = " ".join(f"w{i}" for i in range(9))
    assert texts(text, target=10, overlap=0, short=1) == ["w0 w1 w2 w3 w4 w5 w6", "w7 w8"]
    assert texts(text, target=10, overlap=0, short=6) == [text]


def test_a_giant_word_comes_in_pieces():
    assert [len(t) for t in texts("x" * 100, target=10, overlap=0, short=1)] == [40, 40, 20]


def test_windows_cover_every_word_in_order():
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice(["word ", "longerword ", "end. ", "\n\n", "x" * r.randint(1, 90) + " "]) for _ in range(r.randint(0, 300)))
        spans = P.passages(text, target=r.choice([12, 40, 90]), overlap=r.choice([0, 4, 9]), short=r.choice([1, 30]))
        assert all(a < b for a, b in spans) and all(x[0] < y[0] for x, y in zip(spans, spans[1:]))
        covered = set()
        for a, b in spans:
            covered |= set(range(a, b))
        assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())


def test_windows_of_many_terms():
    text = "start " + "filler " * 200 + "alpha beta alpha " + "filler " * 200
    got = P.dense_window(text, ["alpha", "beta"], 60)
    assert "alpha beta alpha" in got and len(got) <= 60 and not got.startswith("iller")
    assert P.dense_window("short  text", ["x"], 60) == "short text"
    assert P.dense_window("word " * 50, [], 12) == "word word"


def test_porter():
    pairs = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor sing:sing hopping:hop failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit operator:oper hopefulness:hope formaliti:formal electricity:electr replacement:replac adoption:adopt effective:effect probate:probat rate:rate controlling:control roll:roll"
    for pair in pairs.split():
        word, stem = pair.split(":")
        assert P.porter(word) == stem, word
