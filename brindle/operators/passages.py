"""Passages, stems and windows: text work that has no built-in expression, in batches inside tasks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens of a passage and of what it repeats, least characters of a last one.
TARGET, OVERLAP, SHORT = 512, 64, 120
#: Costs are counted in twentieths of a token, which makes them whole: five a character, 27 a word at least.
UNIT, CHAR_COST, LEAST_COST = 20, 5, 27
PASSAGE = "array<struct<ordinal:int,start:int,end:int,text:string>>"
PLAIN, SENTENCE, PARAGRAPH = 0, 1, 2
_WORDS, _EMPTY_LINES = re.compile(r"\S+"), re.compile(r"\n\s*\n")
_CLOSING, _STOPS = "\"')]", ".!?:"


def pieces(text: str, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, border) of words, those of over `most` characters in pieces; border says what begins there."""
    spans = np.array([m.span() for m in _WORDS.finditer(text)], np.int64).reshape(-1, 2)
    start, end = spans[:, 0], spans[:, 1]
    ends = np.array([m.end() for m in _EMPTY_LINES.finditer(text)], np.int64)
    before = np.concatenate([[0], end[:-1]]) if len(end) else end
    fresh = np.searchsorted(ends, start, side="right") > np.searchsorted(ends, before, side="right")
    stopped = np.array([text[a:b].rstrip(_CLOSING)[-1:] in _STOPS and text[a:b].rstrip(_CLOSING) != "" for a, b in spans.tolist()], bool)
    border = np.where(fresh | (start == 0), PARAGRAPH, np.where(np.concatenate([[False], stopped[:-1]])[: len(start)], SENTENCE, PLAIN))
    count = -(-(end - start) // most)
    owner = np.repeat(np.arange(len(start)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = start[owner] + place * most
    return first, np.minimum(first + most, end[owner]), np.where(place == 0, border[owner], PLAIN)


def passages(text: str, target: int = TARGET, overlap: int = OVERLAP, short: int = SHORT) -> list[tuple[int, int]]:
    """(start, end) of windows of at most `target` tokens.

    A window ends before the last paragraph that begins in its last fifth, else before the last
    sentence that does, but is at least half as long as it could be. The next begins where `overlap`
    tokens are repeated, or at the first sentence after that. A last window of under `short`
    characters joins the one before it.
    """
    start, end, border = pieces(text, target * 4)
    n = len(start)
    spent = np.concatenate([[0], np.cumsum(np.maximum(LEAST_COST, CHAR_COST * (end - start)))])
    index = np.arange(n)
    last_of = {b: np.maximum.accumulate(np.where(border >= b, index, -1)) for b in (SENTENCE, PARAGRAPH)}
    sentences = np.flatnonzero(border >= SENTENCE)
    out: list[tuple[int, int]] = []
    here = 0
    while here < n:
        stop = max(here + 1, int(np.searchsorted(spent, spent[here] + target * UNIT, side="right")) - 1)
        if stop < n:
            least = max(here + 1, stop - max(1, target // 5), here + (stop - here) // 2)
            stop = next((int(last_of[b][stop]) for b in (PARAGRAPH, SENTENCE) if last_of[b][stop] >= least), stop)
        a, b = int(start[here]), int(end[stop - 1])
        if stop == n and out and b - a < short and b > out[-1][1]:
            out[-1] = (out[-1][0], b)
            break
        out.append((a, b))
        if stop == n:
            break
        back = stop
        if overlap > 0:
            back = max(here + 1, int(np.searchsorted(spent, spent[stop] - overlap * UNIT, side="right")) - 1)
            k = int(np.searchsorted(sentences, back))
            back = int(sentences[k]) if k < len(sentences) and sentences[k] < stop else back
        here = max(back, here + 1)
    return out


def chunk(docs: DataFrame, text: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """docs with one row a passage: ordinal, start, end and the passage's text in place of the document's."""

    @F.pandas_udf(PASSAGE)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"ordinal": i, "start": a, "end": b, "text": t[a:b]} for i, (a, b) in enumerate(passages(t or "", target, overlap))])

    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.explode(cut(F.col(text))).alias("p")).select(*rest, "p.ordinal", "p.start", "p.end", F.col("p.text").alias(text))


def with_pages(chunks: DataFrame, breaks: DataFrame) -> DataFrame:
    """chunks (doc_id, start, ...) with `page`, the number of page breaks of the document at or before the start.

    breaks: (doc_id, at). A document's breaks are one sorted array, so no chunk meets them row by row.
    """
    pages = breaks.groupBy("doc_id").agg(F.sort_array(F.collect_list("at")).alias("breaks"))
    before = F.size(F.filter("breaks", lambda b: b <= F.col("start")))
    return chunks.join(pages, "doc_id", "left").withColumn("page", F.when(F.col("breaks").isNull(), 1).otherwise(before + 1)).drop("breaks")


_SENTENCE_START = re.compile(r"(?:^|[.!?…]['\")\]]* |[。！？])(?=\S)")


def dense_window(text: str, terms: list[str], width: int = 600) -> str:
    """Up to `width` characters of a text from the sentence on after which most different terms follow, then
    most terms in all; of equal sentences the first. Blanks count as one, and the last word is whole. Where
    a term stands only beyond the width of any sentence's start, words begin windows too."""
    flat = " ".join(text.split())
    if len(flat) <= width or width <= 0:
        return flat
    low = flat.lower()
    found = sorted((m.start(), m.end(), k) for k, t in enumerate(dict.fromkeys(t.lower() for t in terms if t)) for m in re.finditer(re.escape(t), low))
    at = [a for a, _, _ in found]

    def best(starts: list[int]) -> tuple[tuple[int, int], int]:
        inside = lambda s: [k for _, b, k in found[bisect_left(at, s) : bisect_right(at, s + width)] if b <= s + width]
        return max(((len(set(v)), len(v)), -s) for s, v in ((s, inside(s)) for s in starts))

    starts = [m.end() for m in _SENTENCE_START.finditer(flat)]
    met = best(starts) if starts else ((0, 0), 0)
    if found and not met[0][0]:
        met = best([flat.rfind(" ", 0, a + 1) + 1 for a in at])
    window = flat[-met[1] :][: width + 1]
    whole = window[:width] if len(window) <= width or window[width] == " " else window[:width].rpartition(" ")[0] or window[:width]
    return whole.strip()


def windows(text: Column, terms: list[str], width: int = 600) -> Column:
    @F.pandas_udf("string")
    def cut(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: dense_window(t or "", terms, width))

    return cut(text)


# Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980). His suffixes.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def porter(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (suffix := _longest(w, ("ed", "ing"))) and "v" in _shape(w[: -len(suffix)]):
        w = w[: -len(suffix)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-1:] == w[-2:-1] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (suffix := _longest(w, table)) and _measure(w[: -len(suffix)]) > 0:
            w = w[: -len(suffix)] + table[suffix]
    if (suffix := _longest(w, _STEP4)) and _measure(w[: -len(suffix)]) > 1 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(suffix)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (term, ...) with `stem`: each distinct word is stemmed once, whatever it stands in."""

    @F.pandas_udf("string")
    def work(words: pd.Series) -> pd.Series:
        return words.map(porter)

    return vocabulary.withColumn("stem", work("term"))
