"""Plain-English questions: which kind they are, and counting questions as an aggregation plan.

Rules only, on the driver; the answer's number always comes from a DataFrame.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import filters, reports
from brindle.plans.grammar import STOPWORDS, TYPE_GROUPS, Parsed, end_ns, start_ns

# Words that tell kinds of questions and of files.
COUNTING = r"\b(?:how many|count|number of)\b"
SIZING = r"\b(?:how much space|how big|total size)\b"
LATEST, FIRST = r"\b(?:latest|newest|most recent|last)\b", r"\b(?:oldest|earliest|first)\b"
ABSENCE = r"\b(?:is there|are there|do i have|did anyone|any)\b"
COMPARING = r"\b(?:compare|difference between|versus|vs)\b"
NOUNS = {
    "pdf": ("pdf",), "pdfs": ("pdf",), "document": ("pdf", "docx", "txt", "md"), "documents": ("pdf", "docx", "txt", "md"), "spreadsheets": TYPE_GROUPS["excel"],
    "photos": TYPE_GROUPS["image"], "pictures": TYPE_GROUPS["image"], "emails": TYPE_GROUPS["mail"], "mails": TYPE_GROUPS["mail"], "messages": TYPE_GROUPS["mail"], "files": (),
}
INSTRUCTIONS = frozenset("find show me list get give latest newest oldest how many much count number do i have there about all my what which any files".split())
MOST_TOPICS = 4


@dataclass(frozen=True)
class Aggregate:
    op: str
    types: tuple[str, ...] = ()
    people: tuple[str, ...] = ()
    year: int | None = None
    topics: tuple[str, ...] = field(default=())

    def parsed(self) -> Parsed:
        days = self.year and (dt.date(self.year, 1, 1), dt.date(self.year, 12, 31))
        asked = {"type": list(self.types)} if self.types else {}
        return Parsed(
            terms=self.topics, filters=asked | ({"from": list(self.people)} if self.people else {}), after_ns=days and start_ns(days[0]), before_ns=days and end_ns(days[1])
        )


def kind_of(question: str) -> str:
    """aggregate, compare, absence or find; the first rule that fits decides."""
    q = question.lower()
    for kind, pattern in (("aggregate", f"{COUNTING}|{SIZING}"), ("compare", COMPARING), ("absence", ABSENCE)):
        if re.search(pattern, q):
            return kind
    return "aggregate" if re.search(f"{LATEST}|{FIRST}", q) and words_of(q) & NOUNS.keys() else "find"


def words_of(text: str) -> set[str]:
    return set(re.findall(r"[a-z0-9']+", text.lower()))


def parse_aggregate(question: str) -> Aggregate | None:
    q = question.lower()
    op = next((o for o, p in (("size", SIZING), ("count", COUNTING), ("newest", LATEST), ("oldest", FIRST)) if re.search(p, q)), None)
    if op is None:
        return None
    people = tuple(w.lower() for w in re.findall(r"\b(?:from|by|to)\s+([A-Z][a-z]+)\b", question))
    year = re.search(r"\b(?:in|from|during|of)\s+((?:19|20)\d\d)\b", q)
    tokens = re.findall(r"[a-z0-9']+", q)
    types = tuple(dict.fromkeys(t for w in tokens if w in NOUNS for t in NOUNS[w]))
    skip = STOPWORDS | INSTRUCTIONS | NOUNS.keys() | set(people) | ({year[1]} if year else set()) | {"during", "space", "big", "total", "size", "is", "last", "first", "recent", "most"}
    topics = tuple(dict.fromkeys(w for w in tokens if w not in skip))[:MOST_TOPICS]
    return Aggregate(op, types, people, int(year[1]) if year else None, topics)


def answer(files: DataFrame, spec: Aggregate, corpus) -> DataFrame:
    """One row: the count, the bytes, or the newest or oldest file."""
    found = filters.apply(reports.about(files, list(spec.topics), corpus.bodies), spec.parsed(), corpus)
    when = F.coalesce("taken_at_ns", "mtime_ns")
    return {
        "count": lambda: found.agg(F.count("*").alias("n")),
        "size": lambda: found.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")),
        "newest": lambda: found.agg(F.max_by("path", F.struct(when, -F.col("id"))).alias("path")),
        "oldest": lambda: found.agg(F.min_by("path", F.struct(when, F.col("id"))).alias("path")),
    }[spec.op]()


def filters_of(sentence: str) -> Parsed:
    """The filters that a sentence states: a kind of file, one person after from, by or to, one year."""
    spec = parse_aggregate("how many " + sentence) or Aggregate("count")
    return Aggregate("count", spec.types, spec.people[:1], spec.year).parsed()


def sides_of(question: str) -> list[str]:
    """The two things that a comparison is about."""
    q = re.sub(r"^.*?\b(?:compare|between)\b", "", question.lower())
    parts = re.split(r"\b(?:and|with|versus|vs|to)\b", q, maxsplit=1)
    return [w for p in parts for w in re.findall(r"[a-z0-9]+", p) if w not in STOPWORDS] if len(parts) == 2 else []
