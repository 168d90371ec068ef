"""Predicates over files and mail: one definition for every surface.

A parsed query becomes one Column (plus semi- and anti-joins where a filter names another table);
Catalyst pushes what it can into the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.plans.grammar import FACETS, Parsed

MAIL_KINDS = ("eml", "msg", "pst", "mbox")


def effective_ns() -> Column:
    return F.coalesce("taken_at_ns", "mtime_ns")


def type_is(values: list[str]) -> Column:
    plain = [v for v in values if not set(v) & set("*?")]
    found = F.col("ext").isin(plain) if plain else F.lit(False)
    for v in values:
        if v not in plain:
            found = found | F.col("ext").rlike(T.glob_regex(v))
    return found


def any_of(column: Column, values: list[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | T.matches(column, v)
    return out


def size_is(op: str, n: int) -> Column:
    """Parts of archives have no size of their own."""
    own = ~F.col("path").contains("!/")
    c = F.col("size_bytes")
    return own & {"<": c < n, "<=": c <= n, ">": c > n, ">=": c >= n, "=": c == n}[op]


def in_scope(scope: str) -> Column:
    mail = F.col("source_kind").isin(*MAIL_KINDS)
    return {"all": F.lit(True), "mail": mail, "documents": ~mail, "code": F.col("repo_id").isNotNull()}[scope]


def same(column: Column, values: list[str]) -> Column:
    """Equal to one of the values without regard to case, or matched by one that is a glob."""
    out = F.lit(False)
    for v in values:
        out = out | (column.rlike(T.glob_regex(v)) if set(v) & set("*?") else T.ascii_lower(column) == T.ascii_lower(F.lit(v)))
    return out


def _all(column: Column, values: list[str]) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & T.matches(column, v)
    return out


#: Tests that a file's own columns answer: a column of the file and the values asked for.
OWN = {
    "type": type_is,
    "name": lambda v: any_of(T.basename(F.col("path")), v),
    "status": lambda v: F.col("status").isin(*v),
    "path": lambda v: _all(F.col("path"), v),
    "place": lambda v: same(F.col("place"), v),
}
SCREENSHOT = ("screenshot", "screen shot", "snip")


def condition(q: Parsed) -> Column:
    """Filters that the file's own columns answer; a negated one keeps nulls."""
    own = F.lit(True)
    for field, values in q.filters.items():
        if field in OWN:
            own = own & OWN[field](values)
    for field, values in q.excluded_filters.items():
        if field in OWN:
            test = any_of(F.col("path"), values) if field == "path" else OWN[field](values)
            own = own & F.coalesce(~test, F.lit(True))
    for asked, wanted in ((q.filters, True), (q.excluded_filters, False)):
        for facet in asked.get("only", ()):
            if facet in ("mail", "screenshots"):
                hit = F.col("path").contains("/attachments/") if facet == "mail" else any_of(F.col("path"), list(SCREENSHOT))
                own = own & (hit if wanted else ~hit)
    if q.after_ns is not None:
        own = own & (effective_ns() >= q.after_ns)
    if q.before_ns is not None:
        own = own & (effective_ns() <= q.before_ns)
    for op, n in q.sizes:
        own = own & size_is(op, n)
    return own & in_scope(q.scope)


def attached(corpus, value: str) -> DataFrame:
    """(path) of messages with an attachment of that name: an attachment is a row under its message's path."""
    parts = corpus.listing.filter(F.col("path").contains("/attachments/") & T.matches(T.basename(F.col("path")), value))
    return parts.select(F.substring_index("path", "/attachments/", 1).alias("path")).distinct()


def memberships(corpus) -> dict:
    """Fields that another table answers: the file's column, and the rows of one value or of several (any of them)."""
    mail = lambda test: corpus.messages.filter(test).select(F.col("mail_id").alias("id"))
    every = lambda find: lambda values: [find(v) for v in values]  # each value must hold
    either = lambda find: lambda values: [find(values)]
    return {
        "repo": ("repo_id", either(lambda v: corpus.repos.filter(any_of(F.col("name"), v) | any_of(F.col("root_path"), v)).select(F.col("id").alias("repo_id")))),
        "on": ("volume_id", either(lambda v: corpus.volumes.filter(any_of(F.col("name"), v)).select(F.col("id").alias("volume_id")))),
        "shows": ("id", either(lambda v: corpus.file_tags.filter(F.col("tag").isin(*v)).select(F.col("file_id").alias("id")).distinct())),
        "from": ("id", every(lambda v: mail(T.contains_ci(F.col("sender"), v)))),
        "to": ("id", every(lambda v: mail(F.exists("recipients", lambda r: T.contains_ci(r, v))))),
        "subject": ("id", every(lambda v: mail(T.contains_ci(F.col("subject"), v)))),
        "mailbox": ("id", every(lambda v: mail(T.matches(F.col("archive"), v)))),
        "mailfolder": ("id", every(lambda v: mail(T.matches(F.col("folder"), v)))),
        "attachment": ("path", every(lambda v: attached(corpus, v))),
        "who": ("id", either(lambda v: corpus.faces.join(corpus.piles.filter(same(F.col("name"), v)).select(F.col("id").alias("pile")), "pile").select(F.col("file_id").alias("id")).distinct())),
    }


def _facet(corpus, files: DataFrame, facet: str, wanted: bool) -> DataFrame:
    named = corpus.faces.join(corpus.piles.select(F.col("id").alias("pile"), "name"), "pile", "left")
    has = {"named": F.col("name").isNotNull(), "unnamed": F.col("name").isNull(), "no-faces": F.lit(True)}[facet]
    hit = named.filter(has).select(F.col("file_id").alias("id")).distinct()
    pictures = files.filter("ext = 'jpg'") if facet == "no-faces" and wanted else files
    return pictures.join(hit, "id", "left_semi" if wanted != (facet == "no-faces") else "left_anti")


def apply(files: DataFrame, q: Parsed, corpus) -> DataFrame:
    """files under all filters of q; those of other tables become semi-joins, negated ones anti-joins.

    A field that no test answers raises, so that no filter is left out without a word.
    """
    others = memberships(corpus)
    for field in (*q.filters, *q.excluded_filters):
        if field not in OWN and field not in others and field != "only":
            raise ValueError(f"no filter for {field}:")
    for facet in (*q.filters.get("only", ()), *q.excluded_filters.get("only", ())):
        if facet not in FACETS:
            raise ValueError(f"no facet {facet}")
    out = files.filter(condition(q))
    for field, (key, find) in others.items():
        for rows in find(q.filters[field]) if field in q.filters else ():
            out = out.join(rows, key, "left_semi")
        for v in q.excluded_filters.get(field, ()):
            for rows in find([v]):
                out = out.join(rows, key, "left_anti")
    for asked, wanted in ((q.filters, True), (q.excluded_filters, False)):
        for facet in asked.get("only", ()):
            if facet not in ("mail", "screenshots"):
                out = _facet(corpus, out, facet, wanted)
    if q.has_attachment is not None:
        rows = corpus.messages.filter(F.col("has_attach") == q.has_attachment).select(F.col("mail_id").alias("id"))
        out = out.join(rows, "id", "left_semi")
    return out
