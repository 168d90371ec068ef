"""Writers: contacts as CSV and vCards, results as JSON lines, reports as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header names of the three CSV layouts.
LAYOUTS = {
    "plain": {"name": "Name", "email": "Email", "company": "Company"},
    "google": {"name": "Name", "email": "E-mail 1 - Value", "company": "Organization 1 - Name"},
    "outlook": {"name": "Full Name", "email": "E-mail Address", "company": "Company"},
}


def contacts_csv(contacts: DataFrame, path: str, layout: str = "plain") -> None:
    names = LAYOUTS[layout]
    contacts.select(*[F.col(c).alias(h) for c, h in names.items()]).write.option("header", "true").csv(path)


def vcards(contacts: DataFrame) -> DataFrame:
    """(value): one vCard 4.0 a row."""
    escaped = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\,;])", r"\\$1")
    lines = [F.lit("BEGIN:VCARD"), F.lit("VERSION:4.0"), F.concat(F.lit("FN:"), escaped("name")), F.concat(F.lit("EMAIL:"), F.coalesce("email", F.lit(""))), F.concat(F.lit("ORG:"), escaped("company")), F.lit("END:VCARD")]
    return contacts.select(F.concat_ws("\r\n", *lines).alias("value"))


def contacts_vcard(contacts: DataFrame, path: str) -> None:
    vcards(contacts).write.option("lineSep", "\r\n").text(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def completions(rows: DataFrame, column: str, most: int = 50) -> DataFrame:
    """(value, n): the commonest values of a column, for a sidecar of suggestions."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def markdown(rows: DataFrame, title: str, most: int = 100) -> str:
    """A short report table; the rows are cut to `most`, which is what a page shows."""
    head, body = rows.columns, rows.limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in body]) + "\n"
