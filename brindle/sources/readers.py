"""Readers of files into documents: one row a document, many a container.

All start from Spark's binaryFile source, so listing, pruning and splitting the work are Spark's;
a reader is a small function from bytes to documents that runs in batches on the executors. One
unreadable file gives one row with an error, never a failed job.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, part string, title string, sender string, recipients array<string>, text string, error string"
#: Limits against hostile archives.
MOST_MEMBERS, MOST_RATIO, MOST_DEPTH, MOST_BYTES = 20_000, 200, 2, 256 << 20

EXCLUDED_DIRS = ("node_modules", "__pycache__", ".git", ".venv", "venv", ".cache")
EXCLUDED_FILES = ("~$*", "*.tmp", "*.part", "*.crdownload")

Document = tuple[str, str | None, str | None, list[str] | None, str]


def decoded(raw: bytes) -> str:
    """Text by UTF-8, then Windows-1252, then Latin-1; bytes with many NULs are no text."""
    if raw[:4096].count(0) * 20 > len(raw[:4096]):
        raise ValueError("binary")
    for encoding in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("undecodable")


def read_text(name: str, raw: bytes) -> Iterator[Document]:
    yield "", None, None, None, decoded(raw)


def read_html(name: str, raw: bytes) -> Iterator[Document]:
    import html

    text = decoded(raw)
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", text)
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", text)
    text = re.sub(r"(?i)<br\s*/?>|</(?:p|div|tr|li|h[1-6]|table|blockquote)\s*>", "\n", text)
    body = html.unescape(re.sub(r"<[^>]+>", " ", text))
    yield "", title and html.unescape(title[1]).strip(), None, None, re.sub(r"[ \t\xa0]+", " ", body).strip()


def _message(raw: bytes) -> tuple[str | None, str | None, list[str], str]:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_subtype() == "html":
        text = next(read_html("", text.encode()))[4]
    people = [a.strip().lower() for h in ("to", "cc") for a in str(m.get(h, "")).split(",") if a.strip()]
    return m.get("subject"), str(m.get("from", "")).lower() or None, people, text


def read_eml(name: str, raw: bytes) -> Iterator[Document]:
    yield "", *_message(raw)


def read_mbox(name: str, raw: bytes) -> Iterator[Document]:
    """One document for each message; `From ` at a line's start parts them."""
    for n, part in enumerate(re.split(rb"(?m)^From [^\n]*\n", raw)[1:]):
        yield str(n), *_message(part.replace(b"\n>From ", b"\nFrom "))


def read_csv(name: str, raw: bytes) -> Iterator[Document]:
    yield "", None, None, None, "\n".join("\t".join(row) for row in csv.reader(io.StringIO(decoded(raw))))


def read_vcard(name: str, raw: bytes) -> Iterator[Document]:
    """One document for each card, with its name as title and its e-mail addresses as recipients."""
    text = re.sub(r"\r?\n[ \t]", "", decoded(raw))
    for n, card in enumerate(re.findall(r"(?is)BEGIN:VCARD(.*?)END:VCARD", text)):
        fields = re.findall(r"(?im)^([A-Z-]+)(?:;[^:\r\n]*)?:([^\r\n]*)", card)
        values = lambda key, found=fields: [v for k, v in found if k.upper() == key]
        yield str(n), next(iter(values("FN")), None), None, [v.lower() for v in values("EMAIL")], card.strip()


def _xml_text(raw: bytes, ends: tuple[str, ...]) -> str:
    out: list[str] = []
    for _, node in ElementTree.iterparse(io.BytesIO(raw), events=("end",)):
        tag = node.tag.rpartition("}")[2]
        if tag == "t" or tag == "span":
            out.append(node.text or "")
        elif tag in ends:
            out.append("\n" if tag != "tc" else "\t")
    return "".join(out).strip()


def read_docx(name: str, raw: bytes) -> Iterator[Document]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        yield "", None, None, None, _xml_text(_member(z, z.getinfo("word/document.xml")), ("p", "br", "tc"))


def read_pptx(name: str, raw: bytes) -> Iterator[Document]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for n in slides:
            yield n, None, None, None, _xml_text(_member(z, z.getinfo(n)), ("p",))


def read_xlsx(name: str, raw: bytes) -> Iterator[Document]:
    """Rows as tab-separated lines, one document for each sheet."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, node in ElementTree.iterparse(io.BytesIO(_member(z, z.getinfo("xl/sharedStrings.xml")))):
                if node.tag.endswith("}si"):
                    shared.append("".join(t.text or "" for t in node.iter() if t.tag.endswith("}t")))
        for sheet in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            lines = []
            for _, node in ElementTree.iterparse(io.BytesIO(_member(z, z.getinfo(sheet)))):
                if node.tag.endswith("}row"):
                    cells = []
                    for cell in node:
                        value = "".join(t.text or "" for t in cell.iter() if t.tag.rpartition("}")[2] in ("v", "t"))
                        cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
                    lines.append("\t".join(cells))
            yield sheet, None, None, None, "\n".join(lines)


def _member(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    if info.file_size > MOST_BYTES or info.file_size > MOST_RATIO * max(info.compress_size, 1024):
        raise ValueError(f"{info.filename} is too large or packed too tightly")
    return z.read(info)


def read_zip(name: str, raw: bytes, depth: int = 0) -> Iterator[Document]:
    """Members as documents, archives within archives to MOST_DEPTH."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist()[:MOST_MEMBERS]:
            reader = READERS.get(info.filename.rpartition(".")[2].lower())
            if info.is_dir() or reader is None or (reader is read_zip and depth + 1 >= MOST_DEPTH):
                continue
            inner = read_zip(info.filename, _member(z, info), depth + 1) if reader is read_zip else reader(info.filename, _member(z, info))
            for part, *rest in inner:
                yield f"{info.filename}{'!/' + part if part else ''}", *rest


READERS: dict[str, Callable[[str, bytes], Iterator[Document]]] = {
    **dict.fromkeys(("txt", "md", "log", "py", "js", "ts", "java", "c", "cpp", "h", "cs", "go", "rs", "sql", "json", "xml", "yaml", "toml", "ini", "rst"), read_text),
    **dict.fromkeys(("html", "htm", "xhtml"), read_html),
    **dict.fromkeys(("csv", "tsv"), read_csv),
    **dict.fromkeys(("vcf", "vcard"), read_vcard),
    "eml": read_eml, "mbox": read_mbox, "docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx, "zip": read_zip,
}


def register(extension: str, reader: Callable[[str, bytes], Iterator[Document]]) -> None:
    """Adds a reader, or replaces one, for a file extension."""
    READERS[extension.lower()] = reader


def walk(spark: SparkSession, folder: str, extensions: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, modificationTime, length, content) of files under a folder, without excluded folders and names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    skip = "|".join(re.escape(d) for d in EXCLUDED_DIRS)
    names = "|".join(re.escape(g).replace(r"\*", ".*") for g in EXCLUDED_FILES)
    kept = files.filter(~F.col("path").rlike(f"/(?:{skip})/")).filter(~F.col("path").rlike(f"/(?:{names})$")).filter(F.col("length") <= most_bytes)
    if extensions:
        kept = kept.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions))
    return kept


def documents(files: DataFrame) -> DataFrame:
    """Documents of files of (path, content), by extension."""
    readers = dict(READERS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                reader = readers.get(path.rpartition(".")[2].lower())
                try:
                    if reader is None:
                        raise ValueError("no reader")
                    out += [(path, part, title, sender, people, text, None) for part, title, sender, people, text in reader(path, bytes(content))]
                except Exception as e:  # one bad file never stops a run
                    out.append((path, "", None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(read, SCHEMA)
