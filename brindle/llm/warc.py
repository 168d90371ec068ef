"""WARC archives: writing captures and assembling them again as transactions.

A capture is three records: the response (or a revisit of an earlier equal payload), the request
and metadata, the latter two pointing at the first by WARC-Concurrent-To. Archives are gzipped
files that Spark's text writer makes, one record after the other; reading takes each file as a
whole, follows Content-Length, and joins the records of a capture back into one nested row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT_BYTES = 1000
#: (payload bytes, captures): files of payloads up to so many bytes hold up to so many captures, so that a
#: reader, which takes a file whole, holds 256 MB of payload or one capture.
FILES = ((1 << 16, 4_096), (1 << 20, 256), (1 << 24, 16), (1 << 62, 1))
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

RECORD = (
    "record_id string, type string, concurrent_to string, target_uri string, declared_digest string, refers_to string, "
    "payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    lines: list[Column] = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        if value is not None:
            lines += [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n")]
    size = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), size, F.lit(END), block)


def plan_captures(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Adds digest, payload size and the key of the capture that a page revisits, if any.

    Among equal payloads of MIN_REVISIT_BYTES or more the largest key is the response; rows that
    share that key all are. Keys are aggregated before the join; payloads aren't compared pairwise.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"),
        F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("digest"), F.sha2(payload, 256).alias("same"),
    )
    large = rows.filter(F.col("size") >= MIN_REVISIT_BYTES)
    kept = large.groupBy("same").agg(F.max("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = rows.join(kept, "same", "left")
    revisits = F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") < F.col("first")))
    return met.withColumn("first", F.when(revisits, F.col("first"))).drop("same")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a request, a response or revisit, and a metadata record for each row of pages.

    Null html is an empty payload, a null url an empty target; line ends in urls are escaped. A
    record's id depends on key and payload alone, so repeated rows give repeated records. An empty
    table gives files without records; other columns are not read. Pages of 16 MB and more, if there
    are any, are written apart, and so are two classes between (FILES).
    """
    rows = plan_captures(pages, key, url, html)
    target = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    this, first = _urn(F.lit("response"), F.col("key"), F.col("digest")), _urn(F.lit("response"), F.col("first"), F.col("digest"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    common = lambda kind, record_id: [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", target), ("WARC-Date", DATE)]
    http = "application/http; msgtype="
    response = _record([*common("response", this), ("WARC-Payload-Digest", digest), ("Content-Type", http + "response")], F.concat(head, F.col("html")))
    revisit = _record(
        [
            *common("revisit", this), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", first), ("WARC-Profile", PROFILE),
            ("Content-Type", http + "response"),
        ],
        head,
    )
    asked = F.concat(
        F.lit("GET "), F.regexp_replace(target, r"^[^:]*://[^/?#]*", ""), F.lit(" HTTP/1.1\r\nHost: "),
        F.regexp_extract(target, r"^[^:]*://([^/?#]*)", 1), F.lit(END),
    )
    request = _record([*common("request", _urn(F.lit("request"), F.col("key"), F.col("digest"))), ("WARC-Concurrent-To", this), ("Content-Type", http + "request")], asked)
    facts = F.concat(F.lit("key: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record(
        [*common("metadata", _urn(F.lit("metadata"), F.col("key"), F.col("digest"))), ("WARC-Concurrent-To", this), ("Content-Type", "application/warc-fields")],
        facts,
    )
    text = F.concat(request, F.lit(END), F.when(F.col("first").isNull(), response).otherwise(revisit), F.lit(END), metadata)
    largest = pages.agg(F.max(F.octet_length(F.col(html)))).first()[0] or 0
    above = -1
    for most, captures in FILES:
        if above < largest or above < 0:
            some = rows.filter(F.col("size").between(above + 1, most))
            some.select(text.alias("value")).write.mode("error" if above < 0 else "append").options(
                compression="gzip", lineSep=END, maxRecordsPerFile=captures, **{"zlib.compress.level": "BEST_SPEED"}
            ).text(path)
        above = most


def _records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one file, gzipped or plain."""
    if raw[:2] == b"\x1f\x8b":
        out, rest = [], raw
        while rest:  # one gzip member or many
            z = zlib.decompressobj(31)
            out.append(z.decompress(rest))
            rest = z.unused_data
        raw = b"".join(out)
    at = 0
    while (start := raw.find(b"WARC/", at)) >= 0:
        stop = raw.index(b"\r\n\r\n", start)
        lines = raw[start:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        at = stop + 4 + int(headers["content-length"])
        yield headers, raw[stop + 4 : at]


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives under path; payload stays null unless asked for."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for h, block in _records(content.as_py()):
                    kind, payload, fields = h.get("warc-type", ""), None, []
                    if kind == "response":
                        payload = block[block.find(b"\r\n\r\n") + 4 :]
                    elif kind == "metadata":
                        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")) if k]
                    rows.append(
                        (
                            h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"),
                            h.get("warc-payload-digest"), h.get("warc-refers-to"), None if payload is None else len(payload),
                            None if payload is None else hashlib.sha1(payload).hexdigest(), fields, payload if payloads else None,
                        )
                    )
                    held += len(payload or b"") if payloads else 0
                    if len(rows) >= 5000 or held > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: response, request, metadata, and for revisits the response referred to.

    Captures without a request or metadata keep nulls there; a digest that doesn't fit its payload
    shows as digest_fits false. Requests and metadata that repeat for one capture count once. An
    empty table gives an empty result; columns of records beyond those of RECORD are not read.
    """
    side = lambda kind: (
        records.filter(F.col("type") == kind).groupBy("concurrent_to").agg(F.min(F.struct("record_id", "target_uri")).alias(kind), F.first("fields").alias(f"{kind}_fields"))
        .withColumnRenamed("concurrent_to", "record_id")
    )
    captures = records.filter(F.col("type").isin("response", "revisit"))
    fields = ["record_id", "type", "target_uri", "declared_digest", "payload_bytes", "payload_digest", "payload"]
    own = captures.select("record_id", "refers_to", F.struct(*fields).alias("response"))
    requests, metadata = side("request").drop("request_fields"), side("metadata")
    first = records.filter(F.col("type") == "response").groupBy("record_id").agg(F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("digest"))
    origin = first.join(metadata.select("record_id", F.col("metadata_fields").alias("origin_fields")), "record_id", "left").select(
        F.col("record_id").alias("refers_to"), F.struct("bytes", "digest", F.col("origin_fields").alias("fields")).alias("origin")
    )
    met = own.join(requests, "record_id", "left").join(metadata, "record_id", "left")
    # Captures that refer to nothing get a key each that no record has, or one task would get them all.
    met = met.withColumn("refers_to", F.coalesce("refers_to", F.concat(F.lit("-"), "record_id"))).join(origin, "refers_to", "left")
    digest = F.coalesce("response.payload_digest", "origin.digest")
    return met.select(
        "record_id", "response", "request", F.col("metadata_fields").alias("metadata"), "origin",
        (F.col("response.declared_digest") == F.concat(F.lit("sha1:"), digest)).alias("digest_fits"),
    )
