"""The engine's entities, derived from the given tables by the same expressions in Spark and in SQL.

files, chunks, messages, vectors and contacts stand for what an indexer would have stored. Every
entity is a lazy DataFrame over Parquet, so filters and columns reach the scans. What costs a pass
over all texts (hashes of files, postings, the vocabulary) is stored once and read after that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache, cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.store import Store

#: 2024-01-01T00:00:00Z in nanoseconds, the corpus's "now", and a day.
BASE_NS = 1704067200000000000
DAY_NS = 86400000000000
EXTENSIONS = ("pdf", "docx", "txt", "md", "eml", "jpg", "py", "xlsx")
#: Bytes other than letters and digits part words; both engines know these classes.
WORD_BREAK = r"[^\p{L}\p{N}]+"


#: Ids of mail rows and of attachment rows in the listing of all files begin here.
MAIL_ID, ATTACHMENT_ID = 1_000_000_000_000, 2_000_000_000_000
PLACES = ("Leeds", "Porto", "Lyon", "Graz")
#: Input bytes for each bucket of the postings.
BUCKET_BYTES = 32_000_000
#: Most tasks that write one bucket.
MOST_PARTS = 4
#: Words that are sorted at once; a longer document is a piece of its own.
AT_ONCE = 500_000
#: Bytes of text that become postings at once; a longer document is a piece of its own.
BYTES_AT_ONCE = 8_000_000


@cache
def letters(spark: SparkSession) -> bytes:
    """A bit for each code point: whether it is one of a word's for WORD_BREAK as Spark reads it."""
    sign = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    found = spark.range(0x110000).filter(~F.col("id").between(0xD800, 0xDFFF) & (F.regexp_replace(sign, WORD_BREAK, "") != ""))
    bits = np.zeros(0x110000, bool)
    bits[[r["id"] for r in found.collect()]] = True
    return np.packbits(bits).tobytes()


def cut(texts: pa.Array, of_words: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has. of_words: by code point, whether it is part of a word."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    ascii_ = np.zeros(256, bool)
    ascii_[:128] = of_words[:128]
    part = ascii_[data]
    lead = np.flatnonzero(data >= 0xC0)
    more = 1 + (data[lead] >= 0xE0).astype(np.int8) + (data[lead] >= 0xF0)
    code = (data[lead] & (0x3F >> more)).astype(np.int64)
    for k in (1, 2, 3):
        on = more >= k
        code[on] = code[on] << 6 | data[lead[on] + k] & 0x3F
    held = of_words[code]
    lead, more = lead[held], more[held]
    for k in (0, 1, 2, 3):
        part[lead[more >= k] + k] = True
    begins, stops = part.copy(), part.copy()
    begins[1:] &= ~part[:-1]
    stops[:-1] &= ~part[1:]
    some = np.diff(ends) > 0
    begins[ends[:-1][some]] = part[ends[:-1][some]]
    stops[ends[1:][some] - 1] = part[ends[1:][some] - 1]
    begin = np.flatnonzero(begins)
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(np.flatnonzero(stops) + 1 - begin, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[part]))
    return words, np.diff(np.searchsorted(begin, ends))


def pieces(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(ids, words, words a row) of rows (id, lower-cased text) in pieces of BYTES_AT_ONCE."""
    of_words = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        ends, start = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [], 0
        while start < len(ids):
            stop = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + BYTES_AT_ONCE, "right")) - 1)
            yield ids.slice(start, stop - start), *cut(texts.slice(start, stop - start), of_words)
            start = stop


def _sorted(words: pa.Array, size: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words in order; of each run of one word in one row the word's number, the row and where its places begin; all places."""
    coded = words.dictionary_encode()
    by_word = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(by_word), np.int64)
    rank[np.asarray(by_word)] = np.arange(len(by_word))
    # Words stand in order of rows and places, so their numbers put in order of the words alone are in order of all three.
    key = np.sort(rank[np.asarray(coded.indices)] << 32 | np.arange(len(words)))
    code, order = key >> 32, key & 0xFFFFFFFF
    row = np.repeat(np.arange(len(size)), size)[order]
    place = (order - (np.cumsum(size) - size)[row]).astype(np.int32)
    first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    return coded.dictionary.take(by_word), code[first], row[first], first, place


def runs_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, pos, len) of rows (doc_id, words): the places of each distinct word of a document, ascending.

    Batches leave in order of their words: sorted runs are merged with fewer comparisons than rows in any order are sorted.
    """
    for batch in batches:
        docs, lists = batch.column(0), batch.column(1)
        ends, start = np.asarray(lists.offsets), 0
        while start < len(docs):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + AT_ONCE, "right")) - 1)
            size = np.diff(ends[start : stop + 1])
            words, code, row, first, place = _sorted(lists.slice(start, stop - start).flatten(), size)
            pos = pa.ListArray.from_arrays(pa.array(np.append(first, len(place)), pa.int32()), pa.array(place))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(code)), docs.take(pa.array(row + start)), pos, pa.array(size[row], pa.int32())], ["term", "doc_id", "pos", "len"])
            start = stop


#: Rows of blocks_of_words; numbered so that those of a word go round the tasks that write its bucket.
BLOCK = "term string, docs array<long>, lens array<int>, ends array<int>, pos array<int>, piece int"


def blocks_of_words(bits: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes BLOCK rows of rows (doc_id, lower-cased text): one for each distinct word of a piece of texts, with the word's documents,
    their lengths, where each one's places end in pos, and all places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        for docs, flat, size in pieces(batches, bits):
            if not len(flat):
                continue
            words, code, row, first, place = _sorted(flat, size)
            block = np.flatnonzero(np.diff(code, prepend=-1))  # the first run of each word
            listed = lambda at, values, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
            of_runs, end = np.append(block, len(code)), np.append(first[1:], len(place))
            ends = end - np.repeat(first[block], np.diff(of_runs))
            own = [
                words, listed(of_runs, docs.take(pa.array(row)), pa.int64()), listed(of_runs, size[row], pa.int32()), listed(of_runs, ends, pa.int32()),
                listed(np.append(first[block], len(place)), place, pa.int32()), pa.array(np.full(len(words), piece), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(own, ["term", "docs", "lens", "ends", "pos", "piece"])
            piece += 1

    return run


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.store = Store(spark, [f"{sf_dir}/documents.parquet"])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def files(self) -> DataFrame:
        """Every file without its text, from the store."""
        return self.store.table("files", lambda: self.texts.drop("text"))

    @cached_property
    def texts(self) -> DataFrame:
        """Every file with its text."""
        d = F.col("doc_id")
        ext = F.element_at(F.lit(list(EXTENSIONS)), (d % 8 + 1).cast("int"))
        parent = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang")
        mtime = F.lit(BASE_NS) - ((d * 7919) % 1000) * F.lit(DAY_NS)
        status = (
            F.when(d % 20 == 0, "PENDING").when(d % 20 == 1, "SKIPPED").when(d % 20 == 2, "FAILED")
            .when(d % 20 == 3, "NAME_ONLY").otherwise("INDEXED")
        )
        rows = self.table("documents").select(
            d.alias("id"), ext.alias("ext"), parent.alias("parent_dir"), (F.col("n_chars") * (1 + d % 5)).alias("size_bytes"),
            mtime.alias("mtime_ns"), F.when(d % 10 != 9, F.md5(F.col("text").cast("binary"))).alias("content_hash"), status.alias("status"),
            F.when(d % 4 == 0, d % 3 + 1).alias("volume_id"), (d % 7).alias("_r"), "lang", "source", "text",
        )
        skip = F.when(F.col("status") == "SKIPPED", F.when(F.col("id") % 3 == 0, "TOO_LARGE").otherwise("TIMEOUT")).when(F.col("status") == "FAILED", "READ_ERROR")
        return rows.select(
            "id", F.concat("parent_dir", F.lit("/doc_"), F.col("id").cast("string"), F.lit("."), "ext").alias("path"), "parent_dir", "ext",
            "size_bytes", "mtime_ns", F.when(F.col("ext") == "jpg", F.col("mtime_ns") - 30 * DAY_NS).alias("taken_at_ns"), "content_hash",
            "status", skip.alias("skip_code"), F.when(F.col("ext") == "eml", "eml").otherwise("file").alias("source_kind"),
            F.when(F.col("ext") == "py", F.col("_r")).alias("repo_id"), "volume_id", "lang", "source", "text",
        )

    @cached_property
    def chunks(self) -> DataFrame:
        """Non-blank lines of texts; ordinal is a line's place before blank ones are dropped."""
        lines = self.table("documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
        return lines.filter(F.trim("text") != "").select(
            (F.col("file_id") * 100000 + F.col("ordinal")).alias("id"), "file_id", F.col("ordinal").cast("long").alias("ordinal"), "text"
        )

    @cached_property
    def messages(self) -> DataFrame:
        file_id = F.col("conv_id") * 1000 + F.col("turn")
        other = F.when(F.col("role") == "user", "assistant").otherwise("user")
        at = lambda who: F.concat(who, F.lit("@example.com"))
        archive = F.concat(F.lit("/mail/archive_"), (F.col("conv_id") % 10).cast("string"), F.lit(".mbox"))
        folder = F.when(F.col("turn") % 4 == 0, "Inbox").when(F.col("turn") % 4 == 1, "Inbox/Work").when(F.col("turn") % 4 == 2, "Sent Items").otherwise("Archive")
        return self.table("conversations").select(
            (file_id + MAIL_ID).alias("mail_id"), archive.alias("archive"), folder.alias("folder"), F.concat(archive, F.lit("/message_"), file_id.cast("string"), F.lit(".eml")).alias("path"),
            F.concat(F.lit("report_"), F.col("turn").cast("string"), F.lit(".pdf")).alias("attachment"), F.concat(F.lit("<M"), file_id.cast("string"), F.lit("@Example.com>")).alias("message_id"),
            file_id.alias("file_id"), F.col("conv_id").alias("conversation"), at(F.col("role")).alias("sender"), F.array(at(other)).alias("recipients"),
            F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("subject"),
            F.when(file_id % 17 != 0, 1704067200 + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("sent_at"),
            (F.col("turn") % 3 == 0).alias("has_attach"), "turn", "text",
        )

    @cached_property
    def bodies(self) -> DataFrame:
        """(id, text) of files and messages."""
        own = self.table("documents").select(F.col("doc_id").alias("id"), "text")
        return own.unionByName(self.messages.select(F.col("mail_id").alias("id"), "text"))

    @cached_property
    def repos(self) -> DataFrame:
        rows = [(k, f"repo_{k}", f"/corpus/src{k}") for k in range(7)]
        return self.spark.createDataFrame(rows, "id long, name string, root_path string")

    @cached_property
    def volumes(self) -> DataFrame:
        rows = [(1, "Archive disk", "drive", "ONLINE"), (2, "Office share", "network", "OFFLINE"), (3, "Old laptop", "archived", "ARCHIVED")]
        return self.spark.createDataFrame(rows, "id long, name string, kind string, state string")

    @cached_property
    def file_tags(self) -> DataFrame:
        docs = self.table("documents")
        marked = self.table("labels").filter("quality = 1").select(F.col("doc_id").alias("file_id"), F.lit("quality").alias("tag"))
        return (
            docs.select(F.col("doc_id").alias("file_id"), F.col("lang").alias("tag"))
            .unionByName(docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("tag"))).unionByName(marked)
        )

    @cached_property
    def listing(self) -> DataFrame:
        """Files, messages and attachments as rows of one list; place is where a picture was taken."""
        nothing = lambda kind: F.lit(None).cast(kind)
        place = F.when(F.col("ext") == "jpg", F.get(F.lit(list(PLACES)), F.expr("cast(id div 8 % 5 as int)")))
        own = self.files.select("id", "path", "ext", "size_bytes", "mtime_ns", "taken_at_ns", "status", "source_kind", "repo_id", "volume_id", place.alias("place"))
        m = self.messages
        row = lambda df, id_, path, ext, kind: df.select(
            id_.alias("id"), path.alias("path"), F.lit(ext).alias("ext"), F.length("text").cast("long").alias("size_bytes"), (F.col("sent_at") * 1_000_000_000).alias("mtime_ns"),
            nothing("long").alias("taken_at_ns"), F.lit("INDEXED").alias("status"), F.lit(kind).alias("source_kind"), nothing("long").alias("repo_id"), nothing("long").alias("volume_id"),
            nothing("string").alias("place"),
        )
        mail = row(m, F.col("mail_id"), F.col("path"), "eml", "eml")
        attached = m.filter("has_attach")
        parts = row(attached, F.col("file_id") + ATTACHMENT_ID, F.concat("path", F.lit("/attachments/"), "attachment"), "pdf", "file")
        return own.unionByName(mail).unionByName(parts)

    @cached_property
    def piles(self) -> DataFrame:
        """Groups of faces, some of them named."""
        labels = self.table("embeddings").select(F.col("label").cast("long").alias("id")).distinct()
        return labels.select("id", F.when(F.col("id") % 3 != 2, F.concat(F.lit("Person "), F.col("id").cast("string"))).alias("name"))

    @cached_property
    def faces(self) -> DataFrame:
        """(face, file_id, pile): the faces in pictures; two fifths are in no pile yet."""
        v = F.col("vec_id")
        return self.table("embeddings").select(v.alias("face"), (v - v % 8 + 5).alias("file_id"), F.when(v % 5 < 3, F.col("label").cast("long")).alias("pile"))

    @property
    def indexed(self) -> bool:
        """Whether the postings are stored."""
        return self.store.has("blocks")

    @property
    def listed(self) -> bool:
        """Whether the vocabulary is stored, or what it is made from."""
        return self.store.has("vocabulary") or self.indexed

    @property
    def buckets(self) -> int:
        """Folders that the postings are dealt to by a hash of the word, so that a search reads few of them."""
        _ = self.store.folder
        return max(8, min(4096, self.store.bytes // BUCKET_BYTES))

    def bucket(self, term: str | Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets))

    @cached_property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf, pos, len, b): a word's places in each document, with the document's length.

        Read from the stored blocks; a search that needs no places doesn't read them.
        """
        i = F.col("i")
        begin = F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
        tf = F.get("ends", i) - begin
        opened = self.blocks.select("term", "lens", "ends", "pos", "b", F.posexplode("docs").alias("i", "doc_id"))
        return opened.select("term", "doc_id", tf.cast("long").alias("tf"), F.slice("pos", begin + 1, tf).alias("pos"), F.get("lens", i).cast("long").alias("len"), "b")

    @cached_property
    def blocks(self) -> DataFrame:
        """(term, docs, lens, ends, pos, b): the postings of a word in many documents as one row, so that rows of words are
        what is shuffled, sorted and written, not words of documents."""

        def build() -> DataFrame:
            docs = self.table("documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
            rows = docs.filter("text != ''").mapInArrow(blocks_of_words(letters(self.spark)), BLOCK)
            return self._dealt(rows.withColumn("b", self.bucket("term")), F.col("piece")).sortWithinPartitions("b", "term").drop("piece")

        return self.store.table("blocks", build, "b")

    def _dealt(self, rows: DataFrame, by: Column) -> DataFrame:
        """A task writes one part of one bucket, so what it sorts doesn't grow with the input; a common word's bucket is written by several."""
        parts = max(1, min(MOST_PARTS, self.store.bytes // BUCKET_BYTES))
        task = F.col("b") * parts + F.pmod(by, F.lit(parts))
        return rows.repartitionById(self.buckets * parts, task.cast("int"))

    def posting_rows(self) -> DataFrame:
        """The postings to be stored as rows, for tables that rows are taken out of."""
        return self._dealt(self.posted(), F.xxhash64("doc_id")).sortWithinPartitions("b", "term", "doc_id")

    def posted(self) -> DataFrame:
        return self._counted(self._runs())

    def _counted(self, runs: DataFrame) -> DataFrame:
        """What rows say of themselves is added after they are shuffled."""
        return runs.select("term", "doc_id", F.size("pos").cast("long").alias("tf"), "pos", F.col("len").cast("long").alias("len"), self.bucket("term").alias("b"))

    def _runs(self) -> DataFrame:
        """The postings of the documents, made from their texts; each distinct word leaves its document as one row and nothing is aggregated."""
        words = F.filter(F.split(F.lower("text"), WORD_BREAK), lambda w: w != "")
        docs = self.table("documents").select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("w"))
        return docs.filter(F.size("w") > 0).mapInArrow(runs_of_words, "term string, doc_id long, pos array<int>, len int")

    def counted(self, keep: Callable[[Column], Column], pieces: Sequence[str]) -> DataFrame:
        """(term, doc_id, tf) of the words that keep is true of, from the texts themselves. Each such word holds one of the
        pieces: texts without any aren't cut. Only these words become rows; where pieces are empty, all texts are cut."""
        text = F.lower("text")
        docs = self.table("documents")
        if pieces:
            docs = docs.filter(reduce(Column.__or__, [text.contains(p) for p in pieces]))
        words = F.filter(F.split(text, WORD_BREAK), lambda w: (w != "") & keep(w))
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(words).alias("term"))
        return found.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        """(term, df): documents that a word is in."""
        return self.store.table("vocabulary", lambda: self.blocks.groupBy("term").agg(F.sum(F.size("docs")).alias("df")))

    def frequencies(self, asked: DataFrame, hits: DataFrame) -> DataFrame:
        """(term, df) of the asked words; hits: their postings."""
        return asked.join(self.vocabulary, "term")

    @cached_property
    def tokens(self) -> DataFrame:
        """(doc_id, pos, term): every word of every document, lower-cased."""
        return self.postings.select("doc_id", "term", F.explode("pos").alias("pos"))

    @cached_property
    def lengths(self) -> DataFrame:
        """(doc_id, len): words a document, empty ones too."""
        return self.store.table("lengths", self.measured)

    def measured(self) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), WORD_BREAK), lambda w: w != "")
        return self.table("documents").select("doc_id", F.size(words).cast("long").alias("len"))

    def build_index(self) -> None:
        """Writes what isn't stored yet."""
        for table in (self.files, self.blocks, self.vocabulary, self.lengths):
            table.schema  # noqa: B018

    @cached_property
    def searches(self) -> DataFrame:
        """(qid, term): the distinct ones of the first words of each benchmark passage."""
        words = F.filter(F.split(F.lower("text"), WORD_BREAK), lambda w: w != "")
        first = F.array_distinct(F.slice(words, 1, 12))
        return self.table("benchmark").select(F.col("item_id").alias("qid"), F.explode(first).alias("term"))

    @cached_property
    def contacts(self) -> DataFrame:
        def cards(name: str, prefix: str, key: str, company: Column, offset: int) -> DataFrame:
            display = F.when(F.col(key) % 50 == 0, F.concat(F.lit(prefix), F.lit(" Zero"))).otherwise(F.col(f"{prefix[0].lower()}_name"))
            return self.table(name).select((F.col(key) + offset).alias("id"), display.alias("name"), company.alias("company"))

        rows = cards("customer", "Customer", "c_custkey", F.col("c_mktsegment"), 0).unionByName(cards("supplier", "Supplier", "s_suppkey", F.lit("SUPPLY"), 1_000_000))
        email = F.concat(F.lower(F.regexp_replace("name", "[^A-Za-z0-9]+", ".")), F.lit("@example.com"))
        return rows.select("id", "name", "company", email.alias("email"))


_FILES = f"""
SELECT id, parent_dir || '/doc_' || id || '.' || ext AS path, parent_dir, ext, size_bytes, mtime_ns,
  CASE WHEN ext = 'jpg' THEN mtime_ns - 30 * {DAY_NS} END AS taken_at_ns, content_hash, status,
  CASE WHEN status = 'SKIPPED' THEN CASE WHEN id % 3 = 0 THEN 'TOO_LARGE' ELSE 'TIMEOUT' END WHEN status = 'FAILED' THEN 'READ_ERROR' END AS skip_code,
  CASE WHEN ext = 'eml' THEN 'eml' ELSE 'file' END AS source_kind, CASE WHEN ext = 'py' THEN id % 7 END AS repo_id, volume_id, lang, source, text
FROM (SELECT doc_id AS id, {list(EXTENSIONS)}[CAST(doc_id % 8 + 1 AS INT)] AS ext, '/corpus/' || source || '/' || lang AS parent_dir,
  n_chars * (1 + doc_id % 5) AS size_bytes, {BASE_NS} - ((doc_id * 7919) % 1000) * {DAY_NS} AS mtime_ns,
  CASE WHEN doc_id % 10 <> 9 THEN md5(text) END AS content_hash,
  CASE doc_id % 20 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'SKIPPED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'NAME_ONLY' ELSE 'INDEXED' END AS status,
  CASE WHEN doc_id % 4 = 0 THEN doc_id % 3 + 1 END AS volume_id, lang, source, text FROM documents)"""

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

#: The same entities in DuckDB SQL.
SQL_VIEWS = {
    "files": _FILES,
    "chunks": "SELECT doc_id * 100000 + i - 1 AS id, doc_id AS file_id, i - 1 AS ordinal, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line, ' ') <> ''",
    "messages": f"SELECT {MAIL_ID} + conv_id * 1000 + turn AS mail_id, '/mail/archive_' || (conv_id % 10) || '.mbox' AS archive, CASE turn % 4 WHEN 0 THEN 'Inbox' WHEN 1 THEN 'Inbox/Work' WHEN 2 THEN 'Sent Items' ELSE 'Archive' END AS folder, '/mail/archive_' || (conv_id % 10) || '.mbox/message_' || (conv_id * 1000 + turn) || '.eml' AS path, 'report_' || turn || '.pdf' AS attachment, '<M' || (conv_id * 1000 + turn) || '@Example.com>' AS message_id, conv_id * 1000 + turn AS file_id, conv_id AS conversation, role || '@example.com' AS sender, [CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END || '@example.com'] AS recipients, 'Conversation ' || conv_id AS subject, CASE WHEN (conv_id * 1000 + turn) % 17 <> 0 THEN 1704067200 + conv_id * 3600 + turn * 60 END AS sent_at, turn % 3 = 0 AS has_attach, turn, text FROM conversations",
    "listing": f"SELECT id, path, ext, size_bytes, mtime_ns, taken_at_ns, status, source_kind, repo_id, volume_id, CASE WHEN ext = 'jpg' THEN {list(PLACES)}[CAST(id // 8 % 5 AS INT) + 1] END AS place FROM files UNION ALL SELECT mail_id, path, 'eml', length(text), sent_at * 1000000000, NULL, 'INDEXED', 'eml', NULL, NULL, NULL FROM messages UNION ALL SELECT {ATTACHMENT_ID} + file_id, path || '/attachments/' || attachment, 'pdf', length(text), sent_at * 1000000000, NULL, 'INDEXED', 'file', NULL, NULL, NULL FROM messages WHERE has_attach",
    "piles": "SELECT DISTINCT CAST(label AS BIGINT) AS id, CASE WHEN label % 3 <> 2 THEN 'Person ' || label END AS name FROM embeddings",
    "faces": "SELECT vec_id AS face, vec_id - vec_id % 8 + 5 AS file_id, CASE WHEN vec_id % 5 < 3 THEN CAST(label AS BIGINT) END AS pile FROM embeddings",
    "repos": "SELECT k AS id, 'repo_' || k AS name, '/corpus/src' || k AS root_path FROM range(7) t(k)",
    "volumes": "SELECT * FROM (VALUES (1, 'Archive disk', 'drive', 'ONLINE'), (2, 'Office share', 'network', 'OFFLINE'), (3, 'Old laptop', 'archived', 'ARCHIVED')) t(id, name, kind, state)",
    "file_tags": "SELECT doc_id AS file_id, lang AS tag FROM documents UNION ALL SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, 'quality' FROM labels WHERE quality = 1",
    "tokens": f"SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {_WORDS} AS w FROM documents)",
    "postings": "SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY ALL",
    "lengths": f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS len FROM documents",
    "searches": f"SELECT DISTINCT item_id AS qid, unnest(({_WORDS})[1:12]) AS term FROM benchmark",
    "contacts": "SELECT id, name, company, lower(regexp_replace(name, '[^A-Za-z0-9]+', '.', 'g')) || '@example.com' AS email FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN 'Customer Zero' ELSE c_name END AS name, c_mktsegment AS company FROM customer UNION ALL SELECT s_suppkey + 1000000, CASE WHEN s_suppkey % 50 = 0 THEN 'Supplier Zero' ELSE s_name END, 'SUPPLY' FROM supplier)",
}
