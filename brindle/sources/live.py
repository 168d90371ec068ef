"""The stored index kept up to date: changed documents become new rows of all derived tables at once."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.corpus import Corpus
from brindle.sources.generations import Generations, Manifest
from brindle.sources.store import shared_dir

#: Table, key of the file that its rows belong to, bucket column and order in a bucket.
TABLES = {
    "files": ("id", None, ()), "passages": ("file_id", None, ()), "tags": ("file_id", None, ()), "lengths": ("doc_id", None, ()), "vectors": ("file_id", None, ()),
    "postings": ("doc_id", "b", ("term", "doc_id")),
}
#: Vectors of a file; the vectors' ids are numbered through.
VECTORS_A_FILE = 10


class Changed(Corpus):
    """The corpus of some documents alone, for what is derived from them."""

    def __init__(self, whole: Corpus, documents: DataFrame):
        super().__init__(whole.spark, whole.sf_dir)
        self._whole, self._documents = whole, documents

    def table(self, name: str) -> DataFrame:
        return self._documents if name == "documents" else super().table(name)

    @property
    def buckets(self) -> int:
        return self._whole.buckets


def passages(c: Corpus) -> DataFrame:
    return c.chunks.select("id", "file_id", "ordinal", F.length("text").alias("n_chars"))


def derived(c: Corpus) -> dict[str, DataFrame]:
    """What a corpus's documents give for each table but the vectors, which are made elsewhere."""
    return {"files": c.texts.drop("text"), "passages": passages(c), "tags": c.file_tags, "lengths": c.measured(), "postings": c.posted()}


class LiveIndex:
    """The derived tables of a corpus under generations of their own, beginning with the stored index as it is."""

    def __init__(self, corpus: Corpus, folder: str | None = None):
        self.corpus = corpus
        self.generations = Generations(corpus.spark, folder or f"{shared_dir(corpus.spark)}/live-{uuid.uuid4().hex}")
        if not self.generations.newest().tables:
            self.generations.create({n: (self._stored(n), *how) for n, how in TABLES.items()})

    def _stored(self, name: str) -> str:
        c = self.corpus
        own = {
            "files": lambda: c.files,
            "lengths": lambda: c.lengths,
            "postings": lambda: c.store.table("postings", c.posting_rows, "b"),
            "passages": lambda: c.store.table("passages", lambda: passages(c)),
            "tags": lambda: c.store.table("tags", lambda: c.file_tags),
            "vectors": lambda: c.store.table("vectors", lambda: vectors_of(c)),
        }[name]
        own().schema  # noqa: B018  written if it isn't there
        return f"{c.store.folder}/{name}"

    def change(self, documents: DataFrame | None = None, gone: DataFrame | None = None) -> Manifest:
        """Documents (rows of the documents table) replace those of their doc_id or are new; the ids in `gone` go.
        All tables follow in one generation. Vectors of a changed file go until new ones are appended."""
        rows, out = {}, gone.toDF("key") if gone is not None else None
        if documents is not None:
            rows = derived(Changed(self.corpus, documents))
            ids = documents.select(F.col("doc_id").alias("key"))
            out = ids if out is None else out.unionByName(ids)
        return self.generations.write(rows, out)

    def append_vectors(self, batch: DataFrame) -> Manifest:
        """Adds (id, file_id, embedding) rows but those of another length than the stored vectors', or unusable."""
        stored = self.rows("vectors").select(F.size("embedding").alias("n")).limit(1).collect()
        fits = F.size("embedding") == stored[0]["n"] if stored else F.size("embedding") > 0
        whole = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return self.generations.write({"vectors": batch.filter(fits & whole)})

    def compact(self) -> Manifest:
        """Rewrites the buckets of postings that have rows in several folders; others stay as they are."""
        m = self.generations.newest()
        touched = self.generations.touched(m, "postings")
        return self.generations.compact("postings", touched) if touched else m

    def rows(self, name: str, at: Manifest | None = None) -> DataFrame:
        return self.generations.rows(at or self.generations.newest(), name)

    def reader(self, at: Manifest | None = None) -> LiveCorpus:
        """A corpus that all searches run on, as of one generation."""
        return LiveCorpus(self, at or self.generations.newest())


class LiveCorpus(Corpus):
    def __init__(self, index: LiveIndex, at: Manifest):
        super().__init__(index.corpus.spark, index.corpus.sf_dir)
        self._index, self.at = index, at

    @property
    def indexed(self) -> bool:
        return True

    @property
    def listed(self) -> bool:
        return True

    @property
    def buckets(self) -> int:
        return self._index.corpus.buckets

    @cached_property
    def files(self) -> DataFrame:
        return self._index.rows("files", self.at)

    @cached_property
    def postings(self) -> DataFrame:
        return self._index.rows("postings", self.at)

    @cached_property
    def lengths(self) -> DataFrame:
        return self._index.rows("lengths", self.at)

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def frequencies(self, asked: DataFrame, hits: DataFrame) -> DataFrame:
        # The asked words' postings tell it; no other word's are read.
        return hits.groupBy("term").agg(F.count("*").alias("df"))


def vectors_of(c: Corpus) -> DataFrame:
    return c.table("embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / VECTORS_A_FILE).alias("file_id"), "embedding")
