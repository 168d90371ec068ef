"""Byte-level BPE encoding and decoding by speculation and verification.

Each distinct word of a batch first gets the tokens of a greedy longest match. A sequence is
what the merges would give exactly when every adjacent pair of it is (the pair's joined bytes
encode to those two tokens), so all adjacent pairs of all words are looked up at once in a
table of pairs that have been tried, and only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.columns import given, named, quoted
from brindle.llm.scratch import bound_batches

#: Fixed value: the split that the public byte-level vocabulary was made with.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split for texts of Latin-1 letters alone, in which the classes are short lists.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_SPLIT = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Encoded words that a worker keeps; beyond that it starts anew.
KEPT_WORDS = 250_000
#: Up to this many bytes a word's pairs are scanned, beyond it they are kept in a heap.
SHORT = 40
UNRANKED = 1 << 60
#: Characters of text that are encoded at once.
AT_ONCE = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else one from 256 up."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def token_table(spec: dict) -> list[bytes]:
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    out = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in vocab.items():
        out[i] = bytes(letters[c] for c in token)
    for content, i in special.items():
        out[i] = content.encode()
    return out


class ByteBPE:
    """A vocabulary file of the tokenizers library, of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.token_bytes = token_table(spec)
        self.byte_ids = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        #: Every prefix of a token, with the token's id or -1.
        self.prefixes: dict[bytes, int] = {}
        for i in vocab.values():
            token = self.token_bytes[i]
            for k in range(1, len(token)):
                self.prefixes.setdefault(token[:k], -1)
            self.prefixes[token] = i
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.forget()
        self.tried = np.empty(0, np.int64)  # pairs, in order
        self.fits = np.empty(0, bool)

    def merged(self, word: bytes) -> list[int]:
        """The exact merges of a word: lowest rank first, leftmost first among equals."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        if n <= SHORT:
            return self._merged_short(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def _merged_short(self, ids: list[int]) -> list[int]:
        find = self.merges.get
        found = [find(p) for p in zip(ids, ids[1:], strict=False)]
        while True:
            rank, at = UNRANKED, -1
            for i, m in enumerate(found):
                if m is not None and m[0] < rank:
                    rank, at = m[0], i
            if at < 0:
                return ids
            ids[at] = found[at][1]
            del ids[at + 1], found[at]
            if at:
                found[at - 1] = find((ids[at - 1], ids[at]))
            if at < len(found):
                found[at] = find((ids[at], ids[at + 1]))

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, known = [], 0, len(word), self.prefixes
        while i < n:
            best, end, k = -1, i + 1, i + 1
            while k <= n and (t := known.get(word[i:k])) is not None:
                if t >= 0:
                    best, end = t, k
                k += 1
            out.append(best)
            i = end
        return out

    def pairs_fit(self, pairs: np.ndarray) -> np.ndarray:
        """Of each pair (first * size + second), whether its joined bytes encode to just these two."""
        if len(self.tried) > 2 * KEPT_WORDS:
            self.tried, self.fits = self.tried[:0], self.fits[:0]
        size = len(self.token_bytes)
        wanted, place = np.unique(pairs, return_inverse=True)
        new = wanted[~np.isin(wanted, self.tried, assume_unique=True)]
        if len(new):
            fits = [self.merged(self.token_bytes[a] + self.token_bytes[b]) == [a, b] for a, b in zip((new // size).tolist(), (new % size).tolist(), strict=True)]
            tried = np.concatenate([self.tried, new])
            order = np.argsort(tried)
            self.tried, self.fits = tried[order], np.concatenate([self.fits, np.array(fits, bool)])[order]
        return self.fits[np.searchsorted(self.tried, wanted)][place]

    def forget(self) -> None:
        #: A word's number; the ids of word k are known[first[k]:first[k] + count[k]].
        self.words: dict[str, int] = {}
        self.known, self.first, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet."""
        raw = [w.encode() for w in words]
        guess = [self.proposed(w) for w in raw]
        ids = np.fromiter(chain.from_iterable(guess), np.int64, sum(map(len, guess)))
        owner = np.repeat(np.arange(len(guess)), [len(g) for g in guess])
        inside = owner[1:] == owner[:-1] if len(owner) else np.empty(0, bool)
        size = len(self.token_bytes)
        failing = np.zeros(len(guess), bool)
        failing[owner[1:][inside][~self.pairs_fit((ids[:-1] * size + ids[1:])[inside])]] = True
        for i in range(len(words)):
            if failing[i] or len(guess[i]) == 1 < len(raw[i]):
                guess[i] = self.merged(raw[i])
        count = np.fromiter(map(len, guess), np.int64, len(guess))
        self.first = np.concatenate([self.first, len(self.known) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.known = np.concatenate([self.known, np.fromiter(chain.from_iterable(guess), np.int32, int(count.sum()))])
        at = len(self.words)
        self.words.update(zip(words, range(at, at + len(words)), strict=True))

    def pieces_of(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return LATIN_SPLIT.findall(text)
        except UnicodeEncodeError:
            return self.split.findall(text)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of them each text has."""
        pieces = [[w for part, i in self._around_specials(t) for w in ([part] if i is not None else self.pieces_of(part))] if self._has_special(t) else self.pieces_of(t) for t in texts]
        wanted = set(chain.from_iterable(pieces))
        if len(self.words) + len(wanted) > KEPT_WORDS:
            self.forget()
        self.learn([w for w in wanted if w not in self.words and w not in self.special])
        for w in wanted & self.special.keys():
            if w not in self.words:  # no piece of ordinary text is a special token's string
                self.first, self.count = np.append(self.first, len(self.known)), np.append(self.count, 1)
                self.known = np.append(self.known, np.int32(self.special[w]))
                self.words[w] = len(self.words)
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        word = np.fromiter(map(self.words.__getitem__, chain.from_iterable(pieces)), np.int64, int(n.sum()))
        count = self.count[word]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.known[np.repeat(self.first[word] - total[:-1], count) + np.arange(total[-1])]
        ends = total[np.cumsum(n)]
        return ids, np.diff(ends, prepend=0)

    def _has_special(self, text: str) -> bool:
        return self.at_special is not None and self.at_special.search(text) is not None

    def _around_specials(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        for m in self.at_special.finditer(text):
            yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        yield text[at:], None

    def decode(self, ids: Iterable[int]) -> str:
        return text_of(self.token_bytes, ids)


def text_of(token_bytes: list[bytes], ids: Iterable[int]) -> str:
    return b"".join(map(token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


@functools.lru_cache(maxsize=2)
def tokens(path: str) -> list[bytes]:
    """The bytes of each token: all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        return token_table(json.load(f))


def _runs(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in their order, null as empty, in runs of about AT_ONCE characters."""
    sizes = pa.compute.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    runs = np.cumsum(sizes) // AT_ONCE
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(runs, runs[start], side="right"))
        yield [t or "" for t in texts.slice(start, stop - start).to_pylist()]
        start = stop


def encoded(text: Column, path: str) -> Column:
    """array<int> of token ids; a null text counts as empty and has no tokens."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(path)
        for batch in batches:
            yield _ids_of(bpe, batch)

    return encode(text)


def _ids_of(bpe: ByteBPE, batch: pa.Array) -> pa.ListArray:
    found = [bpe.encode_batch(run) for run in _runs(batch)]
    counts = np.concatenate([c for _, c in found]) if found else np.empty(0, np.int64)
    flat = np.concatenate([i for i, _ in found]) if found else np.empty(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def _rows(batch: pa.Array) -> Iterator[list[int]]:
    flat, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_pylist()
    return (flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False))


def decoded(ids: Column, path: str) -> Column:
    """The text of token ids; bytes that are no UTF-8 become U+FFFD, a null array an empty text."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = tokens(path)
        for batch in batches:
            yield pa.array([text_of(table, row) for row in _rows(batch)], pa.string())

    return decode(ids)


def recoded(text: Column, path: str) -> Column:
    """struct<ids, decoded>: the token ids of a text and the text that they decode to, by one worker instead of two in a row."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def recode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(path)
        for batch in batches:
            ids = _ids_of(bpe, batch)
            back = pa.array((text_of(bpe.token_bytes, row) for row in _rows(ids)), pa.string(), size=len(ids))
            yield pa.StructArray.from_arrays([ids, back], ["ids", "decoded"])

    return recode(text)


def digested(ids: Column, path: str) -> Column:
    """SHA-256 of the decimal ids, comma-joined, and of the text that the ids decode to."""

    @F.arrow_udf("struct<ids:string,decoded:string>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = tokens(path)
        decimal = [str(i) for i in range(len(table))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            both = [(sha(",".join(map(decimal.__getitem__, row))), sha(text_of(table, row))) for row in _rows(batch)]
            columns = [pa.array([x[i] for x in both], pa.string()) for i in (0, 1)]
            yield pa.StructArray.from_arrays(columns, ["ids", "decoded"])

    return digest(ids)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column `ids`, which replaces one of that name. Narrow: no shuffle, each row by
    itself, repeated rows alike; null texts have no ids, an empty table gives an empty result."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(ids, encoded(F.col(text), path))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the column `text` made from `ids`."""
    return docs.withColumn(text, decoded(F.col(ids), path))


def recode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """docs with `ids` and `back`, as decode(encode(docs)) gives them."""
    bound_batches(docs.sparkSession)
    made = recoded(F.col(quoted(text)), path)
    rest = [c for c in docs.columns if c.lower() not in (ids.lower(), back.lower())]
    out = docs.select(given(docs, rest), made.alias("r"))
    return out.select(*named(rest), F.col("r.ids").alias(ids), F.col("r.decoded").alias(back))


def digests(encoded_docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds n_tokens, ids_sha256 (decimal ids, comma-joined) and decoded_sha256, which replace columns of
    those names; drops the ids."""
    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    rest = [c for c in encoded_docs.columns if c != ids]
    out = encoded_docs.select(given(encoded_docs, rest), F.size(ids).cast("long").alias("n_tokens"), digested(F.col(ids), path).alias("d"))
    return out.select(*named(rest, *new), "n_tokens", F.col("d.ids").alias("ids_sha256"), F.col("d.decoded").alias("decoded_sha256"))
