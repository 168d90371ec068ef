"""Main texts of web pages by wrapper induction.

Pages of one host are made by one template. A page becomes a tree of blocks; the tree of the
commonest kind of page of a host is what all of the host's trees are aligned with, by simple tree
matching. A block of the article whose text stays the same over nearly all different pages that
have it is the template's; slots whose text varies hold the content. Menus, headers, footers,
sidebars, forms and the like are known by their elements and classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import dom
from brindle.llm.columns import given, named, quoted
from brindle.llm.scratch import Scratch

#: A slot is the template's if its text is the same in this share of at least so many different pages.
CONSTANT = 0.8
LEAST_PAGES = 3
#: Share of a block's characters in links from which it is an entry of a menu, if so many follow each other.
LINKED = 0.8
MENU = 3
#: Hosts with over one in so many pages are dealt in parts, so that at most this many are named.
HOT = 200

_PA_TREE = pa.struct(
    [("tags", pa.list_(pa.string())), ("parents", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))]
)
_TREE = "struct<tags:array<string>,parents:array<int>,hashes:array<bigint>,sizes:array<int>>"
#: Rows that are Python objects at once.
_AT_ONCE = 256


def host_of(url: Column) -> Column:
    """What stands between :// and the next slash, question mark or number sign, lower-cased; null if nothing does."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    return F.when(host != "", host)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def content(tree: dom.Tree) -> list[bool]:
    """Whether each block may be content. Where articles have any text, theirs is; else all that isn't aside,
    without menus, which are runs of links."""
    said = [bool(t) and not a for t, a in zip(tree.text, tree.aside, strict=True)]
    inside = [s and i for s, i in zip(said, tree.inside, strict=True)]
    if any(inside):
        return inside
    run: list[int] = []
    for n in [*(n for n, s in enumerate(said) if s), -1]:
        if n >= 0 and tree.linked[n] >= LINKED * len(tree.text[n]):
            run.append(n)
            continue
        if len(run) >= MENU:
            for k in run:
                said[k] = False
        run = []
    return said


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _AT_ONCE):
            yield batch.slice(start, _AT_ONCE)


def parsed(pages: DataFrame) -> DataFrame:
    """(host, whole, spread, tree, sig, content) of (host, whole, spread, _html).

    A tree has each block's tag, parent, hash of its text and, where it may be content, its size in
    characters (else 0). What lies in blocks that aren't content is left out, but for themselves.
    sig is a hash of the tree's kind and content one of the texts that may be content.
    """
    schema = pa.schema([("tree", _PA_TREE), ("sig", pa.int64()), ("content", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            rows = []
            for page in part.column("_html").to_pylist():
                tree = dom.parse(page)
                said = content(tree)
                new, kept = {-1: -1}, []
                for n, p in enumerate(tree.parent):
                    if p in new and (p < 0 or not tree.aside[p]):
                        new[n] = len(kept)
                        kept.append(n)
                tags, parents = [tree.tag[n] for n in kept], [new[tree.parent[n]] for n in kept]
                sizes = [len(tree.text[n]) * said[n] for n in kept]
                texts = "\n".join(t for t, s in zip(tree.text, said, strict=True) if s)
                made = {"tags": tags, "parents": parents, "hashes": [_hash(tree.text[n]) for n in kept], "sizes": sizes}
                rows.append({"tree": made, "sig": _hash(dom.skeleton(tags, parents)), "content": _hash(texts)})
            made = pa.Table.from_pylist(rows, schema=schema).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("host", "whole", "spread")], *made.columns], ["host", "whole", "spread", *schema.names])

    return pages.select("host", "whole", "spread", "_html").mapInArrow(run, f"host string, whole bigint, spread bigint, tree {_TREE}, sig bigint, content bigint")


def references(trees: DataFrame) -> DataFrame:
    """(host, ref): the tree that a host's pages are aligned with: of the kind that most pages have, the one
    with the fewest blocks. Each task sends one tree a host and kind."""
    schema = pa.schema([("host", pa.string()), ("sig", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("whole", pa.int64()), ("tree", _PA_TREE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple] = {}
        number: dict[tuple, int] = {}
        for batch in batches:
            tree = batch.column("tree")
            sizes = pc.list_value_length(tree.field("tags")).to_pylist()
            for i, (host, sig, whole, size) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("host", "sig", "whole")], sizes, strict=True)):
                key = (host, sig)
                number[key] = number.get(key, 0) + 1
                if key not in best or (size, whole) < best[key][:2]:
                    best[key] = (size, whole, tree[i].as_py())
        keys = list(best)
        for start in range(0, len(keys), _AT_ONCE):
            own = [{"host": k[0], "sig": k[1], "n": number[k], "size": best[k][0], "whole": best[k][1], "tree": best[k][2]} for k in keys[start : start + _AT_ONCE]]
            yield pa.Table.from_pylist(own, schema=schema).combine_chunks().to_batches()[0]

    part = trees.select("host", "sig", "whole", "tree").mapInArrow(run, f"host string, sig bigint, n bigint, size bigint, whole bigint, tree {_TREE}")
    kinds = part.groupBy("host", "sig").agg(F.sum("n").alias("n"), F.min(F.struct("size", "whole", "tree")).alias("best"))
    top = kinds.groupBy("host").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "sig", "best")).alias("top"))
    return top.filter(F.col("pages") >= LEAST_PAGES).select("host", F.col("top.best.tree").alias("ref"))


def aligned(rows: DataFrame) -> DataFrame:
    """(host, whole, content, size, slots) of trees and their host's ref: for each block that may be content and
    is aligned, its number among those, the block of ref, whether that has the same text, and its size."""
    slot = pa.list_(pa.struct([("block", pa.int32()), ("slot", pa.int32()), ("same", pa.bool_()), ("size", pa.int32())]))
    schema = pa.schema([("host", pa.string()), ("whole", pa.int64()), ("content", pa.int64()), ("size", pa.int64()), ("slots", slot)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            out, sizes = [], []
            for tree, ref in zip(part.column("tree").to_pylist(), part.column("ref").to_pylist(), strict=True):
                to = dom.match(tree["tags"], tree["parents"], tree["hashes"], ref["tags"], ref["parents"], ref["hashes"])
                said = [n for n, size in enumerate(tree["sizes"]) if size]
                same = lambda n: tree["hashes"][n] == ref["hashes"][to[n]]  # noqa: B023, E731
                out.append([{"block": k, "slot": to[n], "same": same(n), "size": tree["sizes"][n]} for k, n in enumerate(said) if to[n] >= 0])
                sizes.append(sum(tree["sizes"]))
            arrays = [part.column("host"), part.column("whole"), part.column("content"), pa.array(sizes, pa.int64()), pa.array(out, slot)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    made = "slots array<struct<block:int,slot:int,same:boolean,size:int>>"
    return rows.select("host", "whole", "content", "tree", "ref").mapInArrow(run, f"host string, whole bigint, content bigint, size bigint, {made}")


def template_slots(met: DataFrame) -> DataFrame:
    """(host, fixed): the slots whose text is the template's. Pages of equal content count once."""
    each = met.select("host", "content", F.explode("slots").alias("s"))
    once = each.groupBy("host", "content", F.col("s.slot").alias("slot")).agg(F.max(F.col("s.same").cast("int")).alias("same"))
    count = once.groupBy("host", "slot").agg(F.count("*").alias("n"), F.sum("same").alias("same"))
    constant = count.filter((F.col("n") >= LEAST_PAGES) & (F.col("same") >= CONSTANT * F.col("n")))
    return constant.groupBy("host").agg(F.collect_set("slot").alias("fixed"))  # at most a page's blocks


def _hot(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """(keys, parts) of keys with over one in HOT rows, which are HOT at most."""
    return rows.filter(F.col("n") * HOT > total).select(*keys, F.ceil(F.col("n") * HOT / max(total, 1)).cast("bigint").alias("parts"))


def _salted(rows: DataFrame, side: DataFrame, hot: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows with what `side` has for their keys; keys of many rows are dealt over several tasks."""
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod("spread", parts)).drop("parts")
    copies = side.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1).cast("array<bigint>"))).drop("parts")
    return dealt.join(copies, [*keys, "salt"], how).drop("salt")


def texts(pages: DataFrame) -> DataFrame:
    """(given, text) of (given, _html, drop): the blocks that may be content, without those of the numbers in
    `drop`, in page order."""
    schema = T.StructType([pages.schema["given"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            out = []
            for page, drop in zip(part.column("_html").to_pylist(), part.column("drop").to_pylist(), strict=True):
                tree = dom.parse(page or "")
                said = [t for t, s in zip(tree.text, content(tree), strict=True) if s]
                out.append(" ".join(t for k, t in enumerate(said) if not drop or k not in drop))
            yield pa.RecordBatch.from_arrays([part.column("given"), pa.array(out, pa.string())], ["given", "text"])

    return pages.select("given", "_html", "drop").mapInArrow(run, schema)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages without `html`, with text (the article; empty if there is none) and n_chars (its code points),
    which replace columns of those names.

    The article is what article, main or equally named elements hold, or else all blocks, without
    menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments, and
    without what the host's template repeats, unless that would be half of the text: then the host's
    pages are near copies. Null and empty pages give empty texts; pages without a host are judged
    by themselves; repeated rows are judged alike; an empty table gives an empty result.

    Pages are read and parsed twice, so that neither they nor their texts cross the network, but for
    those pages' whose templates fill more than a broadcast.
    """
    scratch = Scratch(pages.sparkSession, "html")
    rest = [c for c in pages.columns if c != html]
    packed = pages.select(given(pages, rest), host_of(F.col(quoted(url))).alias("host"), F.col(quoted(html)).alias("_html"))
    packed = packed.withColumn("whole", F.xxhash64("_html")).withColumn("spread", F.xxhash64("given", "whole"))
    trees = scratch.save(parsed(packed.filter("host is not null and _html != ''")), "trees")
    total = trees.count()
    hot = scratch.save(_hot(trees.groupBy("host").agg(F.count("*").alias("n")), ["host"], total), "hot")
    ref = scratch.save(references(trees), "references")
    met = scratch.save(aligned(_salted(trees, ref, hot, ["host"], "inner")), "aligned")
    scratch.drop(trees, ref)
    fixed = scratch.save(template_slots(met), "slots")
    some = met.filter(F.exists("slots", lambda s: s["same"])).withColumn("spread", F.col("whole"))
    gone = F.filter("slots", lambda s: s["same"] & F.array_contains("fixed", s["slot"]))
    judged = _salted(some, fixed, hot, ["host"], "inner").withColumn("gone", gone).filter("size(gone) > 0")
    judged = judged.filter(F.aggregate("gone", F.lit(0), lambda a, s: a + s["size"]) * 2 < F.col("size"))
    drop = F.first(F.transform("gone", lambda s: s["block"])).alias("drop")
    drops = scratch.save(judged.groupBy("host", "whole").agg(drop, F.count("*").alias("n")), "drops")
    copied = scratch.save(_hot(drops, ["host", "whole"], total), "copied")
    scratch.drop(met)
    out = texts(_salted(packed, drops.drop("n"), copied, ["host", "whole"], "left"))
    return out.select(*named(rest, "text", "n_chars"), "text").withColumn("n_chars", F.length("text").cast("long"))
