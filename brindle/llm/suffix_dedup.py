"""Removal of byte strings that an earlier document already has.

Winnowing picks anchors: of every run of LENGTH bytes the positions whose SEED-byte hash is the
least, so that equal strings of LENGTH bytes share an anchor wherever they are. Anchors meet by
hash, those of one run of texts only once for each context. Where an earlier document has the
anchor with the same hash of all the bytes around it that a string over it could need, all of those
strings are repeated: runs of such anchors are sent to the earlier document and compared with it
byte by byte, and should one differ, everything is done again with other hashes.

The other anchors of more than one document go on with the bytes around them: their suffixes are
sorted by mergesort, comparisons finding the common extension by binary search over prefix
polynomial hashes, neighbours' extensions are checked byte by byte, and for each distance to the
left the runs of suffixes that agree far enough to the right and to the left give the least document
that has the string. An anchor with very many contexts would make one task's work of that sort:
its strings are spread instead, as they are, and the least document of each is aggregated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import hashing
from brindle.llm.scratch import Scratch

LENGTH = 50
SEED = 24
SIDE = LENGTH - SEED  # bytes to the left of an anchor that a string over it can have
AROUND = SIDE + LENGTH
#: Input bytes for each group of anchors that meet in one task.
GROUP_BYTES = 16_000_000
#: Fewest such groups, so that a document's anchors are spread alike over small inputs and larger ones.
LEAST_GROUPS = 64
#: Anchors with bytes that are sorted at once; an anchor that more documents have is a piece of its own.
SORT_ROWS = 20_000
#: From so many differing contexts on an anchor's strings are spread by themselves.
HOT_ROWS = 120_000
#: Bytes of texts whose anchors meet before they are sent.
RUN_BYTES = 8_000_000
#: Bits of the hash of what is around an anchor.
AROUND_BITS = 48

_MAX = np.uint64((1 << 64) - 1)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i:i + width] for each i; shorter by width - 1."""
    out, size = x, 1
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    extra = width - size
    return pick(out[: len(x) - width + 1], out[extra : extra + len(x) - width + 1]) if extra else out


def _turned(data: np.ndarray, turn: int) -> np.ndarray:
    """data with its bytes renamed, so that other strings collide; as it is for turn 0."""
    return np.random.default_rng(turn).permutation(256).astype(np.uint8)[data] if turn else data


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position in data, text number, hash of the seed, hash of what is around) of all anchors."""
    nothing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    if len(data) < LENGTH:
        return nothing
    h = hashing.prefix_hashes(data)
    p = hashing.powers(AROUND)
    seed = hashing.mix64(h[SEED:] - h[:-SEED] * p[SEED])
    seed = np.minimum(seed, _MAX - np.uint64(1))
    for b in bounds[1:-1]:  # no seed runs from one text into the next
        seed[max(b - SEED + 1, 0) : b] = _MAX
    width = LENGTH - SEED + 1
    least = _sliding(seed, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero((_sliding(padded, width, np.maximum) == seed) & (seed != _MAX))
    text = np.searchsorted(bounds, at, side="right") - 1
    start, stop = np.maximum(at - SIDE, bounds[text]), np.minimum(at + LENGTH, bounds[text + 1])
    long = stop - start >= LENGTH
    at, text, start, stop = at[long], text[long], start[long], stop[long]
    cut = ((at - start) * 128 + (stop - at)).astype(np.uint64)
    around = hashing.mix64((h[stop] - h[start] * p[stop - start]) + cut * np.uint64(0x9E3779B97F4A7C15))
    return at, text, seed[at], around


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each number, byte by byte, which compresses better than in rows."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _numbers(raw: memoryview, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T
    return out.view("<u8").ravel()


def pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    return np.int64(len(columns[0][0])).tobytes() + b"".join(_planes(x, s) for x, s in columns)


def unpack(raw: bytes, sizes: list[int]) -> tuple[list[np.ndarray], bytes]:
    """Columns, and what follows them."""
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for s in sizes:
        out.append(_numbers(memoryview(raw)[at:], n, s))
        at += n * s
    return out, raw[at:]


def _stamp(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """32 bits of a hash of each text, which tell rows apart that share a doc_id."""
    size = np.diff(bounds)
    whole = h[bounds[1:]] - h[bounds[:-1]] * hashing.powers(int(size.max(initial=0)))[size]
    return hashing.mix64(whole + size.astype(np.uint64)) >> np.uint64(32)


def anchor_rows(groups: int, turn: int, bits: int):
    """Of batches of (doc_id, text), one row for each run of texts and group: (grp, blob, known).

    `blob` has the anchors of the run's least document with each context, `known` the others, which
    that document settles, with its id and how far on its anchor is.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, data, bounds in hashing.pieces(batch.column(1)):
                data = _turned(data, turn)
                at, text, seed, around = anchors(data, bounds)
                if len(at):
                    stamp = _stamp(hashing.prefix_hashes(data), bounds)[text]
                    held.append((ids[first + text], stamp, seed, around & np.uint64((1 << bits) - 1), at - bounds[text]))
                size += len(data)
                if size >= RUN_BYTES and held:
                    yield _packed_run(held, groups)
                    held, size = [], 0
        if held:
            yield _packed_run(held, groups)

    return work


def _packed_run(held: list[tuple], groups: int) -> pa.RecordBatch:
    doc, stamp, seed, around, at = (np.concatenate([h[i] for h in held]) for i in range(5))
    group = ((seed >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((doc, around, seed, group))
    doc, stamp, seed, around, at, group = (x[order] for x in (doc, stamp, seed, around, at, group))
    new = np.append(True, (seed[1:] != seed[:-1]) | (around[1:] != around[:-1]) | (group[1:] != group[:-1]))
    least = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    settled = doc > doc[least]
    edges = np.searchsorted(group, np.arange(groups + 1))
    names, blobs, known = [], [], []
    for g in np.flatnonzero(np.diff(edges)):
        own = np.arange(edges[g], edges[g + 1])
        rest, done = own[~settled[own]], own[settled[own]]
        rest, done = rest[np.lexsort((stamp[rest], doc[rest]))], done[np.lexsort((at[done], stamp[done], doc[done]))]
        names.append(int(g))
        blobs.append(_by_texts(doc[rest], stamp[rest], [(seed[rest], 5), (around[rest], 6), (at[rest], 4)]))
        known.append(_by_texts(doc[done], stamp[done], [(at[done], 4), (doc[least[done]].view(np.uint64), 8), ((at[least[done]] - at[done]).view(np.uint64), 4)]))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary()), pa.array(known, pa.binary())], ["grp", "blob", "known"])


def _by_texts(doc: np.ndarray, stamp: np.ndarray, columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Rows in order of doc and stamp, which are kept once a text with the number of its rows."""
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (stamp[1:] != stamp[:-1]))[: len(doc)])
    texts = pack([(doc[first].view(np.uint64), 8), (stamp[first], 4), (np.diff(np.append(first, len(doc))), 4)])
    return np.int64(len(texts)).tobytes() + texts + pack(columns)


def _columns(blobs: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """doc, stamp and the columns of all rows of such blobs."""
    parts = []
    for raw in blobs:
        size = 8 + int(np.frombuffer(raw, np.int64, 1)[0])
        (doc, stamp, count), _ = unpack(raw[8:size], [8, 4, 4])
        count = count.astype(np.int64)
        parts.append([np.repeat(doc, count), np.repeat(stamp, count), *unpack(raw[size:], sizes)[0]])
    return [np.concatenate([p[i] for p in parts]) for i in range(len(sizes) + 2)]


def _by_document(doc: np.ndarray, stamp: np.ndarray, columns: list[tuple[str, np.ndarray, str]]) -> pa.Table:
    """One row for each document, whose columns hold its numbers as packed integers of the kinds given."""
    order = np.lexsort((stamp, doc))
    doc, stamp = doc[order], stamp[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (stamp[1:] != stamp[:-1])
    first = np.flatnonzero(new)
    out = {"doc_id": pa.array(doc[first], pa.int64()), "stamp": pa.array(stamp[first].astype(np.int64))}
    for name, x, kind in columns:
        data = np.ascontiguousarray(x[order].astype(kind))
        ends = (np.append(first, len(doc)) * data.itemsize).astype(np.int32)
        out[name] = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return pa.table(out)


#: What an anchor that more than one document has comes to: bytes decide, an earlier document settles it, or
#: bytes decide with its strings spread.
OPEN, SURE, HOT = 0, 1, 2
MET = "doc_id long, stamp long, at binary, sure binary, src binary, ahead binary"


def meeting(hot_rows: int):
    def meet(rows: pa.Table) -> pa.Table:
        """Anchors that more than one document has: (doc_id, stamp, at, sure, src, ahead), with the earlier
        document that settles a sure one and how far on it has the anchor."""
        doc, stamp, seed, around, at = _columns(rows["blob"].to_pylist(), [5, 6, 4])
        doc, at = doc.view(np.int64), at.astype(np.int64)
        order = np.lexsort((doc, around, seed))
        doc, stamp, seed, around, at = doc[order], stamp[order], seed[order], around[order], at[order]
        new_seed = np.append(True, seed[1:] != seed[:-1])
        new = new_seed | np.append(True, around[1:] != around[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        sure = doc > doc[first]
        part, starts = np.cumsum(new_seed) - 1, np.flatnonzero(new_seed)
        several = (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)) & (np.add.reduceat(new.astype(np.int64), starts) > 1)
        many = np.add.reduceat((~sure).astype(np.int64), starts) >= hot_rows
        kind = np.where(sure, SURE, np.where(many[part], HOT, OPEN))
        take = sure | several[part]
        src, ahead = np.where(sure, doc[first], 0), np.where(sure, at[first] - at, 0)
        k = _columns(rows["known"].to_pylist(), [4, 8, 4])
        more = k[0].view(np.int64), k[1], k[2].astype(np.int64), np.full(len(k[0]), SURE), k[3].view(np.int64), k[4].astype(np.uint32).view(np.int32).astype(np.int64)
        doc, stamp, at, kind, src, ahead = (np.concatenate([x[take], y]) for x, y in zip((doc, stamp, at, kind, src, ahead), more, strict=True))
        return _by_document(doc, stamp, [("at", at, "<u4"), ("sure", kind, "u1"), ("src", src, "<i8"), ("ahead", ahead, "<i4")])

    return meet


def sure_runs(text: np.ndarray, at: np.ndarray, src: np.ndarray, ahead: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, stop, src, ahead) of maximal runs of bytes that sure anchors of one text, source and distance cover."""
    order = np.lexsort((at, ahead, src, text))
    text, at, src, ahead = text[order], at[order], src[order], ahead[order]
    start, stop = np.maximum(at - SIDE, 0), np.minimum(at + LENGTH, size[text])
    same = (text[1:] == text[:-1]) & (src[1:] == src[:-1]) & (ahead[1:] == ahead[:-1])
    first = np.flatnonzero(np.append(True, ~same | (start[1:] > stop[:-1]))[: len(at)])
    last = np.append(first[1:], len(at)) - 1
    return text[first], start[first], stop[last], src[first], ahead[first]


CUT = "grp long, blob binary, src long, runs binary, hot binary, doc_id long, stamp long, start long"


def packed_runs(data: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, src: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(src, blob) for each source of some runs of bytes of data: their places in it, their sizes and the bytes."""
    order = np.argsort(src, kind="stable")
    start, size, place, src = start[order], size[order], place[order], src[order]
    ends = np.cumsum(size)
    flat = data[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
    firsts = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
    for a, b in zip(firsts.tolist(), np.append(firsts[1:], len(src)).tolist(), strict=True):
        yield int(src[a]), pack([(place[a:b], 4), (size[a:b], 4)]) + flat[ends[a] - size[a] : ends[b - 1]].tobytes()


def cut_rows(groups: int, turn: int):
    """Of batches of (doc_id, text, anchors), what of a document's bytes has to be seen elsewhere: contexts of
    open anchors by group, runs of sure ones with the document that is to have them, strings over hot ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CUT.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        context = context_rows(groups)
        for batch in batches:
            ids, found = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_pylist()
            for first, raw, bounds in hashing.pieces(batch.column(1)):
                data = _turned(raw, turn)
                own, rows, size = _stamp(hashing.prefix_hashes(data), bounds), [], np.diff(bounds)
                # The parts of all texts at once: a text has one from each group that its anchors met in.
                parts = [(t, part) for t, stamp in enumerate(own.tolist()) for part in found[first + t] if part["stamp"] == stamp]
                text = np.repeat(np.array([t for t, _ in parts], np.int64), np.array([len(p["sure"]) for _, p in parts], np.int64))
                joined = lambda name, kind: np.frombuffer(b"".join(p[name] for _, p in parts), kind).astype(np.int64)  # noqa: B023, E731
                at, kind, src, ahead = joined("at", "<u4"), joined("sure", "u1"), joined("src", "<i8"), joined("ahead", "<i4")
                if (hot := kind == HOT).any():
                    begin = at[hot][:, None] - np.arange(SIDE + 1)
                    inside = (begin >= 0) & (begin + LENGTH <= size[text[hot]][:, None])
                    places = np.unique((bounds[text[hot]][:, None] + begin)[inside])
                    of = np.searchsorted(bounds, places, side="right") - 1
                    rows += [(*[None] * 4, raw[a : a + LENGTH].tobytes(), int(ids[first + t]), int(own[t]), int(a - bounds[t])) for a, t in zip(places.tolist(), of.tolist(), strict=True)]
                if (sure := kind == SURE).any():
                    t, a, b, src, ahead = sure_runs(text[sure], at[sure], src[sure], ahead[sure], size)
                    rows += [(None, None, k, blob, *[None] * 4) for k, blob in packed_runs(raw, bounds[t] + a, b - a, a + ahead, src)]
                open_ = kind == OPEN
                rows += [(g, blob, *[None] * 6) for g, blob in context(ids[first : first + len(own)], own, data, bounds, text[open_], at[open_])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return work


def context_rows(groups: int):
    """A function of the ids, stamps and bytes of some texts and of their open anchors: (group, blob) of the
    anchors with the bytes around them."""

    def work(ids: np.ndarray, own: np.ndarray, data: np.ndarray, bounds: np.ndarray, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bytes]]:
        if not len(text):
            return
        at = at + bounds[text]
        left = np.minimum(at - bounds[text], SIDE)
        right = np.minimum(bounds[text + 1] - at, LENGTH)
        padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[at].copy()
        place = np.arange(AROUND)
        around[(place < (SIDE - left)[:, None]) | (place >= (SIDE + right)[:, None])] = 0
        h = hashing.prefix_hashes(data)
        seed = hashing.mix64(h[at + SEED] - h[at] * hashing.powers(SEED)[SEED])
        group = (seed >> np.uint64(40)) % np.uint64(groups)
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(groups + 1, dtype=np.uint64))
        for g in np.flatnonzero(np.diff(edges)).tolist():
            o = order[edges[g] : edges[g + 1]]
            head = pack([(seed[o], 8), (ids[text[o]].view(np.uint64), 8), (own[text[o]], 4), (at[o] - bounds[text[o]], 4), (left[o], 1), (right[o], 1)])
            yield g, head + around[o].tobytes()

    return work


def common_extension(h: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that rows i and j have in common from the anchor on, up to `most`, by binary search over prefix hashes."""
    low, high = np.zeros(len(i), np.int64), most.copy()
    while True:
        go = low < high
        if not go.any():
            return low
        mid = (low + high + 1) // 2
        same = h[i, mid] == h[j, mid]
        low = np.where(go & same, mid, low)
        high = np.where(go & ~same, mid - 1, high)


def suffix_order(seed: np.ndarray, around: np.ndarray, right: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Rows in order of seed hash and then of the suffix at their anchor, by a bottom-up mergesort."""
    p = hashing.powers(LENGTH)
    n = len(seed)
    order = np.argsort(seed, kind="stable")
    group = np.zeros(n, np.int64)
    group[1:] = np.cumsum(seed[order][1:] != seed[order][:-1])
    start = np.searchsorted(group, group)  # first place of each row's group
    size = np.bincount(group, minlength=1)[group]
    suffix = np.concatenate([around[:, SIDE:], np.zeros((n, 1), np.uint8)], axis=1)

    def before(i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix i goes before suffix j; an equal one does where `ties`."""
        most = np.minimum(right[i], right[j])
        same = common_extension(h, p, i, j, most)
        ended = same == most
        a, b = suffix[i, same], suffix[j, same]
        return np.where(ended, (right[i] < right[j]) | ((right[i] == right[j]) & ties), a < b)

    width = 1
    while True:
        active = np.flatnonzero(size > width)
        if not len(active):
            return order
        place = active - start[active]
        run = place // width
        is_left = run % 2 == 0
        other = start[active] + np.where(is_left, (run + 1) * width, (run - 1) * width)
        end = np.minimum(other + width, start[active] + size[active])
        low, high = np.minimum(other, end), end.copy()
        me = order[active]
        first = low.copy()
        while True:  # how many of the other run go before me
            go = low < high
            if not go.any():
                break
            mid = np.where(go, (low + high) // 2, 0)
            it = order[mid]
            it_first = before(it[go], me[go], ~is_left[go])
            g = np.flatnonzero(go)
            low[g[it_first]] = mid[g[it_first]] + 1
            high[g[~it_first]] = mid[g[~it_first]]
        base = start[active] + (run - run % 2) * width
        inside = place - run * width
        new = order.copy()
        new[base + inside + (low - first)] = me
        order = new
        width *= 2


def settle(rows: pa.Table) -> pa.Table:
    """(doc_id, stamp, start, stop): for each anchor the bytes under strings that an earlier document has."""
    heads, bodies = [], []
    for raw in rows["blob"].to_pylist():
        columns, rest = unpack(raw, [8, 8, 4, 4, 1, 1])
        heads.append(columns)
        bodies.append(np.frombuffer(rest, np.uint8).reshape(-1, AROUND))
    seed, doc, stamp, at, left, right = (np.concatenate([h[i] for h in heads]) for i in range(6))
    doc, at, left, right = doc.view(np.int64), at.astype(np.int64), left.astype(np.int64), right.astype(np.int64)
    around = np.concatenate(bodies)
    by_seed = np.argsort(seed, kind="stable")
    firsts = np.flatnonzero(np.append(True, seed[by_seed][1:] != seed[by_seed][:-1]))
    found, start = [], 0
    while start < len(by_seed):
        k = np.searchsorted(firsts, start + SORT_ROWS, side="right") - 1
        stop = int(firsts[k]) if firsts[k] > start else int(firsts[k + 1]) if k + 1 < len(firsts) else len(by_seed)
        if start + SORT_ROWS >= len(by_seed):
            stop = len(by_seed)
        some = by_seed[start:stop]
        found.append(_settled(some, *(x[some] for x in (seed, doc, left, right, around))))
        start = stop
    which, low, high = (np.concatenate([f[i] for f in found]) for i in range(3))
    return _by_document(doc[which], stamp[which], [("start", at[which] - high, "<u4"), ("stop", at[which] - low + LENGTH, "<u4")])


def _settled(rows: np.ndarray, seed: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray) -> tuple:
    n = len(seed)
    p = hashing.powers(AROUND)
    h = np.zeros((n, LENGTH + 1), np.uint64)  # prefix hashes of the suffixes at the anchors
    for k in range(LENGTH):
        h[:, k + 1] = h[:, k] * p[1] + around[:, SIDE + k] + np.uint64(1)
    order = suffix_order(seed, around, right, h)
    i, j = order[:-1], order[1:]
    most = np.minimum(right[i], right[j])
    extension = common_extension(h, p, i, j, most)
    # A hash may collide: the bytes have the last word.
    differ = around[i, SIDE:] != around[j, SIDE:]
    real = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH), most)
    extension = np.where(seed[i] == seed[j], np.minimum(extension, real), 0)
    back = np.zeros(n, np.uint64)
    low, high = np.full(n, LENGTH), np.full(n, -1)
    for a in range(SIDE + 1):  # strings that start a bytes before the anchor
        if a:
            back = back * p[1] + around[:, SIDE - a] + np.uint64(1)
        need = LENGTH - a
        run = np.zeros(n, np.int64)
        run[order[1:]] = np.cumsum(extension < need)
        able = np.flatnonzero((left >= a) & (right >= need))
        if not len(able):
            continue
        # Strings agree if their anchors' suffixes do and the bytes before them do.
        key = np.lexsort((doc[able], back[able], run[able]))
        s = able[key]
        new = np.ones(len(s), bool)
        new[1:] = (run[s][1:] != run[s][:-1]) | (back[s][1:] != back[s][:-1])
        if a:
            new[1:] |= (around[s[1:], SIDE - a : SIDE] != around[s[:-1], SIDE - a : SIDE]).any(axis=1)
        least = doc[s][np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
        repeated = s[doc[s] > least]
        low[repeated] = np.minimum(low[repeated], a)
        high[repeated] = np.maximum(high[repeated], a)
    hit = high >= 0
    return rows[hit], low[hit], high[hit]


def spans(n: int, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that intervals within 0..n cover."""
    keep = (starts >= 0) & (stops <= n) & (starts < stops)
    order = np.argsort(starts[keep], kind="stable")
    a, b = starts[keep][order], stops[keep][order]
    if not len(a):
        return a, b
    reach = np.maximum.accumulate(b)
    new = np.append(True, a[1:] > reach[:-1])
    return a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, differ) of rows (uid, runs, text): which of the runs the text doesn't have at their places."""
    for batch in batches:
        out = []
        for raw, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            (place, size), rest = unpack(raw, [4, 4])
            place, size = place.astype(np.int64), size.astype(np.int64)
            there, asked = np.frombuffer(text.encode(), np.uint8), np.frombuffer(rest, np.uint8)
            index = np.repeat(place - (np.cumsum(size) - size), size) + np.arange(len(asked))
            inside = index < len(there)
            bad = ~inside
            bad[inside] = there[index[inside]] != asked[inside]
            out.append(np.unique(np.repeat(np.arange(len(size)), size)[bad]).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["uid", "differ"])


def removable(docs: DataFrame, key: str = "doc_id", text: str = "text", first_bits: int = AROUND_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, stamp, parts): for each document the intervals of bytes to remove, in packed parts.

    first_bits: bits of the contexts' hash in the first try; fewer make collisions that must be found.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(LEAST_GROUPS, -(-total // GROUP_BYTES))
    turn, found = 0, None
    while found is None:
        found = _tried(rows, groups, turn, first_bits if turn == 0 else AROUND_BITS, hot_rows)
        turn += 1
    return found.withColumn("turn", F.lit(turn - 1))


def _tried(rows: DataFrame, groups: int, turn: int, bits: int, hot_rows: int) -> DataFrame | None:
    """The parts by one kind of hashes; None if bytes differ where hashes agree."""
    scratch = Scratch(rows.sparkSession, "suffix")
    sent = rows.mapInArrow(anchor_rows(groups, turn, bits), "grp long, blob binary, known binary")
    shared = scratch.save(sent.groupBy("grp").applyInArrow(meeting(hot_rows), MET), "shared")
    each = shared.groupBy("doc_id").agg(F.collect_list(F.struct("stamp", "at", "sure", "src", "ahead")).alias("anchors"))
    cut = scratch.save(rows.join(each, "doc_id").select("doc_id", "text", "anchors").mapInArrow(cut_rows(groups, turn), CUT), "cut")
    runs = cut.filter("src is not null").select("src", "runs", F.sha2("runs", 256).alias("uid"))
    judged = runs.join(rows.select(F.col("doc_id").alias("src"), "text"), "src").select("uid", "runs", "text").mapInArrow(_differing, "uid string, differ array<long>")
    # Of rows that share the source's id one is enough: a run differs if it does in each of them.
    each = judged.groupBy("uid").agg(F.count("*").alias("n"), F.flatten(F.collect_list("differ")).alias("all")).filter("size(all) > 0")
    wrong = F.exists(F.array_distinct("all"), lambda i: F.size(F.filter("all", lambda x: x == i)) == F.col("n"))
    with scratch.tidied():
        agree = each.filter(wrong).isEmpty()
    if not agree:
        scratch.drop(shared, cut)
        return None
    contexts = cut.filter("grp is not null").select("grp", "blob")
    settled = scratch.save(contexts.groupBy("grp").applyInArrow(settle, "doc_id long, stamp long, start binary, stop binary"), "settled")
    strings = cut.filter("hot is not null").select("hot", "doc_id", "stamp", "start")
    least = strings.groupBy("hot").agg(F.min("doc_id").alias("least"))
    repeated = strings.join(least, "hot").filter("doc_id > least").select("doc_id", "stamp", F.col("start").alias("from"))
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    parts = shared.select("doc_id", "stamp", "at", "sure", *nothing("binary", "start", "stop"), *nothing("long", "from"))
    parts = parts.unionByName(settled.select("doc_id", "stamp", *nothing("binary", "at", "sure"), "start", "stop", *nothing("long", "from")))
    parts = parts.unionByName(repeated.select("doc_id", "stamp", *nothing("binary", "at", "sure", "start", "stop"), "from"))
    parts = scratch.save(parts.groupBy("doc_id").agg(F.collect_list(F.struct("stamp", "at", "sure", "start", "stop", "from")).alias("parts")), "parts")
    scratch.drop(shared, cut, settled)
    return parts


def deduplicate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True, first_bits: int = AROUND_BITS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row of docs.

    Every byte under a LENGTH-byte string that also starts in a document with a smaller doc_id goes.
    Null texts count as empty. Rows without a doc_id neither lose bytes nor make others lose them;
    rows that share one are each held against smaller ids only. `kept` is what remains, as binary. An
    empty table gives an empty result; other columns are not read.
    """
    parts = removable(docs, key, text, first_bits, hot_rows)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(parts, "doc_id", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).to_pylist()
            for first, data, bounds in hashing.pieces(batch.column(1)):
                turns = [t for t in batch.column(3).slice(first, len(bounds) - 1).to_pylist() if t]
                own = _stamp(hashing.prefix_hashes(_turned(data, turns[0] if turns else 0)), bounds)
                out: list[tuple] = []
                for t in range(len(bounds) - 1):
                    raw = data[bounds[t] : bounds[t + 1]]
                    starts, stops = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                    for part in found[first + t] or ():
                        if part["stamp"] != own[t]:
                            continue
                        if part["at"] is not None:
                            at = np.frombuffer(part["at"], "<u4").astype(np.int64)[np.frombuffer(part["sure"], "u1") == SURE]
                            starts.append(np.maximum(at - SIDE, 0))
                            stops.append(np.minimum(at + LENGTH, len(raw)))
                        elif part["from"] is not None:
                            starts.append(np.array([part["from"]], np.int64))
                            stops.append(np.array([part["from"] + LENGTH], np.int64))
                        else:
                            starts.append(np.frombuffer(part["start"], "<u4").astype(np.int64))
                            stops.append(np.frombuffer(part["stop"], "<u4").astype(np.int64))
                    a, b = spans(len(raw), np.concatenate(starts), np.concatenate(stops))
                    edges = np.zeros(len(raw) + 1, np.int8)
                    edges[a], edges[b] = 1, -1
                    left = raw[np.cumsum(edges[:-1], dtype=np.int8) == 0].tobytes() if len(a) else raw.tobytes()
                    out.append((len(raw), int((b - a).sum()), len(a), hashlib.sha256(left).hexdigest(), left))
                columns = list(zip(*out, strict=True))[: 4 + with_text]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(out)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))],
                    [x.split()[0] for x in schema.split(", ")],
                )

    return rows.select("doc_id", "text", "parts", "turn").mapInArrow(work, schema)
