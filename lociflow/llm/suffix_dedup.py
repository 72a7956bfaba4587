"""Removal of byte strings that also start in an earlier document, by sharded suffix arrays.

A repeated string of LENGTH bytes has the same anchor wherever it stands: the leftmost least hash of the SEED
bytes at each of its places. Each document is cut into contexts, the runs of strings with one anchor.

1. Documents are packed into chunks, which are written. A chunk lists the distinct hashes of its anchors; the
   shard of a hash tells whether it stands in two documents, and if it is hot.
2. Of the contexts at such hashes a chunk sends, without their text, each distinct one with its least document.
   Equal contexts meet in one shard: those of later documents go whole, and the first of each is asked for its text.
3. Texts at one hash meet in one shard. Only what has SIDES bytes around its anchor in common with another text
   can share a string with it. That is laid end to end and its suffix array is induced; suffixes whose permuted
   common prefix has LENGTH bytes are equal strings, and each class's least document decides.
4. Texts at a hot hash are told apart string by string instead: a string's key and least document meet in the shard
   of the key. So no shard holds a group that grows with the corpus, but for one row from each chunk.
5. Chunks take back what is covered.

Lists are exchanged packed, one row for each pair of chunk and shard. Both have the size of ``unit_of``, which grows
with the square root of the text, so that a row has about CELL bytes of text however much there is: the rows that are
exchanged are in proportion to the text.
"""

from __future__ import annotations

import hashlib
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.packing import pack, steps, unpack
from lociflow.llm.suffix_array import repeats_before, suffix_array
from lociflow.shared import cut, ensure_importable

LENGTH, SEED = 50, 16
#: Least bytes of a chunk and of a shard, bytes of text for each pair of them at least, and of the parts of a chunk.
UNIT, CELL, PART = 4 << 20, 1100, 1 << 19
#: How far a string may reach to the left of its anchor, in ranges: all strings of a range have in common the bytes
#: from the range's start to LENGTH after its end, so texts without any of these in common share no string.
SIDES = [(a, min(a + 7, LENGTH - SEED + 1)) for a in range(0, LENGTH - SEED + 1, 7)]
#: Starts of strings that are worked on at a time; bounds the memory that long documents need.
SLICE = 1 << 20
#: Contexts at one hash beyond which it is hot.
HOT = 1 << 17
#: Between contexts; no byte of UTF-8.
GAP = 255
#: A null id is later than any other.
LATEST = np.iinfo(np.int64).max
#: What a row between chunks and shards holds: bytes that are covered, equal things that meet, texts.
COVERED, MEET, TEXTS = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def unit_of(held: int) -> int:
    return max(UNIT, isqrt(CELL * held))


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in ((32, 0x94D049BB133111EB), (29, 0xBF58476D1CE4E5B9)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(16)


def anchors(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(hash, place, first, last)``: the anchor's hash (48 bits) and place and the first and last start of the strings of
    each context, in order.

    ``owner`` numbers the document of each byte, rising; strings that span two are in no context. A run is also
    cut after each SLICE starts.
    """
    n, found = len(data) - LENGTH + 1, []
    for b in range(0, max(n, 0), SLICE):
        h, *at = _anchors(np.ascontiguousarray(data[b : b + SLICE + LENGTH - 1]), owner[b : b + SLICE + LENGTH - 1])
        found.append((h, *(x + b for x in at)))
    if not found:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(data) - LENGTH + 1
    words = np.array(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)))
    words *= np.uint64(_BASE)
    seeds = words[8:] ^ (words[8:] >> np.uint64(31))
    seeds *= np.uint64(0xBF58476D1CE4E5B9)
    seeds += words[:-8]
    seeds ^= seeds >> np.uint64(32)
    seeds *= np.uint64(0x94D049BB133111EB)
    # The upper half is the hash that is least, the lower the place: of equal hashes the leftmost.
    low = (seeds & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)
    m, places = 1, LENGTH - SEED + 1
    while m < places:
        step = min(m, places - m)
        low = np.minimum(low[:-step], low[step:])
        m += step
    place = low.astype(np.uint32).astype(np.int64)
    place[owner[:n] != owner[LENGTH - 1 :]] = -1
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], n) - 1
    keep = place[first] >= 0
    first, last = first[keep], last[keep]
    return _mixed(seeds[place[first]]), place[first], first, last


def _sums(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sums, inverse``: the hash of ``part[a:b]`` is ``(sums[b] - sums[a]) * inverse[a]``."""
    if not _POWERS:
        of = lambda x: np.cumprod(np.where(np.arange(SLICE + 2 * LENGTH + 1) == 0, np.uint64(1), np.uint64(x)), dtype=np.uint64)
        _POWERS.extend((of(_BASE), of(pow(_BASE, -1, 1 << 64))))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_TABLE[part] * _POWERS[0][: len(part)], out=sums[1:])
    return sums, _POWERS[1]


def keys_of(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """48-bit hashes of ``data[first:end]`` for ranges of at most twice LENGTH bytes, ``first`` ascending."""
    out = np.empty(len(first), np.uint64)
    for b in range(0, len(data), SLICE):
        i, j = np.searchsorted(first, [b, b + SLICE])
        if i < j:
            sums, inverse = _sums(data[b : b + SLICE + 2 * LENGTH])
            out[i:j] = (sums[end[i:j] - b] - sums[first[i:j] - b]) * inverse[first[i:j] - b]
    return _mixed(out + (end - first).astype(np.uint64))


def shared_strings(h: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(low, high)``: the first and last start, in their texts, of the strings that a context may share with another at its
    hash; ``high`` is below ``low`` where there are none. ``place`` is the anchor's in the context's text."""
    low, high = np.full(len(h), LENGTH), np.full(len(h), -1)
    for a, upto in SIDES:
        # Strings that reach from a to below upto start between these.
        left, right = np.maximum(place - upto + 1, 0), np.minimum(place - a, size - LENGTH)
        some = np.flatnonzero((place >= a) & (place - upto + 1 + LENGTH <= size) & (left <= right))
        key = keys_of(data, (begin + place)[some] - a, (begin + place)[some] - upto + 1 + LENGTH) if len(some) else np.empty(0, np.uint64)
        order = np.lexsort((key, h[some]))
        at = _starts(h[some][order], key[order])
        count = np.diff(np.append(at, len(order)))
        several = some[order[np.repeat(count > 1, count)]]
        low[several] = np.minimum(low, left)[several]
        high[several] = np.maximum(high, right)[several]
    return low, high


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new value, or a new combination of values, begins."""
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = False
    for a in sorted_:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def _cells(of: np.ndarray):
    """``(shard, range)`` for the values of ascending ``of``."""
    first = _starts(of)
    for a, b in zip(first.tolist(), np.append(first[1:], len(of)).tolist()):
        yield int(of[a]), slice(a, b)


class Part:
    """Documents of a chunk end to end."""

    def __init__(self, ids: list[int | None], texts: list[bytes]):
        self.ids = np.array([LATEST if i is None else i for i in ids], "<i8")
        self.null = np.array([i is None for i in ids], bool)
        self.size = np.array([len(t) for t in texts], "<i8")
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def packed(self) -> bytes:
        return pack(self.ids, self.null, self.size, self.data)

    @classmethod
    def unpacked(cls, data: bytes) -> Part:
        part = cls.__new__(cls)
        part.ids, part.null, part.size, part.data = unpack(data, "<i8", "?", "<i8", "u1")
        return part

    def contexts(self):
        """``(hash, document's id, place, first, last)``."""
        owner = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        h, place, first, last = anchors(self.data, owner)
        return h, self.ids[owner[first]], place, first, last


def _chunks(rows: DataFrame, unit: int) -> DataFrame:
    """``(chunk, part, data)``: packed documents."""

    def run(batches):
        task, number, part, whole, ids, texts, held = TaskContext.get().partitionId(), 0, 0, 0, [], [], 0

        def told():
            return pa.record_batch([pa.array([f"{task}-{number}"]), pa.array([part], pa.int32()), pa.array([Part(ids, texts).packed()], pa.binary())], ["chunk", "part", "data"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append((t or "").encode("utf-8", "replace"))
                held += len(texts[-1])
                if held >= PART:
                    yield told()
                    part, whole, ids, texts, held = part + 1, whole + held, [], [], 0
                    if whole >= unit:
                        number, part, whole = number + 1, 0, 0
        if ids:
            yield told()

    return rows.mapInArrow(run, "chunk string, part int, data binary")


def _parts(table: pa.Table):
    """``(number, part)`` of a chunk, in order."""
    for k in np.argsort(table.column("part").to_numpy()).tolist():
        yield k, Part.unpacked(table.column("data")[k].as_py())


class Found:
    """Contexts of a chunk, in the order of their hashes. Parts are told apart by their rows in the chunk's order."""

    def __init__(self, table: pa.Table):
        cols = []
        for number, (_, part) in enumerate(_parts(table)):
            h, *own = part.contexts()
            cols.append((h, *own, np.full(len(h), number, np.uint32)))
        h, self.doc, self.place, self.first, self.last, self.part = (np.concatenate(x) for x in zip(*cols))
        self.order = np.argsort(h, kind="stable")
        self.h = h[self.order]
        self.at = _starts(self.h) if len(h) else np.empty(0, np.int64)
        self.names = self.h[self.at]
        self.count = np.diff(np.append(self.at, len(h)))


_ROW = ["shard", "chunk", "kind", "data"]
_SCHEMA = "shard long, chunk string, kind int, data binary"


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.binary()))], _ROW)


def _lists(shards: int):
    """A chunk's hashes, with how many contexts have each, and whether two documents have it."""

    def run(docs: pa.Table) -> pa.Table:
        found, chunk = Found(docs), docs.column("chunk")[0].as_py()
        if not len(found.h):
            return _rows([])
        doc = found.doc[found.order]
        several = np.minimum.reduceat(doc, found.at) < np.maximum.reduceat(doc, found.at)
        count = np.minimum(found.count, 255).astype(np.uint8)
        return _rows([(s, chunk, MEET, pack(steps(found.names[k]), count[k], several[k])) for s, k in _cells(_shard(found.names, shards))])

    return run


def _shared(hot: int):
    """Of one shard: for each chunk and each of its hashes 0 if no two documents have it, 2 if over ``hot`` contexts do, else 1."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), "<u8", "u1", "?") for x in rows.column("data")]
        h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        order = np.argsort(h, kind="stable")
        first = _starts(h[order])
        size = np.diff(np.append(first, len(h)))
        several = np.logical_or.reduceat(np.concatenate([p[2] for p in parts])[order], first) | (size > 1)
        count = np.add.reduceat(np.concatenate([p[1] for p in parts]).astype(np.int64)[order], first)
        flag = np.empty(len(h), np.uint8)
        flag[order] = np.repeat(np.where(several, np.where(count > hot, 2, 1), 0), size)
        ends = np.cumsum([len(p[0]) for p in parts])
        shard = rows.column("shard")[0].as_py()
        return _rows([(shard, c, MEET, pack(f)) for c, f in zip(rows.column("chunk").to_pylist(), np.split(flag, ends[:-1])) if f.any()])

    return run


_MEET = ("<u8", "<u8", "<i8", "<u4", "<u4", "u1", "u1", "?")


def _meeting(h, key, doc, part, first, n, at, hot, shards: int) -> tuple[tuple, list]:
    """Of things told apart by ``(h, key)``, which cover ``n`` starts from ``first``: the places of those that aren't their
    kind's least document's in this chunk, which are covered, and the rest packed for each shard."""
    order = np.lexsort((key, h))
    own = [x[order] for x in (h, key, doc, part.astype("<u4"), first.astype("<u4"), n.astype(np.uint8), at.astype(np.uint8), hot)]
    if not len(h):
        return tuple(own[3:6]), []
    of = _starts(own[0], own[1])
    gone = own[2] > np.repeat(np.minimum.reduceat(own[2], of), np.diff(np.append(of, len(h))))
    covered = tuple(x[gone] for x in own[3:6])
    own = [x[~gone] for x in own]
    shard = _shard(_mixed(own[0] ^ own[1] * np.uint64(_BASE)), shards)
    order = np.argsort(shard, kind="stable")  # within a shard by hash, as they were
    packed = []
    for s, k in _cells(shard[order]):
        cell = [x[order[k]] for x in own]
        packed.append((s, pack(steps(cell[0]), *cell[1:])))
    return covered, packed


def _contexts(shards: int):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        if not len(flags):
            return _rows([])
        found, chunk = Found(docs), docs.column("chunk")[0].as_py()
        flag = np.zeros(len(found.names), np.uint8)
        told = dict(zip(flags.column("shard").to_pylist(), flags.column("data")))
        for s, k in _cells(_shard(found.names, shards)):
            if s in told:
                flag[k] = unpack(told[s].as_py(), "u1")[0]
        flag = np.repeat(flag, found.count)
        kept = found.order[flag > 0]
        h, hot = found.h[flag > 0], flag[flag > 0] == 2
        by_place = np.lexsort((found.first[kept], found.part[kept]))
        kept, h, hot = kept[by_place], h[by_place], hot[by_place]
        part, first, last = found.part[kept], found.first[kept], found.last[kept]
        key = np.empty(len(h), np.uint64)
        for number, (_, p) in enumerate(_parts(docs)):
            i, j = np.searchsorted(part, [number, number + 1])
            key[i:j] = keys_of(p.data, first[i:j], last[i:j] + LENGTH)
        covered, packed = _meeting(h, key, found.doc[kept], part, first, last - first + 1, found.place[kept] - first, hot, shards)
        return _rows([(crc32(chunk.encode()) % shards, chunk, COVERED, _places(*covered)), *((s, chunk, MEET, x) for s, x in packed)])

    return run


def _places(part, first, n) -> bytes:
    order = np.lexsort((first, part))
    return pack(part[order].astype("<u4"), first[order].astype("<u4"), n[order].astype("<u4"))


def _met(rows: list[tuple]) -> list[tuple]:
    """Of ``(chunk, data)`` in one shard: for each chunk which of its things come later than their kind's first."""
    parts = [unpack(x, *_MEET) for _, x in rows]
    hashes = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    h, key, doc = np.concatenate(hashes), *(np.concatenate([p[k] for p in parts]) for k in (1, 2))
    order = np.lexsort((key, h))
    at = _starts(h[order], key[order])
    gone = np.empty(len(h), bool)
    gone[order] = doc[order] > np.repeat(np.minimum.reduceat(doc[order], at), np.diff(np.append(at, len(h))))
    ends = np.cumsum([len(x) for x in hashes])
    return [(chunk, own, p, x) for (chunk, _), own, p, x in zip(rows, np.split(gone, ends[:-1]), parts, hashes)]


def _by_kind(rows: pa.Table) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {COVERED: [], MEET: [], TEXTS: []}
    for chunk, kind, data in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(3)):
        out[kind].append((chunk, data.as_py()))
    return out


def _firsts(rows: pa.Table) -> pa.Table:
    """Of one shard: what is covered, and the contexts whose texts are asked for (kind TEXTS)."""
    kinds, out, shard = _by_kind(rows), [], rows.column("shard")[0].as_py()
    out += [(shard, chunk, COVERED, data) for chunk, data in kinds[COVERED]]
    if kinds[MEET]:
        for chunk, gone, (_, *own), h in _met(kinds[MEET]):
            if gone.any():
                out.append((shard, chunk, COVERED, _places(*(x[gone] for x in own[2:5]))))
            if not gone.all():
                out.append((shard, chunk, TEXTS, pack(steps(h[~gone]), *(x[~gone] for x in own))))
    return _rows(out)


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``data[first : first + size]`` of each range, end to end."""
    ends = np.cumsum(size)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)]


_TEXTS = ("<u8", "<i8", "u1", "u1", "u1", "<u4", "<u4", "<u4")


def _texts(shards: int):
    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asked):
            return _rows([])
        chunk, kinds = docs.column("chunk")[0].as_py(), _by_kind(asked)
        covered = [unpack(x, "<u4", "<u4", "<u4") for _, x in kinds[COVERED]]
        reps = [unpack(x, *_MEET) for _, x in kinds[TEXTS]]
        out = []
        if reps:
            h = np.concatenate([np.cumsum(r[0], dtype=np.uint64) for r in reps])
            key, doc, part, first, n, at, hot = (np.concatenate([r[k] for r in reps]) for k in range(1, 8))
            order = np.lexsort((first, part))
            h, key, doc, part, first, n, at, hot = (x[order] for x in (h, key, doc, part, first.astype(np.int64), n.astype(np.int64), at, hot))
            size, text, strings = n + LENGTH - 1, [], []
            for number, (_, p) in enumerate(_parts(docs)):
                i, j = np.searchsorted(part, [number, number + 1])
                text.append(_gather(p.data, first[i:j], size[i:j]))
                some = i + np.flatnonzero(hot[i:j])
                if len(some):  # each string of a context at a hot hash by itself
                    own = np.repeat(some, n[some])
                    start = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                    by = np.argsort(start, kind="stable")
                    own, start = own[by], start[by]
                    strings.append((h[own], keys_of(p.data, start, start + LENGTH), doc[own], part[own], start, np.ones(len(own), np.int64), at[own], hot[own]))
            if strings:
                gone, packed = _meeting(*(np.concatenate(x) for x in zip(*strings)), shards)
                covered.append(gone)
                out += [(s, chunk, MEET, x) for s, x in packed]
            text, begin = np.concatenate(text), np.cumsum(size) - size
            shard = _shard(h, shards)
            order = np.lexsort((key, h, shard, hot))
            order = order[: int((~hot).sum())]
            for s, k in _cells(shard[order]):
                cell = order[k]
                new = _starts(h[cell], key[cell])  # each text once, with all its places
                one = cell[new]
                times = np.diff(np.append(new, len(cell)))
                out.append((s, chunk, TEXTS, pack(steps(h[one]), doc[one], n[one].astype(np.uint8), at[one], _gather(text, begin[one], size[one]), times.astype("<u4"), part[cell].astype("<u4"), first[cell].astype("<u4"))))
        out.append((crc32(chunk.encode()) % shards, chunk, COVERED, _joined(covered)))
        return _rows(out)

    return run


def _joined(covered: list[tuple]) -> bytes:
    """Places as few as may be: those whose starts touch are one."""
    if not covered:
        return _places(*(np.empty(0, np.int64),) * 3)
    part, first, n = (np.concatenate([c[k] for c in covered]).astype(np.int64) for k in range(3))
    order = np.lexsort((first, part))
    part, first, end = part[order], first[order], (first + n)[order]
    # Starts of a part lie below this.
    far = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(part * far + end)
    new = np.flatnonzero(np.append(True, (part * far + first)[1:] > reach[:-1])[: len(part)])
    if not len(new):
        return _places(part, first, end)
    return _places(part[new], first[new], reach[np.append(new[1:], len(part)) - 1] - part[new] * far - first[new])


def least_documents(h: np.ndarray, low: np.ndarray, size: np.ndarray, data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts (hash, document, bytes, place of the anchor, sorted by hash) the least document of each of their strings,
    context after context, and how many strings each has."""
    starts, begin = size - LENGTH + 1, np.cumsum(size) - size
    out = np.repeat(low, starts)
    first, last = shared_strings(h, data, begin, size, place)
    some = np.flatnonzero(first <= last)
    if not len(some):
        return out, starts
    n = (last - first + 1)[some]
    own = n + LENGTH - 1
    at = np.cumsum(own + 1) - (own + 1)
    within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    text = np.full(int((own + 1).sum()), GAP, np.uint8)
    text[np.repeat(at, own) + within] = data[np.repeat((begin + first)[some], own) + within]
    sa = suffix_array(text)
    same = repeats_before(text, sa, LENGTH)[sa]
    row = np.repeat(np.arange(len(some)), own + 1)
    valid = (np.arange(len(text)) - at[row] < n[row])[sa]  # strings that end within their context
    classes = np.cumsum(~same) - 1
    least = np.full(int(classes[-1]) + 1, LATEST, np.int64)
    np.minimum.at(least, classes[valid], low[some][row][sa][valid])
    by_place = np.empty(len(text), np.int64)
    by_place[sa] = least[classes]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat((np.cumsum(starts) - starts + first)[some], n) + step] = by_place[np.repeat(at, n) + step]
    return out, starts


def _arrays(rows: list[tuple]) -> list[tuple]:
    """Of ``(chunk, data)`` in one shard: for each chunk the places of strings that start in an earlier document."""
    parts = [unpack(x, *_TEXTS) for _, x in rows]
    h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    doc, n = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64)
    size = n + LENGTH - 1
    order = np.argsort(h, kind="stable")
    data = _gather(np.concatenate([p[4] for p in parts]), (np.cumsum(size) - size)[order], size[order])
    place = np.concatenate([p[3] for p in parts]).astype(np.int64)
    least, starts = least_documents(h[order], doc[order], size[order], data, place[order])
    gone = np.repeat(doc[order], starts) > least
    context = np.repeat(order, starts)
    # Runs of strings that go, as places within their contexts.
    within = np.arange(len(gone)) - np.repeat(np.cumsum(starts) - starts, starts)
    first = np.flatnonzero(gone & ((within == 0) | ~np.append(False, gone[:-1])))
    last = np.flatnonzero(gone & ((within + 1 == starts.repeat(starts)) | ~np.append(gone[1:], False)))
    of, low, length = context[first], within[first], last - first + 1
    by = np.argsort(of, kind="stable")
    of, low, length = of[by], low[by], length[by]
    out, base = [], 0
    for (chunk, _), (_, _, own, _, _, times, part, start) in zip(rows, parts):
        i, j = np.searchsorted(of, [base, base + len(own)])
        which = of[i:j] - base
        again = times[which].astype(np.int64)
        at = np.repeat((np.cumsum(times, dtype=np.int64) - times)[which], again) + np.arange(int(again.sum())) - np.repeat(np.cumsum(again) - again, again)
        out.append((chunk, _places(part[at], start[at] + np.repeat(low[i:j], again), np.repeat(length[i:j], again))))
        base += len(own)
    return out


def _decided(rows: pa.Table) -> pa.Table:
    kinds, shard = _by_kind(rows), rows.column("shard")[0].as_py()
    out = [(chunk, data) for chunk, data in kinds[COVERED]]
    if kinds[MEET]:
        out += [(chunk, _places(p[3][gone], p[4][gone], p[5][gone])) for chunk, gone, p, _ in _met(kinds[MEET])]
    if kinds[TEXTS]:
        out += _arrays(kinds[TEXTS])
    return _rows([(shard, chunk, COVERED, data) for chunk, data in out])


def _results(digest: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"]

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        covered = [unpack(x.as_py(), "<u4", "<u4", "<u4") for x in found.column("data")]
        part, first, n = (np.concatenate([c[k] for c in covered]).astype(np.int64) if covered else np.empty(0, np.int64) for k in range(3))
        rows = []
        for number, (_, p) in enumerate(_parts(docs)):
            own = part == number
            marks = np.zeros(len(p.data) + 1, np.int32)
            np.add.at(marks, first[own], 1)
            np.add.at(marks, (first + n)[own] + LENGTH - 1, -1)
            gone = np.cumsum(marks, dtype=np.int32)[:-1] > 0
            end = np.cumsum(p.size)
            for i, null, b, e in zip(p.ids.tolist(), p.null.tolist(), (end - p.size).tolist(), end.tolist()):
                g = gone[b:e]
                left = p.data[b:e][~g].tobytes()
                spans = int((g[1:] & ~g[:-1]).sum()) + int(g[:1].sum())
                rows.append((None if null else i, e - b, e - b - len(left), spans, hashlib.sha256(left).hexdigest() if digest else left))
        cols = list(zip(*rows)) if rows else [()] * 5
        types = [pa.int64()] * 4 + [pa.string() if digest else pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digest else 'kept binary'}"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` for each row: what is left of the text's UTF-8 bytes when each byte is
    removed that lies in a string of LENGTH bytes that also starts in a row with a smaller id.

    With ``digest``, ``kept_sha256`` in place of the bytes, which need not be valid UTF-8. Matches lie within
    a row; overlaps count; strings are judged on the input. Null texts are empty. A null id is larger than any
    other, and rows of equal ids don't take from each other. An empty table gives an empty one, and further
    columns play no part. ``hot`` changes how strings are told apart, not which.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    unit = unit_of(held)
    shards = max(8, held // unit)
    # Written, so that a chunk holds the same documents whenever it is read again.
    parts = cut(_chunks(rows, unit), "suffix-chunks")
    there = lambda df: df.withColumnRenamed("chunk", "of_chunk").groupBy("of_chunk")
    back = lambda df: df.select("shard", F.col("chunk"), "kind", "data")
    lists = parts.groupBy("chunk").applyInArrow(_lists(shards), _SCHEMA)
    flags = back(lists.groupBy("shard").applyInArrow(_shared(hot), _SCHEMA))
    met = parts.groupBy("chunk").cogroup(there(flags)).applyInArrow(_contexts(shards), _SCHEMA)
    asked = back(met.groupBy("shard").applyInArrow(_firsts, _SCHEMA))
    texts = parts.groupBy("chunk").cogroup(there(asked)).applyInArrow(_texts(shards), _SCHEMA)
    decided = back(texts.groupBy("shard").applyInArrow(_decided, _SCHEMA))
    run, schema = _results(digest)
    return parts.groupBy("chunk").cogroup(there(decided)).applyInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, digest=True)
