"""Benchmark decontamination by spaced seeds.

A mask looks at some word positions of a window and ignores the others, so a window is hit also where the
ignored words were replaced. Hashes of test and training windows are joined; around each hit, test item and
document are laid side by side and the longest stretch with enough equal words is taken.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.encoding import portions
from lociflow.shared import cut, ensure_importable

#: 1 is looked at, 0 ignored. Any 13 words with at most two of them replaced keep a hit.
MASKS = ("11111", "1101101", "110100101", "1010010011", "1100010000111")
#: Words that a stretch has at least (an item of fewer: all of its words), and the share that is equal.
STRETCH, SIMILARITY = 13, 0.8
#: Bytes of the test items up to which their hashes are sent to every executor; more are joined by a shuffle.
BROADCAST_BYTES = 8_000_000
WORD = re.compile(r"\w+")
_FILTER_BITS = 22


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


class Hasher:
    """64-bit numbers of words, remembered up to a bound."""

    def __init__(self, keep: int = 400_000):
        self.keep, self.known = keep, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known = {}
        known, digest = self.known, xxhash.xxh64_intdigest
        for w in set(words) - known.keys():
            known[w] = digest(w.encode("utf-8", "replace"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mask_offsets(mask: str) -> list[int]:
    return [i for i, x in enumerate(mask) if x == "1"]


def masks_for(length: int) -> list[str]:
    """The masks for an item of that many words.

    A stretch begins and ends with equal words, so of an item of fewer than STRETCH words, which must be found
    whole, a fifth of the inner words may differ. These are parted into blocks, two more than may differ, and
    each mask ignores as many blocks as words may differ: some mask ignores all that do.
    """
    if length >= STRETCH:
        return list(MASKS)
    wrong = length - int(np.ceil(SIMILARITY * length - 1e-9))
    if not wrong:
        return ["1" * length] if length else []
    edges = [1 + (length - 2) * k // (wrong + 2) for k in range(wrong + 3)]
    out = []
    for blocks in combinations(range(wrong + 2), wrong):
        gone = {i for b in blocks for i in range(edges[b], edges[b + 1])}
        out.append("".join("0" if i in gone else "1" for i in range(length)))
    return out


def window_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """One for each place where the mask fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, xxhash.xxh64_intdigest(mask.encode()), np.uint64)
    for k, at in enumerate(mask_offsets(mask)):
        out = (out ^ hashes[at : at + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        out ^= out >> np.uint64(29)
    return out


def longest_stretch(equal: np.ndarray, share: float) -> tuple[int, int]:
    """Begin and end of the longest stretch of which at least ``share`` is True; the first of equals. It begins and ends with True."""
    n = len(equal)
    gain = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - share, -share))])
    low = np.minimum.accumulate(gain)  # falls from left to right
    # For each end the first begin whose gain isn't higher (a little slack for rounding).
    first = np.searchsorted(-low, -(gain + 1e-9), "left")
    size = np.arange(n + 1) - first
    end = int(size.argmax())
    begin = int(first[end])
    inside = np.flatnonzero(equal[begin:end])
    return (begin + int(inside[0]), begin + int(inside[-1]) + 1) if len(inside) else (0, 0)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int] | None:
    """The verified stretch, in the document's words, with word 0 of the item at ``shift`` of the document."""
    lo, hi = max(0, shift), min(len(doc), shift + len(item))
    if hi <= lo:
        return None
    b, e = longest_stretch(doc[lo:hi] == item[lo - shift : hi - shift], SIMILARITY)
    return (lo + b, lo + e) if e - b >= min(STRETCH, len(item)) else None


class Index:
    """Hashed windows of the items, by mask."""

    def __init__(self, items: dict[int, np.ndarray]):
        self.items = items
        found: dict[str, list] = {}
        for k, h in items.items():
            for mask in masks_for(len(h)):
                w = window_hashes(h, mask)
                found.setdefault(mask, []).append((w, np.full(len(w), k), np.arange(len(w))))
        self.tables = {}
        for mask, rows in found.items():
            hashes, item, at = (np.concatenate(x) for x in zip(*rows))
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables[mask] = hashes[order], item[order], at[order], seen

    def candidates(self, hashes: np.ndarray):
        """``(item, place in the text less place in the item)`` of each hit, repeats left out."""
        out = set()
        for mask, (keys, item, at, seen) in self.tables.items():
            own = window_hashes(hashes, mask)
            near = np.flatnonzero(seen[own >> np.uint64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(keys, own[near]), np.searchsorted(keys, own[near], "right")
            for p, a, b in zip(near[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                out.update(zip(item[a:b].tolist(), (p - at[a:b]).tolist()))
        return out


def report(found: dict[int, list[tuple[int, int]]], n: int) -> tuple[list[int], int]:
    """Items, and how many of the document's words lie in a verified stretch."""
    covered = np.zeros(n, bool)
    for spans in found.values():
        for b, e in spans:
            covered[b:e] = True
    return sorted(found), int(covered.sum())


_ADDED = "item_ids array<long>, n_words long, covered_words long"


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``item_ids`` (sorted ids of the items that they hold, empty for clean rows), ``n_words``
    and ``covered_words`` (words in a verified stretch).

    An item is held if a stretch of at least STRETCH words, or of all the item's words if it has fewer, has
    at least SIMILARITY of its words, the first and the last among them, equal at equal places. Null or empty texts hold nothing and are held by
    nothing; an item with a null id is left out; items that repeat an id are each searched for. Columns of
    ``docs`` by the added names, in any case, are replaced.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("item_ids", "n_words", "covered_words")])
    items = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item_text")).where("item_id is not null and item_text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return _by_broadcast(docs, items.collect(), text_col)
    return _by_shuffle(docs, items, text_col)


def _schema(docs: DataFrame):
    added = [F.lit(None).cast(t).alias(n) for n, t in (x.split(" ") for x in _ADDED.split(", "))]
    return docs.select(*docs.columns, *added).schema


def _with(batch: pa.RecordBatch, rows: list[tuple[list[int], int, int]]) -> pa.RecordBatch:
    ids, n, covered = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(ids, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(covered, pa.int64())],
        names=[*batch.schema.names, "item_ids", "n_words", "covered_words"],
    )


def _by_broadcast(docs: DataFrame, items: list, text_col: str) -> DataFrame:
    hasher = Hasher()
    listed = sorted((r["item_id"], r["item_text"]) for r in items)
    ids = [i for i, _ in listed]
    sent = docs.sparkSession.sparkContext.broadcast(Index({k: hasher(words_of(t)) for k, (_, t) in enumerate(listed)}))
    at = docs.columns.index(text_col)

    def run(batches):
        index, hasher = sent.value, Hasher()
        for batch in batches:
            texts, rows = batch.column(at).to_pylist(), []
            for b, e in portions(texts):
                split = [words_of(t) for t in texts[b:e]]
                hashes = hasher([w for words in split for w in words])
                ends = np.cumsum([len(w) for w in split])
                found: list[dict[int, list]] = [{} for _ in split]
                # Texts are searched as one; a hit that spans two finds too little in either to be kept.
                for item, shift in index.candidates(hashes):
                    size = len(index.items[item])
                    first = int(np.searchsorted(ends, max(shift, 0), "right"))
                    last = int(np.searchsorted(ends, min(shift + size, int(ends[-1])) - 1, "right"))
                    for d in range(first, last + 1):
                        begin = int(ends[d - 1]) if d else 0
                        if span := overlap(hashes[begin : int(ends[d])], index.items[item], shift - begin):
                            found[d].setdefault(ids[item], []).append(span)
                for words, own in zip(split, found):
                    held, covered = report(own, len(words))
                    rows.append((held, len(words), covered))
            yield _with(batch, rows)

    return docs.mapInArrow(run, _schema(docs))


def _hashed(df: DataFrame, key: str, text: str, masks_of) -> DataFrame:
    """``(key, mask window hash, place)`` for each window of each row, for the masks that ``masks_of`` gives for its length."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = hasher(words_of(t))
                own = [window_hashes(h, m).view(np.int64) for m in masks_of(len(h))]
                if n := sum(map(len, own)):
                    yield pa.record_batch([pa.array([k] * n, pa.int64()), pa.array(np.concatenate(own)), pa.array(np.concatenate([np.arange(len(w)) for w in own]))], ["key", "hash", "place"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, "key long, hash long, place long")


def _lengths(items: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([min(STRETCH, len(words_of(t))) for t in batch.column(0).to_pylist()], pa.int32())], ["n"])

    return items.select("item_text").mapInArrow(run, "n int")


def _by_shuffle(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    """For test sets without a bound: windows are joined on their hash, then texts meet the items they hit."""
    at = docs.columns.index(text_col)
    # The user's columns go as one struct, so that no name of theirs meets one of these tables.
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    numbered = cut(docs.select(own, F.col(f"`{text_col}`").cast("string").alias("doc_text"), F.monotonically_increasing_id().alias("row")), "decontam-docs")
    listed = cut(items.withColumn("item", F.monotonically_increasing_id()), "decontam-items")
    texts = numbered.where("doc_text is not null")
    # Lengths of items under STRETCH words, of which there are few, and their masks; longer items share theirs.
    lengths = sorted({r[0] for r in _lengths(listed).distinct().collect()})
    every = sorted({m for n in lengths for m in masks_for(n)})
    here = _hashed(texts, "row", "doc_text", lambda n: every).select(F.col("key").alias("row"), "hash", F.col("place").alias("p"))
    there = _hashed(listed, "item", "item_text", masks_for).select(F.col("key").alias("item"), "hash", F.col("place").alias("q"))
    hits = here.join(there, "hash").select("row", "item", (F.col("p") - F.col("q")).alias("shift")).distinct()
    pairs = hits.groupBy("row", "item").agg(F.collect_list("shift").alias("shifts"))
    pairs = pairs.join(listed, "item").join(texts.select("row", "doc_text"), "row")

    def verify(batches):
        hasher = Hasher()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                doc, item = hasher(words_of(r["doc_text"])), hasher(words_of(r["item_text"]))
                spans = [s for x in r["shifts"] if (s := overlap(doc, item, x))]
                if spans:
                    rows.append((r["row"], r["item_id"], [x for s in sorted(spans) for x in s]))
            if rows:
                a, b, c = zip(*rows)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.int64()))], ["row", "item_id", "spans"])

    found = pairs.select("row", "item_id", "item_text", "doc_text", "shifts").mapInArrow(verify, "row long, item_id long, spans array<long>")
    per_row = found.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("held"), F.flatten(F.collect_list("spans")).alias("spans"))
    joined = numbered.join(per_row, "row", "left")

    def count(batches):
        for batch in batches:
            doc, rows = batch.column(0), []
            for text, held, spans in zip(doc.field(at).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = len(words_of(text))
                spans = spans or []
                rows.append((held or [], n, report({0: list(zip(spans[::2], spans[1::2]))}, n)[1]))
            yield _with(pa.RecordBatch.from_arrays(doc.flatten(), names=names), rows)

    names = docs.columns
    return joined.select("doc", "held", "spans").mapInArrow(count, _schema(docs))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, items)
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "n_words", "covered_words")
