"""Token ids in files of patched frame-of-reference blocks.

A file, all numbers little-endian:

    magic        8 bytes  LFPFOR01
    blocks       one after another
    block index  uint64 for each block: where it starts in the file
    documents    int64 id for each, then uint8 for each (1: the id is null), then int64 count of ids for each
    footer       uint64 blocks, documents, ids; uint32 ids a block; magic

    block        uint32 minimum, uint16 ids, uint16 exceptions, uint8 width
                 each id less the minimum in ``width`` bits, lowest bit first, padded to a byte
                 uint16 position of each exception, then uint32 its value less the minimum

The width is what ``share`` of the block's ids need; those that need more are the exceptions. Blocks run
on across documents, and only a file's last block may be short.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.encoding import encoder, portions
from lociflow.shared import cut, ensure_importable, fresh_path

MAGIC = b"LFPFOR01"
HEAD = np.dtype([("low", "<u4"), ("n", "<u2"), ("odd", "<u2"), ("width", "u1")])
FOOT = struct.Struct("<QQQI8s")
BLOCK = 256
#: Blocks worked on at a time; bounds memory.
SLAB = 2048
#: Ids after which a writer begins another file.
FILE_IDS = 4_000_000


def pack(ids: np.ndarray, block: int = BLOCK, share: float = 0.9) -> list[bytes]:
    """The blocks of ``ids`` (uint32); all but the last are full."""
    out: list[bytes] = []
    for begin in range(0, len(ids), block * SLAB):
        out += _pack_slab(ids[begin : begin + block * SLAB], block, share)
    return out


def _pack_slab(ids: np.ndarray, block: int, share: float) -> list[bytes]:
    n = -(-len(ids) // block)
    counts = np.full(n, block)
    counts[-1] = len(ids) - block * (n - 1)
    full = np.full(n * block, ids[-1], np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n, block)
    low = full.min(1)
    rest = full - low[:, None]
    need = np.frexp(rest.astype(np.float64))[1]  # bits of each number
    need[-1, counts[-1] :] = 0
    rest[-1, counts[-1] :] = 0
    ranked = np.sort(need, 1)
    place = block - 1 - (counts - np.ceil(share * counts)).astype(int)  # a short block's padding ranks lowest
    width = ranked[np.arange(n), np.clip(place, 0, block - 1)]
    odd = need > width[:, None]
    slots = np.where(odd, np.uint32(0), rest)
    out: list = [None] * n
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            bits = np.unpackbits(slots[rows].astype("<u4").view(np.uint8).reshape(len(rows), block, 4), axis=2, bitorder="little", count=int(w))
            bytes_ = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        for k, r in enumerate(rows):
            at = np.flatnonzero(odd[r])
            head = np.array((low[r], counts[r], len(at), w), HEAD).tobytes()
            body = bytes_[k, : (int(counts[r]) * int(w) + 7) // 8].tobytes() if w else b""
            out[r] = head + body + (at.astype("<u2").tobytes() + rest[r, at].astype("<u4").tobytes() if len(at) else b"")
    return out


def unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at ``starts`` in the bytes ``data``."""
    parts = [_unpack_slab(data, starts[i : i + SLAB]) for i in range(0, len(starts), SLAB)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _take(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return data[starts[:, None] + np.arange(n)]


def _unpack_slab(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    head = np.ascontiguousarray(_take(data, starts, HEAD.itemsize)).view(HEAD)[:, 0]
    n, width, odd = (head[k].astype(np.int64) for k in ("n", "width", "odd"))
    first = np.cumsum(n) - n
    out = np.repeat(head["low"], n)
    body = starts + HEAD.itemsize
    for w, size in {*zip(width.tolist(), n.tolist())}:
        if w:
            rows = np.flatnonzero((width == w) & (n == size))
            bits = np.unpackbits(_take(data, body[rows], (size * w + 7) // 8), axis=1, bitorder="little", count=size * w)
            full = np.zeros((len(rows), size, 32), np.uint8)
            full[:, :, :w] = bits.reshape(len(rows), size, w)
            out[first[rows][:, None] + np.arange(size)] += np.packbits(full, axis=2, bitorder="little").view("<u4")[:, :, 0]
    at = body + (n * width + 7) // 8
    for r in np.flatnonzero(odd):
        k = int(odd[r])
        where = data[at[r] : at[r] + 2 * k].view("<u2")
        value = np.frombuffer(data[at[r] + 2 * k : at[r] + 6 * k].tobytes(), "<u4")
        out[first[r] + where] += value
    return out


class Writer:
    """Writes one file beside its name and moves it there when it is whole, so a task that is tried again,
    or runs twice, leaves one whole file."""

    def __init__(self, folder: str, name: str, block: int, share: float):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = f"{root}/{name}"
        self.temp = f"{root}/_{name}.{os.getpid()}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
        self.out = self.fs.open_output_stream(self.temp)
        self.block, self.share = block, share
        self.out.write(MAGIC)
        self.at, self.n_ids, self.waiting = len(MAGIC), 0, np.empty(0, np.uint32)
        self.starts: list[int] = []
        self.docs: list[np.ndarray] = []

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        table = np.zeros(len(sizes), [("id", "<i8"), ("null", "u1"), ("n", "<i8")])
        table["id"] = [0 if x is None else x for x in doc_ids]
        table["null"] = [x is None for x in doc_ids]
        table["n"] = sizes
        self.docs.append(table)
        self.n_ids += len(ids)
        ids = np.concatenate([self.waiting, ids])
        ready = len(ids) - len(ids) % self.block
        self._put(ids[:ready])
        self.waiting = ids[ready:]

    def _put(self, ids: np.ndarray) -> None:
        for x in pack(ids, self.block, self.share):
            self.starts.append(self.at)
            self.at += len(x)
            self.out.write(x)

    def close(self) -> tuple[int, int]:
        self._put(self.waiting)
        docs = np.concatenate(self.docs)
        self.out.write(np.array(self.starts, "<u8").tobytes())
        for k in ("id", "null", "n"):
            self.out.write(np.ascontiguousarray(docs[k]).tobytes())
        self.out.write(FOOT.pack(len(self.starts), len(docs), self.n_ids, self.block, MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.final)
        return len(docs), self.n_ids


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def read_file(content: bytes):
    """Yields ``(doc_id or None, ids)`` of each document, in the file's order."""
    data = np.frombuffer(content, np.uint8)
    n_blocks, n_docs, n_ids, block, magic = FOOT.unpack(content[-FOOT.size :])
    if content[: len(MAGIC)] != MAGIC or magic != MAGIC:
        raise ValueError("not a file of patched frame-of-reference blocks")
    at = len(content) - FOOT.size - 17 * n_docs - 8 * n_blocks
    starts = np.frombuffer(content, "<u8", n_blocks, at).astype(np.int64)
    at += 8 * n_blocks
    ids = np.frombuffer(content, "<i8", n_docs, at).tolist()
    null = np.frombuffer(content, "u1", n_docs, at + 8 * n_docs).tolist()
    sizes = np.frombuffer(content, "<i8", n_docs, at + 9 * n_docs)
    ends = np.cumsum(sizes)
    # Documents are decoded from the blocks they lie in; blocks of several documents are decoded once.
    begin = 0
    while begin < n_docs:
        base = int(ends[begin] - sizes[begin])
        end = max(begin + 1, int(np.searchsorted(ends, base + block * SLAB, "right")))
        lo, hi = base // block, -(-int(ends[end - 1]) // block)
        part = unpack(data, starts[lo:hi])
        for d in range(begin, end):
            stop = int(ends[d]) - lo * block
            yield (None if null[d] else ids[d]), part[stop - int(sizes[d]) : stop]
        begin = end


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, share: float = 0.9) -> DataFrame:
    """Encode whole texts and write files under ``folder`` (a URI that pyarrow can write), documents in
    ascending id order from file to file.

    Null ids come first, rows that repeat an id stand in order of their text's hash, a null or empty text
    has just the end id. An empty table gives no files. Returns a row for each file: ``file``, ``docs``,
    ``ids`` and ``start``, the ids in the files before it. Starts are summed within a range of documents and
    then, in one task, over the ranges.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held // (32 << 20))
    dealt = rows.repartitionByRange(ranges, "id", "tie").sortWithinPartitions("id", "tie")

    def run(batches):
        encode, part, writer, number = encoder(tokenizer).encode, TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for b, e in portions(texts):
                flat, size = encode(texts[b:e])
                if end_id is not None:
                    flat = np.insert(flat, np.cumsum(size), end_id)
                    size = size + 1
                if writer is None:
                    writer = Writer(folder, f"ids-{part:08d}-{number:06d}.pfor", block, share)
                writer.add(ids[b:e], size, flat)
                if writer.n_ids >= FILE_IDS:
                    yield _row(writer)
                    writer, number = None, number + 1
        if writer is not None:
            yield _row(writer)

    found = cut(dealt.mapInArrow(run, "file string, docs long, ids long"), "token-files")
    found = found.withColumn("range", F.substring("file", 5, 8))
    zero = F.lit(0).cast("long")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = found.groupBy("range").agg(F.sum("ids").alias("n")).select("range", F.coalesce(F.sum("n").over(before), zero).alias("before"))
    within = Window.partitionBy("range").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return found.join(ranges, "range").select("file", "docs", "ids", (F.col("before") + F.coalesce(F.sum("ids").over(within), zero)).alias("start"))


def _row(writer: Writer) -> pa.RecordBatch:
    docs, ids = writer.close()
    return pa.record_batch([pa.array([writer.final.rsplit("/", 1)[1]]), pa.array([docs], pa.int64()), pa.array([ids], pa.int64())], ["file", "docs", "ids"])


#: Tasks that read files, for each core.
READS_PER_CORE = 8


def read_ids(folder: str, files: DataFrame, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of each document in the files that ``write_ids`` returned, or its CRC-32 in place
    of the ids. Each file is opened where its row is; no files, no rows."""
    kind = "ids_crc32 long" if digest else "ids array<long>"

    def run(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    content = f.read()
                rows = []
                for doc_id, ids in read_file(content):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids))
                    start += len(ids)
                    if len(rows) >= (4096 if digest else 64):
                        yield _docs(rows, digest)
                        rows = []
                if rows:
                    yield _docs(rows, digest)

    listed = cut(files.select("file", "start"), "token-starts")
    # A task reads several files where there are many, one after another.
    tasks = max(1, min(listed.count(), READS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism))
    return listed.repartition(tasks).mapInArrow(run, f"doc_id long, start long, n_tokens long, {kind}")


def _docs(rows: list, digest: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    last = pa.array(cols[3], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in cols[3]], pa.list_(pa.int64()))
    return pa.record_batch([*(pa.array(c, pa.int64()) for c in cols[:3]), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest_of(docs: DataFrame) -> DataFrame:
    """Written to the shared folder and read back."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-ids")
    return read_ids(folder, write_ids(docs, default_tokenizer(), folder), digest=True)


def op7(spark, sf_dir: str) -> DataFrame:
    return digest_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
