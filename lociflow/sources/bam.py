"""Binary alignments (BAM): a data source that splits the compressed blocks of files over tasks, and its writer.

A split begins at the first block that starts in it and, in there, at the first place from which records follow one
another; it ends with the last record that starts in a block of its own. Files are opened with ``pyarrow.fs``, so paths may be URIs
of any store that it knows. CRAM isn't read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SPLIT = 32 << 20
#: Records that must follow one another before a place is taken for the start of one.
CHAIN = 8
SCHEMA = "file string, aln long, read string, flag int, chr string, start long, end long, strand string, mapq int, cigar string, record binary"

#: The formats' marks and letters.
_MAGIC, _BAM = b"\x1f\x8b\x08\x04", b"BAM\x01"
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_OPERATIONS = "MIDNSHP=X"
_ON_REFERENCE = frozenset("MDN=X")
_HEAD = struct.Struct("<iiBBHHHiiii")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^\w+://|^file:", path):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def files_of(path: str) -> list[str]:
    """The file, or the ``.bam`` files of a folder in order, as given paths; hidden names are left out."""
    fs, own = opened(path)
    info = fs.get_file_info(own)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(own))
    names = sorted(x.base_name for x in found if x.type == pafs.FileType.File and x.base_name.endswith(".bam") and x.base_name[0] not in "._")
    return [f"{path.rstrip('/')}/{n}" for n in names]


# --- blocks


def block(data: bytes, level: int = 6) -> bytes:
    """At most 65,280 bytes as one compressed block."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = len(body) + 25
    return _MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, size) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _block_size(head: bytes) -> int | None:
    """Of the block that begins with these 18 bytes; None if none does."""
    if len(head) < 18 or head[:4] != _MAGIC or head[12:16] != b"BC\x02\x00":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


class Blocks:
    """The bytes of a file's blocks from one on, loaded as they are asked for, with the place of each block."""

    def __init__(self, file, at: int):
        self.file, self.next, self.size = file, at, file.size()
        self.data = bytearray()
        self.starts: list[tuple[int, int]] = []  # place in data, place in the file

    def need(self, n: int) -> bool:
        while len(self.data) < n and self.next < self.size:
            self.file.seek(self.next)
            head = self.file.read(18)
            size = _block_size(head)
            if size is None:
                raise ValueError(f"no block at {self.next}")
            raw = head + self.file.read(size - 18)
            self.starts.append((len(self.data), self.next))
            self.data += zlib.decompress(raw[18:-8], -15)
            self.next += size
        return len(self.data) >= n

    def place(self, at: int) -> tuple[int, int]:
        """The block of a byte and its place in there."""
        from bisect import bisect_right

        k = bisect_right(self.starts, at, key=lambda s: s[0]) - 1
        while k + 1 < len(self.starts) and self.starts[k + 1][0] <= at:
            k += 1
        return self.starts[k][1], at - self.starts[k][0]

    def forget(self, upto: int) -> int:
        """Drops whole blocks before a byte; returns by how much places move."""
        k = sum(s <= upto for s, _ in self.starts) - 1
        if k <= 0:
            return 0
        moved = self.starts[k][0]
        del self.data[:moved]
        self.starts = [(s - moved, c) for s, c in self.starts[k:]]
        return moved


def first_block(file, start: int, end: int) -> int | None:
    """The first block that begins in a range of the file: one that is followed by another one or the end."""
    size, at = file.size(), start
    while at < end:
        file.seek(at)
        window = file.read(min(1 << 18, size - at))
        k = window.find(_MAGIC)
        while k >= 0:
            if at + k >= end:
                return None
            file.seek(at + k)
            if n := _block_size(file.read(18)):
                file.seek(at + k + n)
                if at + k + n == size or _block_size(file.read(18)):
                    return at + k
            k = window.find(_MAGIC, k + 1)
        at += max(1, len(window) - 3)
        if len(window) < 4:
            return None
    return None


# --- records


@dataclass
class Header:
    text: str
    references: list[tuple[str, int]]

    def encoded(self) -> bytes:
        raw = self.text.encode()
        out = _BAM + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(self.references))
        for name, length in self.references:
            out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
        return out


def _read_header(blocks: Blocks) -> tuple[Header, int]:
    """The header and the place of the first record."""

    def number(at):
        if not blocks.need(at + 4):
            raise ValueError("the header is cut off")
        return struct.unpack_from("<i", blocks.data, at)[0]

    if not blocks.need(8) or bytes(blocks.data[:4]) != _BAM:
        raise ValueError("not a BAM file")
    at = 8 + number(4)
    blocks.need(at)
    text = bytes(blocks.data[8:at]).rstrip(b"\0").decode()
    found = []
    count, at = number(at), at + 4
    for _ in range(count):
        n = number(at)
        blocks.need(at + 4 + n)
        found.append((bytes(blocks.data[at + 4 : at + 3 + n]).decode(), number(at + 4 + n)))
        at += 8 + n
    return Header(text, found), at


def header_of(path: str) -> Header:
    """Of a file, or the first of a folder."""
    files = files_of(path)
    if not files:
        raise FileNotFoundError(f"no .bam file in {path}")
    fs, own = opened(files[0])
    with fs.open_input_file(own) as f:
        return _read_header(Blocks(f, 0))[0]


def require_name_order(header: str) -> None:
    """An error unless the header says that records are sorted by read name."""
    if "SO:queryname" not in header:
        raise ValueError("alignments must be sorted by read name (SO:queryname)")


def _after(data: bytearray, at: int, references: int) -> int | None:
    """Where the record that may begin here ends; None if none can."""
    size, ref, pos, name, _, _, ops, _, length, ref2, pos2 = struct.unpack_from("<iiiBBHHHiii", data, at)
    if not 34 <= size < 1 << 29 or not -1 <= ref < references or not -1 <= ref2 < references or pos < -1 or pos2 < -1 or name < 2 or length < 0:
        return None
    return at + 4 + size if 32 + name + 4 * ops + (length + 1) // 2 + length <= size else None


def first_record(blocks: Blocks, references: int) -> int | None:
    """The first place from which CHAIN records, or all up to the end, follow one another."""

    def follow(at: int) -> bool:
        for k in range(CHAIN):
            if not blocks.need(at + 36):
                return len(blocks.data) == at and k > 0
            after = _after(blocks.data, at, references)
            if after is None or not blocks.need(at + 36 + blocks.data[at + 12]):
                return False
            name = blocks.data[at + 36 : at + 36 + blocks.data[at + 12]]
            if name[-1] or not all(32 < ch < 127 for ch in name[:-1]):
                return False
            at = after
        return True

    at = 0
    while blocks.need(at + 36):
        if follow(at):
            return at
        at += 1
    return None


def fields(data: bytes, names: list[str]) -> tuple:
    """``(read, flag, chr, start, end, strand, mapq, cigar)`` of a record's bytes after its size; positions count from 1."""
    ref, pos, n, mapq, _, ops, flag, *_ = _HEAD.unpack_from(data)
    read = data[32 : 31 + n].decode("ascii")
    codes = struct.unpack_from(f"<{ops}I", data, 32 + n)
    cigar = "".join(f"{x >> 4}{_OPERATIONS[x & 15]}" for x in codes) or "*"
    length = sum(x >> 4 for x in codes if _OPERATIONS[x & 15] in _ON_REFERENCE)
    return read, flag, names[ref] if ref >= 0 else None, pos + 1, pos + length, "-" if flag & 16 else "+", mapq, cigar


def encoded(read: str, flag: int, ref: int, start: int, mapq: int, cigar: str) -> bytes:
    """A record without sequence and tags."""
    codes = [int(n) << 4 | _OPERATIONS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    name = read.encode("ascii") + b"\0"
    return _HEAD.pack(ref, start - 1, len(name), mapq, 0, len(codes), flag, 0, -1, -1, 0) + name + struct.pack(f"<{len(codes)}I", *codes)


# --- data source


@dataclass
class _Split(InputPartition):
    file: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        out = []
        for name in files_of(self.path):
            fs, own = opened(name)
            size = fs.get_file_info(own).size
            out += [_Split(name, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return out or [_Split("", 0, 0)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        fs, own = opened(part.file)
        with fs.open_input_file(own) as f:
            blocks = Blocks(f, 0)
            header, at = _read_header(blocks)
            if part.start > 0:
                begin = first_block(f, part.start, part.end)
                if begin is None:
                    return
                blocks = Blocks(f, begin)
                at = first_record(blocks, len(header.references))
                if at is None:
                    return
            yield from self._batches(blocks, at, part, [n for n, _ in header.references])

    def _batches(self, blocks, at, part, names):
        rows = []
        while blocks.need(at + 4):
            coffset, within = blocks.place(at)
            if coffset >= part.end:
                break
            size = struct.unpack_from("<i", blocks.data, at)[0]
            if not blocks.need(at + 4 + size):
                raise ValueError(f"{part.file}: the last record is cut off")
            record = bytes(blocks.data[at + 4 : at + 4 + size])
            rows.append((part.file, coffset << 16 | within, *fields(record, names), record))
            at += 4 + size
            if len(rows) >= 4000:
                yield _batch(rows)
                rows = []
            if len(blocks.starts) > 64:
                at -= blocks.forget(at)
        if rows:
            yield _batch(rows)


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows) -> pa.RecordBatch:
    names, types = zip(*(f.split() for f in SCHEMA.split(", ")))
    return pa.record_batch([pa.array(c, _TYPES[t]) for c, t in zip(zip(*rows), types)], list(names))


@dataclass
class _Written(WriterCommitMessage):
    temporary: str


class _Writer(DataSourceArrowWriter):
    """A file for each task, under a hidden name until all are there."""

    def __init__(self, path: str, header: bytes, at: int):
        self.path, self.header, self.at = path.rstrip("/"), header, at

    def write(self, iterator):
        import uuid

        fs, own = opened(self.path)
        fs.create_dir(own)
        name = f"{own}/.{uuid.uuid4().hex}.bam"
        with fs.open_output_stream(name) as out:
            held = bytearray(self.header)
            for batch in iterator:
                for record in batch.column(self.at).to_pylist():
                    if len(held) + len(record) + 4 > 65_280:
                        self._flush(out, held)
                    held += struct.pack("<i", len(record)) + record
                    while len(held) > 65_280:  # a long record spans blocks
                        out.write(block(bytes(held[:65_280])))
                        del held[:65_280]
            self._flush(out, held)
            out.write(_END)
        return _Written(name)

    @staticmethod
    def _flush(out, held) -> None:
        while held:
            out.write(block(bytes(held[:65_280])))
            del held[:65_280]

    def commit(self, messages) -> None:
        fs, own = opened(self.path)
        for k, m in enumerate(x for x in messages if x):
            fs.move(m.temporary, f"{own}/part-{k:05d}.bam")

    def abort(self, messages) -> None:
        for m in messages:
            if m:
                opened(self.path)[0].delete_file(m.temporary)


class BamSource(DataSource):
    """``format("bam")``. Reading: option ``split``, bytes of a file for each task. Writing: a column ``record``, option ``header`` (hexadecimal)."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], bytes.fromhex(self.options["header"]), schema.fieldNames().index("record"))


def bam(spark: SparkSession, path: str, split: int = SPLIT, mapped: bool = True) -> DataFrame:
    """Alignments of a BAM file or a folder of them; ``aln`` is a record's virtual offset, ``record`` its bytes.

    ``mapped``: only those with a place on a reference.
    """
    spark.dataSource.register(BamSource)
    rows = spark.read.format("bam").option("split", str(split)).load(path)
    return rows.where(F.col("chr").isNotNull() & (F.col("flag").bitwiseAND(F.lit(4)) == 0)) if mapped else rows


def write_bam(rows: DataFrame, path: str, header: Header) -> None:
    """Records of ``rows``, a file for each of its partitions; no rows, no records."""
    rows.sparkSession.dataSource.register(BamSource)
    rows.select("record").write.format("bam").option("header", header.encoded().hex()).mode("append").save(path)


def records(rows: DataFrame, header: Header) -> DataFrame:
    """``rows`` with (read, flag, chr, start, mapq, cigar) get ``record``; a null ``chr`` has no place. An unknown one is an error."""
    at = {name: k for k, (name, _) in enumerate(header.references)} | {None: -1}

    def run(batches):
        for batch in batches:
            own = [encoded(read, flag, at[c], start or 0, mapq, cigar) for read, flag, c, start, mapq, cigar in zip(*(x.to_pylist() for x in batch.columns[:6]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], names=[*batch.schema.names, "record"])

    first = ["read", "flag", "chr", "start", "mapq", "cigar"]
    rest = [c for c in rows.columns if c not in (*first, "record")]
    shape = rows.select(*first, *rest, F.lit(b"").alias("record")).schema
    return rows.select(*first, *rest).mapInArrow(run, shape)


def filter_bam(spark: SparkSession, path: str, target: str, names: DataFrame, keep: bool = True, by_name: bool = False, split: int = SPLIT) -> None:
    """The records of the named reads (or of all others) as BAM files with the header of the first one, splits in their order.

    ``by_name``: an error unless the header says that records are sorted by read name.
    """
    header = header_of(path)
    if by_name:
        require_name_order(header.text)
    rows = bam(spark, path, split, mapped=False).join(names.select("read").distinct(), "read", "left_semi" if keep else "left_anti")
    write_bam(rows.sort("file", "aln"), target, header)
