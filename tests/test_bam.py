import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from lociflow.sources import bam as B


def binary(reads, references, text="@HD\tVN:1.6\tSO:queryname\n", block=None, seed=0):
    """A BAM file made here: (read, flag, ref, pos from 0, [(length, op)], sequence length, tags)."""
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(references))
    for name, length in references:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    rng = random.Random(seed)
    for read, flag, ref, pos, cigar, n, tags in reads:
        name = read.encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 60, 4681, len(cigar), flag, n, -1, -1, 0) + name
        body += b"".join(struct.pack("<I", k << 4 | "MIDNSHP=X".index(o)) for k, o in cigar)
        body += rng.randbytes((n + 1) // 2) + rng.randbytes(n) + tags
        out += struct.pack("<i", len(body)) + body
    blocks = b""
    at = 0
    while at < len(out):
        n = block or rng.randrange(200, 60_000)
        blocks += B.block(out[at : at + n])
        at += n
    return blocks + B.block(b"")


def drawn(n, seed, longest=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        mapped = rng.random() < 0.9
        cigar = [(rng.randrange(1, 50), rng.choice("MIDS=X")) for _ in range(rng.randrange(1, 6))] if mapped else []
        out.append((f"read{i // 3}", (16 if rng.random() < 0.5 else 0) if mapped else 4, rng.randrange(3) if mapped else -1, rng.randrange(10**6) if mapped else -1, cigar, rng.randrange(longest), rng.randbytes(rng.randrange(40))))
    return out


REFERENCES = [("1", 10**7), ("X", 10**6), ("chrM", 16_000)]


def expected(reads):
    out = []
    for read, flag, ref, pos, cigar, _, _ in reads:
        if not flag & 4:
            out.append((read, flag, REFERENCES[ref][0], pos + 1, pos + sum(k for k, o in cigar if o in "MDN=X"), "-" if flag & 16 else "+", "".join(f"{k}{o}" for k, o in cigar)))
    return out


def rows(df):
    return [tuple(r) for r in df.orderBy("file", "aln").select("read", "flag", "chr", "start", "end", "strand", "cigar").collect()]


@pytest.mark.parametrize("split", [1 << 30, 20_000, 3_000])
def test_any_split_gives_each_record_once(spark, tmp_path, split):
    reads = drawn(1500, split)
    (tmp_path / "a.bam").write_bytes(binary(reads, REFERENCES, seed=split))
    df = B.bam(spark, str(tmp_path / "a.bam"), split)
    assert rows(df) == expected(reads)
    if split < 1 << 30:
        assert df.rdd.getNumPartitions() > 3


def test_records_longer_than_blocks(spark, tmp_path):
    reads = drawn(40, 3, longest=30_000)
    (tmp_path / "a.bam").write_bytes(binary(reads, REFERENCES, block=5_000))
    assert rows(B.bam(spark, f"file://{tmp_path}/a.bam", 16_000)) == expected(reads)


def test_blocks_are_gzip(tmp_path):
    data = binary(drawn(50, 1), REFERENCES)
    assert gzip.decompress(data)[:4] == b"BAM\x01" and gzip.decompress(B.block(b"abc") + B._END) == b"abc"


def test_written_files_are_read_back(spark, tmp_path):
    reads = drawn(900, 8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bam").write_bytes(binary(reads[:500], REFERENCES))
    (tmp_path / "in/b.bam").write_bytes(binary(reads[500:], REFERENCES))
    names = spark.createDataFrame([(f"read{i}",) for i in range(0, 300, 2)] + [("read0",)], "read string")
    B.filter_bam(spark, str(tmp_path / "in"), str(tmp_path / "out"), names, by_name=True, split=30_000)
    kept = [x for x in expected(reads) if int(x[0][4:]) % 2 == 0]
    assert rows(B.bam(spark, str(tmp_path / "out"))) == kept
    B.filter_bam(spark, str(tmp_path / "in"), str(tmp_path / "rest"), names, keep=False)
    assert sorted(rows(B.bam(spark, str(tmp_path / "rest")))) == sorted(set(expected(reads)) - set(kept)) or len(rows(B.bam(spark, str(tmp_path / "rest")))) == len(expected(reads)) - len(kept)
    assert B.header_of(str(tmp_path / "out")).references == REFERENCES
    raw = gzip.decompress((tmp_path / "out" / "part-00000.bam").read_bytes())
    assert raw.startswith(b"BAM\x01")


def test_records_from_columns(spark, tmp_path):
    header = B.Header("@HD\tVN:1.6\tSO:coordinate\n", REFERENCES)
    df = spark.createDataFrame([("a", 16, "X", 5, 60, "3S10M2D4M", "x"), ("b", 4, None, None, 0, "*", "y")], "read string, flag int, chr string, start long, mapq int, cigar string, extra string")
    B.write_bam(B.records(df, header), str(tmp_path / "out"), header)
    assert rows(B.bam(spark, str(tmp_path / "out"))) == [("a", 16, "X", 5, 20, "-", "3S10M2D4M")]
    assert B.bam(spark, str(tmp_path / "out"), mapped=False).where(F.col("chr").isNull()).select("read", "cigar").collect() == [("b", "*")]
    with pytest.raises(ValueError, match="sorted by read name"):
        B.filter_bam(spark, str(tmp_path / "out"), str(tmp_path / "no"), df, by_name=True)


def test_no_records_and_no_bam(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(binary([], REFERENCES))
    assert B.bam(spark, str(tmp_path / "a.bam"), 100).collect() == []
    (tmp_path / "b.bam").write_bytes(B.block(b"text, not alignments"))
    with pytest.raises(Exception, match="not a BAM file"):
        B.bam(spark, str(tmp_path / "b.bam")).collect()
