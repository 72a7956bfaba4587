"""Queries for readers and writers: texts are made from the views, written to the shared folder and read by the reader, or made by the writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.plans.queries import query
from lociflow.shared import fresh_path
from lociflow.sources import bam as BM
from lociflow.sources import canonical as C
from lociflow.sources import copy_number as CN
from lociflow.sources import sinks as S
from lociflow.sources import tabular as TB
from lociflow.sources import vcf as V

ENDS = ["chr1", "coord1", "strand1", "chr2", "coord2", "strand2"]


def files_for_lines(v) -> int:
    """Files for lines that grow with the orders: about a million rows of ``lineitem``, or 250,000 orders, each."""
    return max(4, v.lineitem.count() // 1_000_000)


def _texts(v, head: list[str], rows: DataFrame, *lines: str, files: int = 1, named: bool = False) -> str:
    """The path of ``head`` and, for each row in order of its ``k``, the lines that Spark SQL makes from it.

    Lines of one ``k`` are in one file, and files follow one another in order of their names. ``named``: the head is one line of names, and each file has it.
    """
    own = rows.selectExpr("k", f"posexplode(array({', '.join(lines)})) AS (n, value)")
    first = v.spark.createDataFrame([(-1, n, x) for n, x in enumerate(head)], "k long, n int, value string")
    every = (own if named else first.unionByName(own)).where("value <> ''")
    placed = every.orderBy("k", "n").coalesce(1) if files == 1 else every.repartitionByRange(files, "k").sortWithinPartitions("k", "n")
    path = fresh_path(v.spark, "texts")
    if named:
        placed.select(F.col("value").alias(*head)).write.csv(path, sep="\x01", header=True, quote="", escape="", emptyValue="")
    else:
        placed.select("value").write.text(path)
    return path


def _tabs(*columns: str) -> str:
    return f"concat_ws('\\t', {', '.join(columns)})"


def _record(id_: str, info: str, alt: str = "'<X>'", second: bool = False, ref: str = "'N'", more: tuple[str, ...] = ()) -> str:
    n = 2 if second else 1
    return _tabs(f"'chr' || chr{n}", f"coord{n}", id_, ref, alt, "'.'", "'PASS'", info, *more)


def _bracket(n: int) -> str:
    """ALT of the record whose mate is end ``n``."""
    b = f"if(strand{n} = '+', ']', '[')"
    return f"'N' || {b} || chr{n} || ':' || coord{n} || {b}"


def _pair(first: str, second: str, info: str = "''", more: tuple[str, ...] = ()) -> list[str]:
    """Two breakend records that name one another."""
    return [_record(a, f"'SVTYPE=BND;MATEID=' || {b} || {info}", _bracket(2 if a is first else 1), a is second, more=more) for a, b in ((first, second), (second, first))]


def _if(test: str, *lines: str) -> list[str]:
    return [f"if({test}, {x}, '')" for x in lines]


def _vcf(v, *lines: str, samples: str = "") -> DataFrame:
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO" + (f"\tFORMAT\t{samples}" if samples else "")
    return V.records(v.spark, _texts(v, ["##fileformat=VCFv4.2", head], v.adj, *lines, files=files_for_lines(v)))


def _in_order(raw: str, more: str = "") -> str:
    """DuckDB: ends of one chromosome in model order."""
    swap = "chr1 = chr2 AND (coord1 > coord2 OR (coord1 = coord2 AND strand1 = '+' AND strand2 = '-'))"
    two = lambda x: f"CASE WHEN {swap} THEN {x}2 ELSE {x}1 END AS {x}1, CASE WHEN {swap} THEN {x}1 ELSE {x}2 END AS {x}2"
    return f"SELECT aid, chr1, {two('coord')}, {two('strand')}, chr2{more} FROM ({raw}) t"


_SAME, _OTHER = "chr1 = chr2", "chr1 <> chr2"
_AS_IS = f"SELECT %s AS aid, chr1, coord1, strand1, chr2, coord2, strand2%s FROM adj WHERE {_OTHER}"


def _own(type_: str, aid: str, x1: str, s1: str, x2: str, s2: str, more: str = "") -> str:
    return f"SELECT {aid} AS aid, chr1, {x1} AS coord1, '{s1}' AS strand1, chr2, {x2} AS coord2, '{s2}' AS strand2{more} FROM adj WHERE {_SAME} AND {type_}"


# --- canonical tables


@query("q_read_segments", "SELECT sid, clone, hap, cn FROM scnt")
def _(v):
    path = fresh_path(v.spark, "texts")
    S.write_table(S.segment_rows(v.seg, v.scnt), path)
    return C.scnt(C.segments(v.spark, path))


@query("q_read_segments_of_a_clone", "SELECT sid, clone, hap, cn FROM scnt WHERE clone = 'c2'")
def _(v):
    path = fresh_path(v.spark, "texts")
    S.write_table(S.segment_rows(v.seg, v.scnt), path, single=True)
    return C.scnt(C.segments(v.spark, path), ["c2"])


@query("q_read_bounds", "SELECT sid, clone, hap, 'l' AS bound, greatest(cn - 1, 0) AS value FROM scnt UNION ALL SELECT sid, clone, hap, 'u', cn + 1 FROM scnt")
def _(v):
    tidy = v.scnt.selectExpr("sid", "clone", "hap", "explode(map('l', greatest(cn - 1, 0), 'u', cn + 1)) AS (bound, value)")
    path = fresh_path(v.spark, "texts")
    S.write_table(S.segment_rows(v.seg, scnb=tidy), path)
    return C.scnb(C.segments(v.spark, path), allow_missing=False)


@query("q_read_legacy_copy_numbers", "SELECT sid, clone, hap, cn FROM scnt")
def _(v):
    wide = v.scnt.groupBy("sid").agg(*(F.max(F.when((F.col("clone") == c) & (F.col("hap") == h), F.col("cn"))).alias(c + h) for c in ("c1", "c2") for h in "AB"))
    rows = v.seg.join(wide, "sid").withColumn("k", F.col("c") * 1000 + F.col("i"))
    return C.legacy_scnt(v.spark, _texts(v, ["chr\tstart\tend\tCNs", "# none"], rows, _tabs("chr", "start", "`end`", "'(c1,' || c1A || ',' || c1B || ');(c2,' || c2A || ',' || c2B || ')'")))


@query("q_read_legacy_bounds", "SELECT sid, 'c1' AS clone, h AS hap, b AS bound, CASE WHEN b = 'l' THEN 0 WHEN h = 'A' THEN i % 5 ELSE i % 7 END AS value FROM seg, (VALUES ('A'), ('B')) x(h), (VALUES ('l'), ('u')) y(b)")
def _(v):
    rows = v.seg.withColumn("k", F.col("c") * 1000 + F.col("i"))
    return C.legacy_scnb(v.spark, _texts(v, ["chr\tstart\tend\tbounds"], rows, _tabs("chr", "start", "`end`", "'(c1,0-' || (i % 5) || ',0-' || (i % 7) || ')'")))


@query("q_read_adjacencies", "SELECT aid, '[' || chr1 || ':' || strand1 || coord1 || ']-[' || chr2 || ':' || strand2 || coord2 || ']N' AS stable_id, clone, phasing, cn FROM acnt JOIN adj USING (aid)")
def _(v):
    path = fresh_path(v.spark, "texts")
    S.write_table(S.adjacency_rows(v.adj, v.acnt), path)
    return C.acnt(C.adjacencies(v.spark, path))


@query("q_read_adjacency_ends", "SELECT aid, chr1, coord1, strand1, chr2, coord2, strand2, 'N' AS at, sources FROM adj")
def _(v):
    rows = v.adj.withColumn("extra", F.create_map(F.lit("Sources"), F.col("sources")))
    path = fresh_path(v.spark, "texts")
    S.write_table(S.adjacency_rows(rows, mixed=False), path)
    back = C.adjacencies(v.spark, path)
    return back.select("aid", *ENDS, "at", F.try_element_at("extra", F.lit("sources")).alias("sources"))


@query("q_read_legacy_adjacency_copies", "SELECT 'o' || k AS aid, clone, phasing, CASE WHEN phasing IN ('AA', 'BB') THEN k % 3 ELSE 0 END AS cn FROM adj, cl, ph")
def _(v):
    entry = " || ';' || ".join(f"'({c},' || k % 3 || ',0,0,' || k % 3 || ')'" for c in ("c1", "c2"))
    path = _texts(v, ["\t".join(["aid", *ENDS, "CNs"])], v.adj, _tabs("aid", *ENDS, entry), files=files_for_lines(v), named=True)
    return C.acnt(C.adjacencies(v.spark, path)).drop("stable_id")


@query("q_read_positions", "SELECT chr, coord, strand FROM breakend")
def _(v):
    path = fresh_path(v.spark, "texts")
    S.write_table(S.position_rows(v.breakend), path)
    return C.positions(v.spark, path)


@query("q_read_groups", """SELECT gid, any_value(agt) AS agt, any_value(fp)::DOUBLE AS fp, string_agg(aid, ',' ORDER BY pos) AS aids, string_agg(side::VARCHAR, ',' ORDER BY pos) AS agl FROM member GROUP BY gid""")
def _(v):
    path = fresh_path(v.spark, "texts")
    S.write_table(S.group_rows(v.groups()), path)
    return C.groups(v.spark, path).select("gid", "agt", "fp", F.array_join("aids", ",").alias("aids"), F.array_join(F.transform("agl", lambda x: x.cast("string")), ",").alias("agl"))


_PARSED = """SELECT aid, 'v' || k AS a, 'true' AS flag, CASE WHEN k % 2 = 0 THEN 'late' END AS b FROM adj"""


@query("q_parse_extra", _PARSED)
def _(v):
    from lociflow.functions.extras import parse_extra

    extra = parse_extra(F.expr("'a=v' || k || ';flag' || if(k % 2 = 0, ';b=early;b=late', '')"))
    of = lambda k: F.try_element_at("e", F.lit(k)).alias(k)
    return v.adj.withColumn("e", extra).select("aid", of("a"), of("flag"), of("b"))


@query("q_stringify_extra", "SELECT aid, 'a=' || sources || ';z=' || k AS whole, 'none=?;z=' || k AS chosen FROM adj")
def _(v):
    from lociflow.functions.extras import stringify_extra

    extra = F.create_map(F.lit("Z"), F.col("k").cast("string"), F.lit("a"), F.col("sources"))
    return v.adj.select("aid", stringify_extra(extra).alias("whole"), stringify_extra(extra, ["z", "NONE"], "?").alias("chosen"))


@query("q_read_regions", """SELECT chr, start, "end" FROM regions UNION ALL SELECT chr, 0, 3000000000 FROM regions UNION ALL SELECT chr, start, "end" FROM regions""")
def _(v):
    rows = v.regions.withColumn("k", F.col("start"))
    path = _texts(v, ["# regions", ""], rows, "chr || ':' || start || '-' || `end`", "chr", _tabs("chr", "start", "`end`", "'x'"))
    return C.regions(v.spark, path).drop("rid")


@query("q_read_chromosome_sizes", "SELECT chr, start AS size FROM regions")
def _(v):
    return C.chr_sizes(v.spark, _texts(v, ["# sizes"], v.regions.withColumn("k", F.col("start")), "chr || '   ' || start"))


@query("q_read_names", "SELECT DISTINCT read FROM support")
def _(v):
    return C.read_names(v.spark, _texts(v, ["# names"], v.support.withColumn("k", F.col("l_partkey")), "'  ' || read", files=files_for_lines(v)))


def _sam(v) -> str:
    cigar = "if(k % 2 = 0, '5S' || (10 + k % 90) || 'M3D20M', (10 + k % 90) || 'M2I7=')"
    return _texts(v, ["@HD\tVN:1.6"], v.adj, _tabs("'r' || k % 100", "CASE WHEN k % 7 = 0 THEN 4 WHEN strand1 = '-' THEN 16 ELSE 0 END", "chr1", "coord1", "60", cigar, "'*'", "0", "0", "'*'", "'*'"), files=files_for_lines(v))


@query("q_read_alignments", """SELECT 'r' || k % 100 AS read, chr1 AS chr, coord1 AS start, coord1 + 10 + k % 90 + CASE WHEN k % 2 = 0 THEN 23 ELSE 7 END - 1 AS "end", strand1 AS strand FROM adj WHERE k % 7 <> 0""")
def _(v):
    return C.sam(v.spark, _sam(v)).select("read", "chr", "start", "end", "strand")


@query("q_filter_alignments", "SELECT 'r' || k % 100 AS read, count(*) AS n FROM adj WHERE k % 100 < 30 GROUP BY ALL UNION ALL SELECT '@HD', 1")
def _(v):
    names = v.spark.range(30).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("read"))
    lines = C.filter_alignments(v.spark, _sam(v), names)
    return lines.groupBy(F.split("value", "\t")[0].alias("read")).agg(F.count("*").alias("n"))


def _bam(v) -> str:
    """The same alignments in binary, in several files."""
    cigar = "if(k % 2 = 0, '5S' || (10 + k % 90) || 'M3D20M', (10 + k % 90) || 'M2I7=')"
    flag = "CASE WHEN k % 7 = 0 THEN 4 WHEN strand1 = '-' THEN 16 ELSE 0 END"
    rows = v.adj.selectExpr("'r' || k % 100 AS read", f"CAST({flag} AS INT) AS flag", "chr1 AS chr", "coord1 AS start", "60 AS mapq", f"{cigar} AS cigar")
    header = BM.Header("@HD\tVN:1.6\tSO:queryname\n", [(str(c), 2_000_000) for c in range(1, 23)])
    path = fresh_path(v.spark, "bam")
    BM.write_bam(BM.records(rows, header).repartition(3).sortWithinPartitions("read"), path, header)
    return path


@query("q_read_bam", """SELECT 'r' || k % 100 AS read, chr1 AS chr, coord1 AS start, coord1 + 10 + k % 90 + CASE WHEN k % 2 = 0 THEN 23 ELSE 7 END - 1 AS "end", strand1 AS strand FROM adj WHERE k % 7 <> 0""")
def _(v):
    return BM.bam(v.spark, _bam(v), split=60_000).select("read", "chr", "start", "end", "strand")


@query("q_filter_bam", "SELECT 'r' || k % 100 AS read, count(*) AS n FROM adj WHERE k % 100 < 30 GROUP BY ALL")
def _(v):
    names = v.spark.range(30).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("read"))
    target = fresh_path(v.spark, "bam")
    BM.filter_bam(v.spark, _bam(v), target, names, by_name=True)
    return BM.bam(v.spark, target, mapped=False).groupBy("read").agg(F.count("*").alias("n"))


# --- callers that write VCF


@query("q_vcf_records", "SELECT 'i' || k AS id, coord1 + 1 AS pos, 'v' || k % 5 AS a, 'true' AS flag FROM adj")
def _(v):
    lines = [_tabs("chr1", f"coord1 + {n}", "'i' || k", "'N'", "'.'", "'.'", "'.'", "'A=v' || k % 5 || ';FLAG'") for n in (0, 1)]
    return _vcf(v, *lines).select("id", "pos", V.info("A").alias("a"), V.info("FLAG").alias("flag"))


_TYPES = "CASE k % 3 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' ELSE 'INV' END"
_END = f"'SVTYPE=' || {_TYPES} || ';END=' || coord2"
_OR = ", svtype AS or_svtype"


@query(
    "q_vcf_lumpy",
    _in_order(
        " UNION ALL ".join(
            [
                _own("k % 3 = 0", "k::VARCHAR", "coord1 - 1", "+", "coord2 + 1", "-", ", 'DEL' AS svtype"),
                _own("k % 3 = 1", "k::VARCHAR", "coord1", "-", "coord2", "+", ", 'DUP'"),
                _own("k % 3 = 2", "k || '_1'", "coord1 - 1", "+", "coord2", "+", ", 'INV'"),
                _own("k % 3 = 2", "k || '_2'", "coord1", "-", "coord2 + 1", "-", ", 'INV'"),
                _AS_IS % ("k::VARCHAR", ", 'BND'"),
            ]
        ),
        _OR,
    ),
)
def _(v):
    own, two = _if(_SAME, _record("string(k)", _END)), _if(_OTHER, *_pair("k || '_1'", "k || '_2'"))
    return V.lumpy(_vcf(v, *own, *two)).select("aid", *ENDS, F.try_element_at("extra", F.lit("or_svtype")).alias("or_svtype"))


@query(
    "q_vcf_longranger",
    _in_order(
        " UNION ALL ".join(
            [
                _own("k % 3 = 0", "'call_' || k", "coord1", "+", "coord2", "-"),
                _own("k % 3 = 1", "'call_' || k", "coord1", "-", "coord2", "+"),
                _own("k % 3 = 2", "'call_' || k || '_1'", "coord1 - 1", "+", "coord2", "+"),
                _own("k % 3 = 2", "'call_' || k || '_2'", "coord1", "-", "coord2 + 1", "-"),
                _AS_IS % ("'call_' || k", ""),
            ]
        )
    ),
)
def _(v):
    own, two = _if(_SAME, _record("'call_' || k", _END)), _if(_OTHER, *_pair("'call_' || k || '_1'", "'call_' || k || '_2'"))
    return V.longranger(_vcf(v, *own, *two)).select("aid", *ENDS)


@query(
    "q_vcf_manta",
    _in_order(
        " UNION ALL ".join(
            [
                _own("k % 3 = 0", "'m' || k || 'a'", "coord1", "+", "coord2", "-"),
                _own("k % 3 = 1", "'m' || k || 'a'", "coord1", "-", "coord2", "+"),
                _own("k % 6 = 2", "'m' || k || 'a'", "coord1", "-", "coord2", "-"),
                _own("k % 6 = 5", "'m' || k || 'a'", "coord1", "+", "coord2", "+"),
                _AS_IS % ("'m' || k || 'a'", ""),
            ]
        )
    ),
)
def _(v):
    info = f"{_END} || CASE k % 6 WHEN 2 THEN ';INV3' WHEN 5 THEN ';INV5' ELSE '' END"
    own, two = _if(_SAME, _record("'m' || k || 'a'", info)), _if(_OTHER, *_pair("'m' || k || 'a'", "'m' || k || 'b'"))
    return V.manta(_vcf(v, *own, *two)).select("aid", *ENDS)


_STRANDED = "'SVTYPE=TRA;CHR2=chr' || chr2 || ';END=' || coord2 || ';STRANDS=' || strand1 || strand2"


@query("q_vcf_sniffles", "SELECT 's' || k AS aid, chr1, coord1, strand1, chr2, coord2, strand2, CASE WHEN k % 2 = 0 THEN '0/1' ELSE '1/1' END AS or_gt FROM adj")
def _(v):
    rows = _vcf(v, _record("'s' || k", _STRANDED, more=("'GT:DR'", "if(k % 2 = 0, '0|1:3', '1/1:4')")), samples="s")
    return V.sniffles(rows).select("aid", *ENDS, F.try_element_at("extra", F.lit("or_gt")).alias("or_gt"))


@query(
    "q_vcf_survivor",
    """SELECT 'u' || k AS aid, chr1, coord1, strand1, chr2, coord2, strand2, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'y' WHEN 2 THEN 'x' ELSE 'x,y' END AS supporting,
    CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'y' || k WHEN 2 THEN 'x' || k ELSE 'x' || k || ',y' || k END AS ids, CASE WHEN k % 4 >= 2 THEN sources END AS sources FROM adj""",
)
def _(v):
    one = lambda s, on: f"if({on}, '1/1:{s}' || k || ':1_1-1_2', './.:NaN:NaN')"
    info = f"{_STRANDED} || ';SUPP_VEC=' || substr('00011011', 1 + 2 * (k % 4), 2)"
    rows = _vcf(v, _record("'u' || k", info, more=("'GT:ID:CO'", one("x", "k % 4 >= 2"), one("y", "k % 2 = 1"))), samples="x\ty")
    source = v.adj.select(F.concat(F.lit("x"), F.col("k").cast("string")).alias("aid"), *ENDS, F.create_map(F.lit("src"), F.col("sources")).alias("extra"))
    of = lambda k: F.try_element_at("extra", F.lit(k))
    return V.survivor(rows, {"x": source}).select("aid", *ENDS, of("supporting_sources").alias("supporting"), of("supporting_source_ids").alias("ids"), of("src").alias("sources"))


@query("q_vcf_svaba", "SELECT k::VARCHAR AS aid, chr1, coord1, strand1, chr2, coord2, strand2 FROM adj WHERE k % 3 = 0")
def _(v):
    more = ("'GT'", "if(k % 3 = 0, '0/1', '0/0')", "if(k % 3 = 1, '0/1', '0/0')")
    return V.svaba(_vcf(v, *_pair("k || ':1'", "k || ':2'", more=more), samples="t\tn"), samples=["t"], only=True).select("aid", *ENDS)


@query("q_vcf_svaba_indels", "SELECT 'i' || k AS aid, chr1, coord1, '+' AS strand1, chr1 AS chr2, coord1 + 1 + CASE WHEN k % 2 = 0 THEN k % 40 ELSE 0 END AS coord2, '-' AS strand2, CASE WHEN k % 2 = 0 THEN 'DEL' ELSE 'INS' END AS or_svtype FROM adj")
def _(v):
    line = _record("'i' || k", "'SPAN=' || k % 40", "if(k % 2 = 0, 'A', 'ACGT')", ref="if(k % 2 = 0, 'ACGT', 'A')")
    return V.svaba(_vcf(v, line), "indel").select("aid", *ENDS, F.try_element_at("extra", F.lit("or_svtype")).alias("or_svtype"))


@query("q_vcf_grocsvs", "SELECT 'e' || k AS aid, chr1, coord1, strand1, chr2, coord2, strand2 FROM adj WHERE k % 2 = 0")
def _(v):
    two = _pair("k || 'a'", "k || 'b'", "';EVENT=e' || k", ("'GT'", "if(k % 2 = 0, '1', '0')"))
    return V.grocsvs(_vcf(v, *two, samples="s"), samples=["s"]).select("aid", *ENDS)


@query("q_vcf_delly", "SELECT 'd' || k AS aid, chr1, coord1, strand1, chr2, coord2, strand2 FROM adj")
def _(v):
    type_ = "CASE WHEN chr1 <> chr2 THEN 'BND' WHEN strand1 = strand2 THEN 'INV' WHEN strand1 = '+' THEN 'DEL' ELSE 'DUP' END"
    ct = "if(strand1 = '+', '3', '5') || 'to' || if(strand2 = '+', '3', '5')"
    return V.delly(_vcf(v, _record("'d' || k", f"'SVTYPE=' || {type_} || ';CHR2=' || chr2 || ';END=' || coord2 || ';CT=' || {ct}"))).select("aid", *ENDS)


@query(
    "q_vcf_pbsv",
    _in_order(
        " UNION ALL ".join(
            [
                _own("k % 3 = 0", "'p' || k", "coord1", "+", "coord2", "-", ", 2 + k % 9 AS n"),
                _own("k % 3 = 1", "'p' || k", "coord1", "-", "coord2", "+", ", 2 + k % 9"),
                _own("k % 3 = 2", "'p' || k || '_1'", "coord1 - 1", "+", "coord2", "+", ", 2 + k % 9"),
                _own("k % 3 = 2", "'p' || k || '_2'", "coord1", "-", "coord2 + 1", "-", ", 2 + k % 9"),
                _AS_IS % ("'p' || k", ", 2 + k % 9"),
            ]
        ),
        ", n::VARCHAR AS re",
    ),
)
def _(v):
    more = ("'GT:AD:DP'", "'0/1:4,' || (2 + k % 9) || ':20'")
    own, two = _if(_SAME, _record("'p' || k", _END, more=more), _record("'odd' || k", "'SVTYPE=CNV;END=9'", more=more)), _if(_OTHER, *_pair("'p' || k", "'q' || k", more=more))
    return V.pbsv(_vcf(v, *own, *two, samples="s")).select("aid", *ENDS, F.try_element_at("extra", F.lit("re")).alias("re"))


# --- callers that write tables

_PLACED = "row_number() OVER (ORDER BY k) - 1"


@query("q_read_naibr", f"SELECT ({_PLACED})::VARCHAR AS aid, chr1, coord1, strand1, chr2, coord2, strand2 FROM adj")
def _(v):
    path = _texts(v, ["Chr1\tBreak1\tChr2\tBreak2\tOrientation"], v.adj, _tabs("'chr' || chr1", "coord1", "chr2", "coord2", "strand1 || strand2"), files=files_for_lines(v), named=True)
    return TB.naibr(v.spark, path).select("aid", *ENDS)


@query("q_read_gundem", f"SELECT * EXCLUDE (k) FROM (SELECT ({_PLACED})::VARCHAR AS aid, chr1, coord1, strand1, chr2, coord2, strand2, 'P-a:' || k % 3 || ',P-b:' || k % 4 AS support, k FROM adj) WHERE k % 4 >= 2")
def _(v):
    line = _tabs("'P'", "'a/b'", "k % 3 || '/' || k % 4", "chr1", "coord1", "strand1", "chr2", "coord2", "if(strand2 = '+', '-', '+')")
    path = _texts(v, ["patient\tsamples\ttumour-counts\tchr1\tpos1\tstr1\tchr2\tpos2\tstr2"], v.adj, line, files=files_for_lines(v), named=True)
    return TB.gundem2015(v.spark, path, ["P-b"], least=2).select("aid", *ENDS, F.try_element_at("extra", F.lit("per_sample_support")).alias("support"))


@query(
    "q_read_remixt_adjacencies",
    _in_order("SELECT k::VARCHAR AS aid, chr1, coord1 - CASE WHEN strand1 = '+' THEN 1 ELSE 0 END AS coord1, strand1, chr2, coord2 - CASE WHEN strand2 = '+' THEN 1 ELSE 0 END AS coord2, strand2, k FROM adj WHERE k % 3 + k % 2 > 0", ", '{''1'':{''AA'':' || k % 3 || '},''2'':{''AA'':' || k % 2 || '}}' AS cn"),
)
def _(v):
    names = [f"{x}_{n}" for n in (1, 2) for x in ("chromosome", "position", "strand")]
    path = _texts(v, ["\t".join(["prediction_id", *names, "cn_1", "cn_2"])], v.adj, _tabs("k", *ENDS, "k % 3", "k % 2"), files=files_for_lines(v), named=True)
    return TB.remixt(v.spark, path, skip_absent=True).select("aid", *ENDS, F.try_element_at("extra", F.lit("cn")).alias("cn"))


@query("q_read_breakdancer", f"SELECT ({_PLACED} + 1)::VARCHAR AS aid, chr1, coord1, strand1, chr2, coord2, strand2, CASE WHEN chr1 <> chr2 THEN '-1' ELSE '300' END AS svlen, (k % 50)::VARCHAR AS num_reads FROM adj")
def _(v):
    votes = lambda n: f"if(strand{n} = '+', '9+2-', '1+4-')"
    line = _tabs("chr1", "coord1", votes(1), "chr2", "coord2", votes(2), "if(chr1 <> chr2, 'CTX', 'DEL')", "300", "'99.0'", "k % 50", "'lib|1'")
    of = lambda k: F.try_element_at("extra", F.lit(k)).alias(k)
    return TB.breakdancer(v.spark, _texts(v, ["# head"], v.adj, line, files=files_for_lines(v))).select("aid", *ENDS, of("svlen"), of("num_reads"))


# --- copy numbers

_WIDE = """WITH w AS (SELECT sid, max(cn) FILTER (clone = 'c1' AND hap = 'A') AS a1, max(cn) FILTER (clone = 'c1' AND hap = 'B') AS b1,
    max(cn) FILTER (clone = 'c2' AND hap = 'A') AS a2, max(cn) FILTER (clone = 'c2' AND hap = 'B') AS b2 FROM scnt GROUP BY sid), r AS (SELECT * FROM seg JOIN w USING (sid)) """


def _wide(v) -> DataFrame:
    of = lambda c, h: F.max(F.when((F.col("clone") == c) & (F.col("hap") == h), F.col("cn")))
    wide = v.scnt.groupBy("sid").agg(of("c1", "A").alias("a1"), of("c1", "B").alias("b1"), of("c2", "A").alias("a2"), of("c2", "B").alias("b2"))
    return v.seg.join(wide, "sid").withColumn("k", F.col("c") * 1000 + F.col("i"))


def _four(*values: str) -> str:
    return " UNION ALL ".join(f"SELECT sid, '{c}' AS clone, '{h}' AS hap, {x} AS cn FROM r" for (c, h), x in zip((("1", "A"), ("1", "B"), ("2", "A"), ("2", "B")), values))


@query("q_cn_battenberg", _WIDE + _four("a1", "b1", "CASE WHEN i % 5 = 0 THEN a1 ELSE a2 END", "CASE WHEN i % 5 = 0 THEN b1 WHEN i % 5 = 1 THEN 0 ELSE b2 END"))
def _(v):
    head = "sample\tchr\tstartpos\tendpos\tnMaj1_A\tnMin1_A\tnMaj2_A\tnMin2_A"
    line = lambda s: _tabs(f"'{s}'", "'chr' || chr", "start", "`end`", "a1", "b1", "if(i % 5 = 0, 'NA', string(a2))", "CASE i % 5 WHEN 0 THEN 'NA' WHEN 1 THEN '-1' ELSE string(b2) END")
    return CN.battenberg(v.spark, _texts(v, [head], _wide(v), line("s"), line("t")), "t")[1]


@query("q_cn_hatchet", _WIDE + _four("a1", "b1", "a2", "b2"))
def _(v):
    line = _tabs("chr", "start", "`end` + 1", "'s'", "'x'", "'y'", "a1 || '|' || b1", "0.6", "a2 || '|' || b2", "0.4", "'9|9'", "0.001")
    segs, scnt = CN.hatchet(v.spark, _texts(v, ["#chr\tstart\tend\tsample\tx\ty\tcn_normal\tu_normal\tcn_1\tu_1\tcn_2\tu_2"], _wide(v), line), "s")
    return scnt.join(segs.select("sid"), "sid")


@query("q_cn_remixt", _WIDE + _four("a1", "b1", "a2", "b2"))
def _(v):
    head = "chromosome\tstart\tend\tmajor_1\tminor_1\tmajor_2\tminor_2"
    return CN.remixt(v.spark, _texts(v, [head], _wide(v), _tabs("chr", "start", "`end` + 1", "a1", "b1", "a2", "b2")))[1]


@query(
    "q_cn_titan",
    _WIDE + _four(*(f"CASE WHEN 1 + i % 2 = {c} THEN {x} ELSE 1 END" for c in (1, 2) for x in ("greatest(a1, b1) + ((i % 4 + 1) // 2)", "least(a1, b1) + i % 4 - ((i % 4 + 1) // 2)"))),
)
def _(v):
    head = "Sample\tChromosome\tStart\tEnd\tMajorCN\tMinorCN\tClonal_Cluster\tCorrected_Copy_Number"
    return CN.titan(v.spark, _texts(v, [head], _wide(v), _tabs("'s'", "chr", "start", "`end`", "a1", "b1", "1 + i % 2", "a1 + b1 + i % 4")), "s", fix="equal")[1]


@query("q_cn_ginkgo", _WIDE + "SELECT sid, 'c' AS clone, 'A' AS hap, a2 AS cn FROM r")
def _(v):
    return CN.ginkgo(v.spark, _texts(v, ["CHR\tSTART\tEND\ts.1\ts.2"], _wide(v), _tabs("'chr' || chr", "start", "`end`", "a1", "a2")), "s.2", "c")[1]


@query("q_cn_gff", """SELECT CASE WHEN chr = '1' THEN '7' ELSE chr END AS chr, start, "end", 'g' || i AS id, CASE WHEN i % 2 = 0 THEN 'a b' END AS name FROM seg WHERE c <= 2""")
def _(v):
    line = _tabs("'chr' || chr", "'.'", "'gene'", "start", "`end`", "'.'", "'+'", "'.'", "if(i % 2 = 0, 'ID \"g' || i || '\"; Name \"a b\";', 'ID=g' || i)")
    of = lambda k: F.try_element_at("extra", F.lit(k))
    return CN.gff(v.spark, _texts(v, ["# genes"], _wide(v), line), {"chr1": "chr7", "chr2": "chr2"}, "skip").select("chr", "start", "end", of("ID").alias("id"), of("Name").alias("name"))


# --- writers


@query("q_write_bedpe", "SELECT chr1, coord1 AS start1, coord1 + 1 AS end1, chr2, coord2 AS start2, coord2 + 1 AS end2, aid AS name, 'NA' AS score, strand1, strand2 FROM adj WHERE chr1 = chr2")
def _(v):
    return S.bedpe_rows(v.adj, inter=False)


@query("q_write_circa_adjacencies", "SELECT chr1, coord1, chr2, coord2, strand1, strand2, CASE WHEN chr1 = chr2 THEN coord2 - coord1 ELSE -1 END AS size, CASE WHEN chr1 = chr2 THEN coord1 + (coord2 - coord1) // 2 ELSE -1 END AS mid FROM adj")
def _(v):
    return S.circa_adjacency_rows(v.adj)


@query("q_write_circa_segments", """SELECT chr, start, "end", start + ("end" - start) // 2 AS mid, 'n' || i AS note FROM seg""")
def _(v):
    return S.circa_segment_rows(v.seg.withColumn("extra", F.create_map(F.lit("note"), F.concat(F.lit("n"), F.col("i").cast("string")))), "note")


@query("q_write_circa_density", """SELECT chr, win * 10000000 + 1 AS start, (win + 1) * 10000000 AS "end", count(*) AS value FROM (SELECT chr, coord // 10000000 AS win FROM breakend) GROUP BY chr, win""")
def _(v):
    rows = v.breakend.groupBy("chr", F.floor(F.col("coord") / 10_000_000).cast("long").alias("win")).agg(F.count("*").alias("n"))
    return S.circa_density_rows(rows, 10_000_000)


@query("q_write_shatterseek", """SELECT chr AS chromosome, start, "end", sum(cn)::BIGINT AS total_cn FROM seg JOIN scnt USING (sid) WHERE clone = 'c2' GROUP BY ALL""")
def _(v):
    return S.shatterseek_rows(v.seg, v.scnt, "c2")


@query("q_write_edges", """SELECT chr || ':-' || start AS u, chr || ':+' || "end" AS v, i AS cn, 'S' AS kind FROM seg UNION ALL SELECT chr1 || ':' || strand1 || coord1, chr2 || ':' || strand2 || coord2, k, 'A' FROM adj""")
def _(v):
    segs = v.seg.selectExpr("chr || ':-' || start AS u", "chr || ':+' || `end` AS v", "bigint(i) AS cn", "'S' AS kind")
    return S.edge_rows(segs.unionByName(v.adj.selectExpr("chr1 || ':' || strand1 || coord1 AS u", "chr2 || ':' || strand2 || coord2 AS v", "k AS cn", "'N' AS kind")))


@query("q_write_signatures", "SELECT count(*) AS k, string_agg(aid, ',' ORDER BY pos) AS aids, 's' || gid AS signature FROM member GROUP BY gid")
def _(v):
    return S.signature_rows(v.groups().select(F.size("aids").alias("k"), "aids", F.concat(F.lit("s"), "gid").alias("signature")))


@query(
    "q_write_vcf",
    """SELECT chr1 || chr(9) || coord1 || chr(9) || aid || chr(9) || 'N' || chr(9) || '<BND>' || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'CHR2=' || chr2 || ';END=' || coord2 || ';STRANDS=' || strand1 || strand2
    || ';SOURCES=' || sources || chr(9) || 'GT:CN_c1:CN_c2' || chr(9) || CASE WHEN n1 + n2 = 0 THEN '0/0' ELSE './.' END || ':' || n1 || ':' || n2 AS line
    FROM adj JOIN (SELECT aid, sum(cn) FILTER (clone = 'c1') AS n1, sum(cn) FILTER (clone = 'c2') AS n2 FROM acnt GROUP BY aid) USING (aid)""",
)
def _(v):
    rows = v.adj.withColumn("extra", F.create_map(F.lit("sources"), F.col("sources")))
    return S.vcf_lines(rows, v.acnt, date="20200101").where(~F.col("value").startswith("#")).withColumnRenamed("value", "line")
