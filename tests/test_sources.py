import pytest
from pyspark.sql import functions as F

from lociflow.functions.extras import parse_extra
from lociflow.sources import canonical as C
from lociflow.sources import copy_number as CN
from lociflow.sources import sinks, tabular, vcf


def write(tmp_path, name, *lines):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n")
    return str(p)


HEAD = ("##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")


def call(spark, tmp_path, caller, *recs, samples=(), **options):
    head = HEAD[1] + ("\tFORMAT\t" + "\t".join(samples) if samples else "")
    path = write(tmp_path, f"{caller}.vcf", HEAD[0], head, *("\t".join(map(str, r)) for r in recs))
    out = vcf.read(spark, path, caller, **options).collect()
    return {r["aid"]: r for r in out}


def ends(r):
    return (r["chr1"], r["coord1"], r["strand1"], r["chr2"], r["coord2"], r["strand2"])


def test_extra_texts(spark):
    df = spark.createDataFrame([("a=1;flag;b=x",), ("a=1;a=2",), (None,)], "e string")
    assert [r[0] for r in df.select(parse_extra("e")).collect()] == [{"a": "1", "flag": "true", "b": "x"}, {"a": "2"}, {}]
    with pytest.raises(Exception, match="malformed"):
        df.select(parse_extra("e", strict=True)).collect()
    with pytest.raises(Exception, match="malformed"):
        spark.createDataFrame([("a=1=2",)], "e string").select(parse_extra("e")).collect()


def test_segments_round_trip(spark, tmp_path):
    path = write(tmp_path, "s.tsv", "chr\tstart\tend\textra", "1\t10\t20\tcn={'c1':{'A':1,'B':2},'c2':{'A':0,'B':2}};note=x", "1\t21\t30\tcn={'c1':{'A':3,'B':2},'c2':{'A':3,'B':2}}")
    s = C.segments(spark, path)
    t = C.scnt(s)
    assert t.count() == 8 and C.scnt(s, ["c1"]).count() == 4
    with pytest.raises(ValueError):
        C.scnt(s, ["c9"])
    out = tmp_path / "out"
    sinks.write_table(sinks.segment_rows(s, t), str(out), single=True)
    again = C.segments(spark, str(out))
    assert sorted(map(tuple, C.scnt(again).collect())) == sorted(map(tuple, t.collect()))
    assert again.where("sid = '1:10-20'").first()["extra"]["note"] == "x"


def test_legacy_columns(spark, tmp_path):
    path = write(tmp_path, "s.tsv", "chr\tstart\tend\tCNs", "1\t1\t100\t(c1,1,2);(c2,3,2)")
    assert sorted(map(tuple, C.scnt(C.segments(spark, path)).collect())) == [("1:1-100", "c1", "A", 1), ("1:1-100", "c1", "B", 2), ("1:1-100", "c2", "A", 3), ("1:1-100", "c2", "B", 2)]
    b = write(tmp_path, "b.tsv", "chr\tstart\tend\tb", "# no", "1\t1\t100\t(c1,0-3,1-4)")
    assert ("1:1-100", "c1", "B", "u", 4) in [tuple(r) for r in C.legacy_scnb(spark, b).collect()]


def test_adjacencies_and_bounds(spark, tmp_path):
    path = write(tmp_path, "a.tsv", "aid\tchr1\tcoord1\tstrand1\tchr2\tcoord2\tstrand2\textra", "id1\t1\t123760\t-\t1\t123450\t+\tcn={'c1':{'AA':1,'AB':0,'BA':0,'BB':0}}", "r5\t1\t5\t+\t1\t6\t-\tcn={'c1':{'AA':1}}")
    a = C.adjacencies(spark, path)
    assert [(r["aid"], r["coord1"], r["at"]) for r in a.orderBy("aid").collect()] == [("id1", 123450, "N"), ("r5", 5, "R")]
    assert C.acnt(a).count() == 5
    out = tmp_path / "out"
    sinks.write_table(sinks.adjacency_rows(a, C.acnt(a).select("aid", "clone", "phasing", "cn"), mixed=False), str(out), single=True)
    again = C.adjacencies(spark, str(out))
    assert [r["aid"] for r in again.orderBy("ord").collect()] == ["id1", "r5"] and C.acnt(again).count() == 5
    s = C.segments(spark, write(tmp_path, "n.tsv", "chr\tstart\tend\textra", "1\t1\t9\tcnb={'c1':{'A':{'l':0,'u':10}}}"))
    nested = sinks.nested_scnb(C.scnb(s)).first()["cnb"]
    assert nested == "{'c1':{'A':{'l':0,'u':10}}}"


def test_groups_positions_regions(spark, tmp_path):
    g = C.groups(spark, write(tmp_path, "g.tsv", "gid\taids\textra", "g1\ta1,a2\tagt=M;fp=0.1", "g2\ta1,a1\tagt=L;agl=0,1", "g3\ta1\t"))
    assert [(r["agt"], r["fp"], r["agl"]) for r in g.orderBy("gid").collect()] == [("M", 0.1, None), ("L", None, [0, 1]), ("M", None, None)]
    assert sinks.group_rows(g).first()["extra"] == "agt=M;fp=0.1"
    r = C.region_list(spark, ["chr1", "1:10-20", "2\t5\t9\tx"])
    assert [tuple(x)[1:] for x in r.collect()] == [("chr1", 0, 3_000_000_000), ("1", 10, 20), ("2", 5, 9)]
    assert C.main_chromosomes(spark).count() == 24
    sizes = C.chr_sizes(spark, write(tmp_path, "z.txt", "# c", "1 249250621"))
    assert tuple(sizes.first()) == ("1", 249250621)


def test_lumpy(spark, tmp_path):
    out = call(
        spark, tmp_path, "lumpy",
        ("chr1", 100, "1", "N", "<DEL>", ".", ".", "SVTYPE=DEL;END=200"),
        ("chr1", 100, "2", "N", "<DUP>", ".", ".", "SVTYPE=DUP;END=200"),
        ("chr1", 100, "3", "N", "<INV>", ".", ".", "SVTYPE=INV;END=200"),
        ("1", 500, "4_1", "N", "N[2:900[", ".", ".", "SVTYPE=BND;MATEID=4_2"),
        ("2", 900, "4_2", "N", "]1:500]N", ".", ".", "SVTYPE=BND;MATEID=4_1"),
    )
    assert ends(out["1"]) == ("1", 99, "+", "1", 201, "-") and ends(out["2"]) == ("1", 100, "-", "1", 200, "+")
    assert ends(out["3_1"]) == ("1", 99, "+", "1", 200, "+") and ends(out["3_2"]) == ("1", 100, "-", "1", 201, "-")
    assert ends(out["4"]) == ("1", 500, "+", "2", 900, "-") and len(out) == 5
    assert out["4"]["extra"]["svtype"] == "TRA" and out["4"]["extra"]["or_svtype"] == "BND" and "end" not in out["1"]["extra"]


def test_delly_manta_longranger(spark, tmp_path):
    rec = lambda i, t, ct: ("1", 10, i, "N", f"<{t}>", ".", "PASS", f"SVTYPE={t};CHR2=1;END=90;CT={ct}")
    out = call(spark, tmp_path, "delly", rec("a", "DEL", "3to5"), rec("b", "DUP", "5to3"), rec("c", "INV", "3to3"), rec("d", "INV", "5to5"))
    assert [out[k]["strand1"] + out[k]["strand2"] for k in "abcd"] == ["+-", "-+", "++", "--"]
    with pytest.raises(ValueError):
        call(spark, tmp_path, "delly", rec("a", "DEL", "5to3"))
    out = call(spark, tmp_path, "manta", ("1", 10, "i", "N", "<INV>", ".", ".", "SVTYPE=INV;END=90;INV3"), ("1", 5, "x", "N", "N[2:7[", ".", ".", "SVTYPE=BND;MATEID=gone"))
    assert [*out] == ["i"] and out["i"]["strand1"] == out["i"]["strand2"] == "-"
    out = call(spark, tmp_path, "longranger", ("1", 10, "call_1", "N", "<DEL>", ".", ".", "SVTYPE=DEL;END=90"), ("1", 10, "call_2", "N", "<UNK>", ".", ".", "SVTYPE=UNK;END=90"))
    assert ends(out["call:1".replace(":", "_")]) == ("1", 10, "+", "1", 90, "-") and len(out) == 1


def test_sniffles_and_the_last_of_repeated_ids(spark, tmp_path):
    out = call(
        spark, tmp_path, "sniffles",
        ("1", 10, "a", "N", "<INS>", ".", "PASS", "SVTYPE=INS;CHR2=1;END=10;STRANDS=+-;SVLEN=50", "GT", "0/1"),
        ("1", 10, "b", "ACGT", "A", ".", "PASS", "SVTYPE=DEL", "GT", "1/1"),
        ("1", 10, "c", "N", "N]2:77]", ".", "PASS", "SVTYPE=BND;STRANDS=++", "GT", "./."),
        ("1", 11, "c", "N", "N]2:78]", ".", "PASS", "SVTYPE=BND;STRANDS=++", "GT", "./."),
        samples=("s",),
    )
    assert out["a"]["coord2"] == 11 and out["a"]["extra"]["or_gt"] == "0/1" and out["a"]["extra"]["svtype"] == "INS"
    assert out["b"]["coord2"] == 14 and ends(out["c"]) == ("1", 11, "+", "2", 78, "+")


def test_pbsv_svaba_grocsvs(spark, tmp_path):
    out = call(spark, tmp_path, "pbsv", ("1", 10, "x.INS.DUP", "N", "<DUP>", ".", ".", "SVTYPE=DUP;END=30;SVLEN=20", "GT:AD:DP", "0/1:4,6:10"), ("1", 5, "q", "N", "<CNV>", ".", ".", "SVTYPE=CNV;END=9", "GT:AD:DP", "0/1:4,6:10"), samples=("s",))
    assert ends(out["x.INS.DUP"]) == ("1", 30, "+", "1", 31, "-") and out["x.INS.DUP"]["extra"]["re"] == "6"
    recs = [("1", 10, "7:1", "N", "N[2:50[", ".", ".", "SVTYPE=BND;MATEID=7:2", "GT", "0/1", "0/0"), ("2", 50, "7:2", "N", "]1:10]N", ".", ".", "SVTYPE=BND;MATEID=7:1", "GT", "0/1", "0/0")]
    assert ends(call(spark, tmp_path, "svaba", *recs, samples=("t", "n"), kind="sv")["7"]) == ("1", 10, "+", "2", 50, "-")
    path = write(tmp_path, "w.vcf", HEAD[0], HEAD[1] + "\tFORMAT\tt\tn", *("\t".join(map(str, r)) for r in recs))
    assert vcf.svaba(vcf.records(spark, path), samples=["n"]).count() == 0
    assert vcf.svaba(vcf.records(spark, path), samples=["t"], only=True).count() == 1
    indel = call(spark, tmp_path, "svaba", ("1", 10, "9", "ACGT", "A", ".", ".", "SPAN=3", "GT", "0/1"), samples=("t",), kind="indel")
    assert ends(indel["9"]) == ("1", 10, "+", "1", 14, "-") and indel["9"]["extra"]["svtype"] == "DEL"
    g = [("1", 10, "a", "N", "N[2:50[", ".", ".", "SVTYPE=BND;MATEID=b;EVENT=e1", "GT", "1"), ("2", 50, "b", "N", "]1:10]N", ".", ".", "SVTYPE=BND;MATEID=a;EVENT=e1", "GT", "1")]
    assert [*call(spark, tmp_path, "grocsvs", *g, samples=("s",))] == ["e1"]


def test_survivor(spark, tmp_path):
    src = C.adjacencies(spark, write(tmp_path, "a.tsv", "aid\tchr1\tcoord1\tstrand1\tchr2\tcoord2\tstrand2\textra", "d1\t1\t10\t+\t1\t90\t-\tqual=5"))
    rec = ("1", 10, "m", "N", "<DEL>", ".", ".", "SVTYPE=DEL;CHR2=1;END=90;STRANDS=+-;SUPP_VEC=10", "GT:ID:CO", "1/1:d1:1_10-1_90", "./.:NaN:NaN")
    out = call(spark, tmp_path, "survivor", rec, samples=("s1", "s2"), sources={"s1": src})["m"]
    assert out["extra"]["supporting_sources"] == "s1" and out["extra"]["sources"] == "s1,s2" and out["extra"]["qual"] == "5" and out["extra"]["supporting_source_ids"] == "d1"


def test_tables_of_callers(spark, tmp_path):
    n = tabular.naibr(spark, write(tmp_path, "n.tsv", "Chr1\tBreak1\tChr2\tBreak2\tOrientation", "chr1\t5\tchr2\t9\t+-")).first()
    assert n["aid"] == "0" and ends(n) == ("1", 5, "+", "2", 9, "-")
    m = tabular.remixt(spark, write(tmp_path, "r.tsv", "prediction_id\tchromosome_1\tposition_1\tstrand_1\tchromosome_2\tposition_2\tstrand_2\tcn_1\tcn_2", "7\t1\t500\t+\t2\t9\t-\t1\t3")).first()
    assert m["coord1"] == 499 and m["extra"]["cn"] == "{'1':{'AA':1},'2':{'AA':3}}"
    for text, want in (("10+3-", "+"), ("5+5-", "+"), ("2+9-", "-")):
        assert spark.createDataFrame([(text,)], "s string").select(tabular.majority_strand("s")).first()[0] == want
    b = tabular.breakdancer(spark, write(tmp_path, "b.txt", "# head", "1\t10\t9+1-\t2\t20\t1+9-\tCTX\t300\t99.0\t12\tlib|12")).first()
    assert b["extra"]["svlen"] == "-1" and b["strand2"] == "-"
    g = write(tmp_path, "g.tsv", "patient\tsamples\ttumour-counts\tchr1\tpos1\tstr1\tchr2\tpos2\tstr2", "P\ta/b\t0/4\t1\t10\t+\t2\t20\t+")
    assert tabular.gundem2015(spark, g).first()["strand2"] == "-" and tabular.gundem2015(spark, g, ["P-a"]).count() == 0 and tabular.gundem2015(spark, g, ["P-b"]).count() == 1


def numbers(t):
    return {(r["clone"], r["hap"]): r["cn"] for r in t.collect()}


def test_copy_number_callers(spark, tmp_path):
    b = write(tmp_path, "b.tsv", "sample\tchr\tstartpos\tendpos\tnMaj1_A\tnMin1_A\tnMaj2_A\tnMin2_A", "s\tchr1\t1\t9\t2\t-1\tNA\t1", "o\t1\t1\t9\t5\t5\t5\t5")
    assert numbers(CN.battenberg(spark, b, "s")[1]) == {("1", "A"): 2, ("1", "B"): 0, ("2", "A"): 2, ("2", "B"): 1}
    h = write(tmp_path, "h.tsv", "#chr\tstart\tend\tsample\tx\ty\tcn_normal\tu_normal\tcn_1\tu_1", "1\t1\t10\ts\t0\t0\t1|1\t0.5\t2|0\t0.001")
    assert CN.hatchet_clones(spark, h, "s") == ["1"]
    assert numbers(CN.hatchet(spark, h, "s", ["2"])[1]) == {("2", "A"): 2, ("2", "B"): 0}
    assert CN.hatchet(spark, h, "s")[0].first()["end"] == 9
    r = write(tmp_path, "r.tsv", "chromosome\tstart\tend\tmajor_1\tminor_1\tmajor_2\tminor_2", "1\t1\t10\t2\t1\t3\t0")
    assert numbers(CN.remixt(spark, r)[1])[("2", "B")] == 0
    t = write(tmp_path, "t.tsv", "Sample\tChromosome\tStart\tEnd\tMajorCN\tMinorCN\tClonal_Cluster\tCorrected_Copy_Number", "s\t1\t1\t9\t1\t2\t1\t5", "s\t1\t10\t19\t1\t1\t2\t2")
    one = lambda how: {k: v for k, v in numbers(CN.titan(spark, t, "s", ["1"], how)[1].where("sid = '1:1-9'")).items()}
    assert one("equal") == {("1", "A"): 3, ("1", "B"): 2} and one("relative-dist") == {("1", "A"): 4, ("1", "B"): 1} and one("None") == {("1", "A"): 2, ("1", "B"): 1}
    k = write(tmp_path, "k.tsv", "CHR\tSTART\tEND\ts.1", "chr1\t1\t9\t4")
    assert numbers(CN.ginkgo(spark, k, "s.1")[1]) == {("1", "A"): 4}
    with pytest.raises(ValueError):
        CN.ginkgo(spark, k, "S.1")
    f = write(tmp_path, "f.gff", "chr1\t.\tgene\t5\t9\t.\t+\t.\tID=g1;Name=x", "q\t.\tgene\t5\t9\t.\t+\t.\tID=g2")
    assert CN.gff(spark, f, {"chr1": "chr7"}, "skip").select("chr", F.col("extra")["ID"]).first() == ("7", "g1")


def test_sam(spark, tmp_path):
    p = write(tmp_path, "a.sam", "@HD\tVN:1.6", "r1\t0\t1\t100\t60\t10S50M5D10M\t*\t0\t0\t*\t*", "r2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*", "r3\t16\t1\t5\t60\t10M\t*\t0\t0\t*\t*")
    assert [(r["read"], r["end"], r["strand"]) for r in C.sam(spark, p).collect()] == [("r1", 164, "+"), ("r3", 14, "-")]
    names = spark.createDataFrame([("r3",)], "read string")
    assert [r[0].split("\t")[0] for r in C.filter_alignments(spark, p, names).collect()] == ["@HD", "r3"]


def test_vcf_lines_and_other_sinks(spark, tmp_path):
    a = C.adjacencies(spark, write(tmp_path, "a.tsv", "aid\tchr1\tcoord1\tstrand1\tchr2\tcoord2\tstrand2\textra", "x\t1\t10\t+\t1\t90\t-\tsvtype=DEL;cn={'c1':{'AA':1},'c2':{'AA':0}};support=a,b", "y\t1\t20\t+\t2\t5\t-\tcn={'c1':{'AA':0},'c2':{'AA':0}}"))
    lines = [r[0] for r in sinks.vcf_lines(a, C.acnt(a).select("aid", "clone", "phasing", "cn"), date="20200101").collect()]
    assert lines[0] == "##fileformat=VCFv4.2" and lines[1] == "##fileDate=20200101" and '##INFO=<ID=SUPPORT,Number=.,Type=String,Description="SUPPORT">' in lines
    assert lines[-2].split("\t") == ["1", "10", "x", "N", "<DEL>", ".", "PASS", "CHR2=1;END=90;STRANDS=+-;SUPPORT=a,b;SVTYPE=DEL", "GT:CN_c1:CN_c2", "./.:1:0"]
    assert lines[-1].endswith("0/0:0:0")
    assert tuple(sinks.bedpe_rows(a, inter=False).first())[:3] == ("1", 10, 11) and sinks.bedpe_rows(a).count() == 2
    mids = {r["coord1"]: (r["size"], r["mid"]) for r in sinks.circa_adjacency_rows(a).collect()}
    assert mids == {10: (80, 50), 20: (-1, -1)}
    path = tmp_path / "v"
    sinks.write_lines(sinks.vcf_lines(a, date="20200101"), str(path))
    assert vcf.records(spark, str(path)).count() == 2


def test_unknown_formats_are_errors(spark):
    from lociflow.sources import convert

    with pytest.raises(ValueError, match="unknown format"):
        convert.adjacencies_from(spark, "none", "other")
    with pytest.raises(ValueError, match="unknown format"):
        convert.copy_numbers_from(spark, "none", "other")
    assert len(convert.FORMATS) == 13


def test_lines_that_grow_with_orders_are_written_in_several_files_in_order(spark):
    import glob

    import lociflow.plans.queries  # noqa: F401  (first: it registers the others)
    from lociflow.plans import io_queries as IO
    from lociflow.plans.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    text = lambda path: [open(x).read().splitlines() for x in sorted(glob.glob(path.removeprefix("file://") + "/part-*"))]
    keys = [r["k"] for r in v.adj.select("k").orderBy("k").collect()]
    parts = text(IO._texts(v, ["# a", "# b"], v.adj, "'x' || k", "'y' || k", files=IO.files_for_lines(v)))
    assert sum(parts, []) == ["# a", "# b"] + [f"{x}{k}" for k in keys for x in "xy"]
    assert len(parts) >= 4 and max(map(len, parts)) < len(keys)
    parts = text(IO._texts(v, ["a\tb.c"], v.adj, "k || '\\t' || k", files=4, named=True))
    assert all(p[0] == "a\tb.c" for p in parts) and [x for p in parts for x in p[1:]] == [f"{k}\t{k}" for k in keys]


def test_places_run_on_from_file_to_file_however_large_each_is(spark, tmp_path):
    from lociflow.sources import tabular as TB

    sizes, n = [1, 40, 3, 900, 2], 0
    for f, size in enumerate(sizes):
        rows = [f"1\t{n + k}\t2\t5\t+-" for k in range(size)]
        (tmp_path / f"part-{f}").write_text("\n".join(["Chr1\tBreak1\tChr2\tBreak2\tOrientation", *rows]) + "\n")
        n += size
    found = TB.naibr(spark, str(tmp_path)).select("aid", "coord1").collect()
    assert len(found) == n and all(int(r["aid"]) == r["coord1"] for r in found)
