"""Hand-computed cases, one or more for each family of operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lociflow.functions import model as M
from lociflow.operators import adjacency as A
from lociflow.operators import filters as FL
from lociflow.operators import graph as G
from lociflow.operators import groups as GR
from lociflow.operators import intervals as I
from lociflow.operators import reports as R
from lociflow.operators import tensor as T
from lociflow.operators.components import connected_components

SEG = "sid string, chr string, start long, end long"
CN = "sid string, clone string, hap string, cn int"
ADJ = "aid string, chr1 string, coord1 long, strand1 string, chr2 string, coord2 long, strand2 string"
POS = "chr string, coord long, strand string"


def rows(df, *order):
    out = [tuple(r) for r in (df.select(*order) if order else df).collect()]
    return sorted(out, key=repr)


def segs(spark, *spans, chr_="1"):
    return spark.createDataFrame([(f"{chr_}:{a}-{b}", chr_, a, b) for a, b in spans], SEG)


def cns(spark, data):
    return spark.createDataFrame([(s, c, h, n) for s, c, a, b in data for h, n in (("A", a), ("B", b))], CN)


def test_positions_are_ordered_by_chromosome_coordinate_strand(spark):
    given = [("10", 1, "-"), ("5", 9, "+"), ("1", 2, "+"), ("1", 1, "+"), ("1", 1, "-")]
    out = spark.createDataFrame(given, POS).orderBy(*M.model_order())
    assert [tuple(r) for r in out.collect()] == [("1", 1, "-"), ("1", 1, "+"), ("1", 2, "+"), ("5", 9, "+"), ("10", 1, "-")]


def test_adjacency_ends_are_put_in_order_and_named(spark):
    df = A.stable_ids(A.canonical(spark.createDataFrame([("a", "1", 2, "+", "1", 1, "-")], ADJ)))
    assert rows(df, "coord1", "strand1", "stable_id") == [(1, "-", "[1:-1]-[1:+2]N")]


def test_lengths_and_distances(spark):
    df = segs(spark, (1, 100)).select(M.segment_length().alias("a"), M.scaled_length(10).alias("b"))
    assert rows(df) == [(100, 10)]
    d = spark.createDataFrame([("a", "1", 5, "+", "1", 2, "-"), ("b", "1", 5, "+", "2", 2, "-")], ADJ).select("aid", M.distance())
    assert rows(d) == [("a", 3), ("b", -1)]


@pytest.mark.parametrize(
    "ends, own, svlen, want",
    [
        (("1", "+", "2", "-"), "DEL", None, "TRA"),
        (("1", "-", "1", "+"), "DEL", None, "DUP"),
        (("1", "+", "1", "+"), "DEL", None, "INV"),
        (("1", "+", "1", "-"), "INS", None, "INS"),
        (("1", "+", "1", "-"), None, "5", "INS"),
        (("1", "+", "1", "-"), None, None, "DEL"),
    ],
)
def test_standard_types(spark, ends, own, svlen, want):
    df = spark.createDataFrame([(*ends, own, svlen)], "chr1 string, strand1 string, chr2 string, strand2 string, t string, n string")
    assert df.select(A.standard_type("t", "n")).first()[0] == want


def test_size_is_cut_to_a_whole_number(spark):
    df = spark.createDataFrame([("1", 5, "1", 9, "-12.7")], "chr1 string, coord1 long, chr2 string, coord2 long, n string")
    assert df.select(M.adjacency_size("n")).first()[0] == 12


def test_cut(spark):
    at = spark.createDataFrame([("1", 40, "+"), ("1", 41, "-"), ("1", 60, "-"), ("1", 500, "+"), ("2", 50, "+")], POS)
    assert rows(I.cut_segments(segs(spark, (1, 100)), at), "start", "end") == [(1, 40), (41, 59), (60, 100)]
    again = I.cut_segments(I.cut_segments(segs(spark, (1, 100)), at).drop("fid"), at)
    assert rows(again, "start", "end") == [(1, 40), (41, 59), (60, 100)]
    assert rows(I.outside(at, segs(spark, (1, 100))), "chr", "coord") == [("1", 500), ("2", 50)]


def test_cut_keeps_the_parents_copies_and_refuses_what_lies_outside(spark):
    s, c = segs(spark, (1, 100)), cns(spark, [("1:1-100", "c", 2, 1)])
    new, cn, old = I.refined_at(s, c, spark.createDataFrame([("1", 40, "+")], POS))
    assert rows(cn, "sid", "hap", "cn") == [("1:1-40", "A", 2), ("1:1-40", "B", 1), ("1:41-100", "A", 2), ("1:41-100", "B", 1)]
    assert rows(old) == [("1:1-40", "1:1-100"), ("1:41-100", "1:1-100")]
    with pytest.raises(ValueError):
        I.refined_at(s, c, spark.createDataFrame([("1", 400, "+")], POS))


def test_merge_and_fill(spark):
    s = segs(spark, (1, 100), (101, 200), (211, 300), (311, 400))
    c = cns(spark, [("1:1-100", "c", 1, 1), ("1:101-200", "c", 1, 1), ("1:211-300", "c", 1, 1), ("1:311-400", "c", 2, 1)])
    new, cn, mapping = I.refined(s, c)
    assert rows(new, "start", "end") == [(1, 305), (306, 400)]
    assert rows(cn, "sid", "hap", "cn") == [("1:1-305", "A", 1), ("1:1-305", "B", 1), ("1:306-400", "A", 2), ("1:306-400", "B", 1)]
    assert mapping.count() == 4
    assert rows(I.refined(s, c, max_merge_gap=5, fill=False)[0], "start", "end") == [(1, 200), (211, 300), (311, 400)]


def test_overlap_is_found_and_refused(spark):
    s, c = segs(spark, (1, 100), (100, 200)), cns(spark, [("1:1-100", "c", 1, 1), ("1:100-200", "c", 1, 1)])
    assert I.overlapping_segments(s).count() == 1
    with pytest.raises(Exception, match="overlapping"):
        I.refined(s, c)[0].collect()


def test_reference_adjacencies_and_telomeres(spark):
    s = segs(spark, (10001, 20000), (20001, 30000))
    assert rows(I.reference_adjacencies(s), "aid", "coord1", "strand1", "coord2", "strand2") == [("r1", 20000, "+", 20001, "-")]
    assert rows(I.reference_telomeres(s)) == [("1", 10001, "-"), ("1", 30000, "+")]


def test_wide_intervals_are_joined_in_few_bins(spark):
    pts = spark.createDataFrame([("1", 0), ("1", 5), ("1", 2_999_999_999), ("2", 5)], "chr string, coord long")
    iv = spark.createDataFrame([("1", 0, M.FAR, "w"), ("1", 4, 6, "n")], "i_chr string, i_start long, i_end long, rid string")
    assert rows(I.point_join(pts, iv), "coord", "rid") == [(0, "w"), (2_999_999_999, "w"), (5, "n"), (5, "w")]
    left = segs(spark, (1, 10), (5_000_000, 900_000_000))
    pairs = I.overlap_join(left, iv)
    assert rows(pairs, "sid", "rid") == [("1:1-10", "n"), ("1:1-10", "w"), ("1:5000000-900000000", "w")]


def test_alignment_of_samples(spark):
    s = spark.createDataFrame([("x", "1:1-100", "1", 1, 100), ("y", "1:11-50", "1", 11, 50), ("y", "1:51-90", "1", 51, 90), ("x", "2:1-9", "2", 1, 9)], "sample string, " + SEG)
    c = spark.createDataFrame([("x", "1:1-100", "c", "A", 1), ("y", "1:11-50", "c", "A", 2), ("y", "1:51-90", "c", "A", 3), ("x", "2:1-9", "c", "A", 1)], "sample string, " + CN)
    segs_, cn = I.aligned(s, c)
    assert rows(segs_, "sample", "sid") == [("x", "1:1-50"), ("x", "1:51-100"), ("x", "2:1-9"), ("y", "1:1-50"), ("y", "1:51-100")]
    assert ("y", "1:51-100", "c", "A", 3) in rows(cn, "sample", "sid", "clone", "hap", "cn")


def test_reciprocal_pairs_meet_in_the_middle(spark):
    adj = [("a", "1", 100, "+", "5", 9, "+"), ("b", "1", 120, "-", "6", 9, "+")]
    out = A.reciprocal(spark.createDataFrame(adj, ADJ))
    assert rows(out, "aid", "coord1", "strand1") == [("a", 110, "+"), ("b", 111, "-")]
    near = [("a", "1", 123450, "+", "5", 9, "+"), ("b", "1", 123451, "-", "6", 9, "+")]
    assert rows(A.reciprocal(spark.createDataFrame(near, ADJ)), "aid", "coord1") == [("a", 123450), ("b", 123451)]
    same = [("a", "1", 100, "+", "1", 120, "-")]
    assert rows(A.reciprocal(spark.createDataFrame(same, ADJ)), "coord1", "coord2") == [(100, 120)]


def test_clusters_split_and_snap(spark):
    ends = spark.createDataFrame([("a", 0, "1", 10, "+"), ("b", 0, "1", 20, "+"), ("c", 0, "1", 35, "-")], "aid string, side int, " + POS)
    out = A.snapped(A.split_clusters(A.clusters(ends, 300)))
    assert rows(out, "aid", "sub", "new_coord") == [("a", 1, 10), ("b", 2, 26), ("c", 2, 27)]


def test_update_and_concatenate(spark):
    schema = ADJ + ", extra map<string,string>"
    one = spark.createDataFrame([("a", "1", 1, "+", "1", 9, "-", {"x": "1", "y": "2"}), ("b", "1", 1, "+", "1", 8, "-", None)], schema)
    two = spark.createDataFrame([("a", "1", 3, "+", "1", 9, "-", {"x": "7", "z": "5"})], schema)
    out = {r["aid"]: r for r in A.updated(one, two, exclude=["z"]).collect()}
    assert out["a"]["coord1"] == 3 and out["a"]["extra"] == {"x": "7", "y": "2"} and out["b"]["coord1"] == 1
    assert A.concatenated([one, two]).count() == 3
    assert rows(A.concatenated([one, two], unique="skip"), "aid", "coord1") == [("a", 1), ("b", 1)]
    with pytest.raises(ValueError):
        A.concatenated([one, two], unique="error")


def test_region_filters(spark):
    adj = spark.createDataFrame([("a", "1", 15, "+", "1", 300, "-"), ("b", "1", 15, "+", "1", 18, "-"), ("c", "2", 1, "+", "3", 1, "-")], ADJ)
    reg = spark.createDataFrame([("r", "1", 10, 20), ("s", "1", 100, 200)], "rid string, chr string, start long, end long")
    ids = lambda **k: rows(FL.filter_by_regions(adj, **k), "aid")
    assert ids(include=reg) == [("b",)]
    assert ids(include=reg, include_both=False) == [("a",), ("b",)]
    assert ids(exclude=reg) == [("c",)]
    assert ids(exclude=reg, exclude_both=True) == [("a",), ("c",)]
    assert ids(include=reg, include_spanning=True) == [("a",), ("b",)]
    kept = FL.filter_by_regions(adj, reg, include_both=False, annotate=True)
    assert rows(kept, "aid", "retained_by") == [("a", ["r"]), ("b", ["r"])]


def test_extra_filters_on_missing_fields(spark):
    df = spark.createDataFrame([("a", {"x": "foo"}), ("b", {"x": "bar"}), ("c", {})], "aid string, extra map<string,string>")
    assert rows(FL.filter_by_extra(df, keep={"x": ["^f"]}), "aid") == [("a",)]
    assert rows(FL.filter_by_extra(df, keep={"x": ["^f"]}, missing_keep="keep"), "aid") == [("a",), ("c",)]
    assert rows(FL.filter_by_extra(df, remove={"x": ["^f"]}), "aid") == [("b",), ("c",)]
    assert rows(FL.filter_by_extra(df, remove={"x": ["^f"]}, missing_remove="remove"), "aid") == [("b",)]


def test_distance_takes_one_orientation_for_all_clones(spark):
    s = segs(spark, (1, 100))
    one, two = cns(spark, [("1:1-100", "c1", 2, 1)]), cns(spark, [("1:1-100", "d1", 1, 2)])
    costs = T.pair_costs(one, two, s, s.select("sid", F.col("sid").alias("fid")))
    assert rows(costs, "ab", "ba") == [(200, 0)]
    assert rows(T.distance_between(costs, T.matchings(["c1"], ["d1"])), "distance", "total") == [(0, 0)]
    assert rows(T.accuracy(one, two, s)) == [(1.0, 1.0)]
    swapped = two.withColumn("clone", F.lit("c1"))
    assert T.compatible(one, swapped, s).first()[0] and not T.compatible(one, swapped.withColumn("cn", F.col("cn") + 1), s).first()[0]
    assert len(T.matchings(["a", "b", "c"], ["x", "y"])) == 6


def test_bounds_by_length_and_sex(spark):
    s = spark.createDataFrame([("a", "1", 1, 50_000), ("b", "1", 1, 500_000), ("c", "1", 1, 5_000_000), ("d", "1", 1, 20_000_000), ("x", "chrX", 1, 10)], SEG)
    c = spark.createDataFrame([(k, "c", h, 2) for k in "abcdx" for h in "AB"], CN)
    out = T.bounds(c.where("hap = 'A' and sid <> 'x'"), s, "length-spread")
    assert rows(out.where("hap = 'A'"), "sid", "l", "u") == [("a", 0, 20), ("b", 0, 5), ("c", 0, 4), ("d", 1, 3), ("x", 0, 20)]
    assert rows(out.where("hap = 'B'"), "sid", "l", "u") == [("a", 0, 20), ("b", 0, 3), ("c", 0, 2), ("d", 0, 1), ("x", 0, 20)]
    male = T.bounds(c, s, "fix", sex="m").where("sid = 'x'")
    assert rows(male, "hap", "l", "u") == [("A", 2, 2), ("B", 0, 0)]
    with pytest.raises(ValueError):
        T.bounds(c, s, "none")


def _three(spark):
    return segs(spark, (1, 2), (3, 4), (5, 6))


def test_graph_counts_and_errors(spark):
    s = _three(spark)
    novel = spark.createDataFrame([("n", "1", 2, "+", "1", 5, "-", "N")], ADJ + ", at string")
    g = G.graph(s, I.reference_adjacencies(s).unionByName(novel))
    assert rows(g.groupBy("kind").count()) == [("N", 1), ("R", 2), ("S", 3)]
    assert G.half_edges(g).select("node").distinct().count() == 6 and G.proper_topology(g).isEmpty()
    with pytest.raises(ValueError):
        G.graph(s, spark.createDataFrame([("n", "1", 20, "+", "1", 5, "-", "N")], ADJ + ", at string"))


def test_imbalance_counts_a_loop_twice(spark):
    e = spark.createDataFrame([("u", "v", "S", 3), ("v", "w", "R", 1), ("v", "v", "N", 1), ("w", "x", "S", 1)], "u string, v string, kind string, cn int")
    assert rows(G.imbalance(e)) == [("u", 3), ("v", 0), ("w", 0), ("x", 1)]
    assert rows(G.telomeres(e), "node") == [("u",), ("x",)]
    assert G.represents_a_genome(e)
    assert G.chromosome_counts(e.withColumn("clone", F.lit("c")), ["clone"]).first()["chromosomes"] == 2


def test_signature(spark):
    adj = [("a", "1", 100, "+", "2", 200, "+"), ("b", "1", 101, "-", "3", 300, "+"), ("c", "7", 1, "+", "7", 9, "-")]
    out = G.complex_signatures(spark.createDataFrame(adj, ADJ))
    assert rows(out, "aids", "k") == [(["a", "b"], 3)]


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(100, 101), (200, 200), (None, 5)], "a long, b long")
    out = dict(rows(connected_components(e)))
    assert out[30] == 1 and out[101] == 100 and out[200] == 200 and len(out) == 33
    assert connected_components(e.where("a = -1")).isEmpty()


GROUP = "gid string, agt string, fp double, aids array<string>, agl array<int>"


def test_groups_from_reads_and_their_projection(spark):
    s = spark.createDataFrame([("r1", "a1"), ("r1", "a2"), ("r2", "a1")], "read string, aid string")
    assert rows(GR.molecule_groups(s)) == [("r1", ["a1", "a2"])]
    g = spark.createDataFrame([("l", "L", None, ["a", "b", "c"], [0, 1, 0]), ("m", "M", 0.1, ["b"], None), ("k", "L", None, ["a", "b"], [0, 0])], GROUP)
    out = GR.projected(g, spark.createDataFrame([("a",), ("c",)], "aid string"))
    assert rows(out, "gid", "aids", "agl") == [("l_p", ["a", "c"], [0, 0])]
    assert not GR.concur(g, spark.createDataFrame([("a",)], "aid string"))
    with pytest.raises(ValueError):
        GR.populated(g, spark.createDataFrame([("a",)], "aid string"))


def test_labelings_that_share_a_position_are_joined(spark):
    adj = spark.createDataFrame([("a", "1", 1, "+", "1", 50, "-"), ("b", "1", 60, "+", "1", 90, "-"), ("c", "1", 99, "+", "2", 1, "-")], ADJ)
    g = spark.createDataFrame([("x", "L", None, ["a", "b"], [1, 0]), ("y", "L", None, ["b", "c"], [0, 0]), ("z", "L", None, ["c", "c"], [1, 1])], GROUP)
    out = GR.refined_labelings(g, adj)
    assert [sorted(r["source_gids"]) for r in out.collect() if len(r["source_gids"]) > 1] == [["x", "y"]]


def test_group_violations(spark):
    cn = spark.createDataFrame([("a", "c", "AA", 1), ("b", "c", "AA", 0), ("d", "c", "BB", 1)], "aid string, clone string, phasing string, cn int")
    g = spark.createDataFrame([("m", "M", 0.1, ["a", "b"], None), ("ok", "M", 0.5, ["a", "b"], None), ("n", "N", 0.1, ["a", "b"], None), ("l", "L", None, ["a", "d"], [0, 0])], GROUP)
    assert rows(GR.molecule_violations(g, cn), "gid") == [("m",)]
    assert rows(GR.general_violations(g, cn), "gid") == [("n",)]
    assert rows(GR.labeling_violations(g, cn)) == [("l",)]


def test_alignment_labelings(spark):
    ends = spark.createDataFrame([("a", 1, "1", 1000, "-"), ("b", 0, "1", 5000, "+"), ("c", 0, "1", 3000, "+")], "aid string, side int, " + POS)
    more = spark.createDataFrame([(x, 0, "2", 10 * (k + 1), s) for k, (x, s) in enumerate(zip("defg", "-+-+"))], ends.schema)
    four = spark.createDataFrame([("q", 1, "2", 1, 50, ["d", "e", "f", "g"])], "read string, aln long, chr string, start long, end long, aids array<string>")
    assert rows(GR.alignment_labelings(more, four), "aids") == [(["d", "e"],), (["f", "g"],)]
    assert rows(GR.alignment_labelings(more, four, neighbour="last"), "aids") == [(["d", "e"],), (["d", "g"],), (["f", "g"],)]
    aln = spark.createDataFrame([("r", 1, "1", 900, 5100, ["a", "b"])], "read string, aln long, chr string, start long, end long, aids array<string>")
    assert rows(GR.alignment_labelings(ends, aln), "aids", "agl") == [(["a", "b"], [1, 0])]


def test_reports(spark):
    adj = spark.createDataFrame([("a", "1", 5, "+", "1", 15, "-"), ("b", "1", 25, "+", "2", 5, "-")], ADJ)
    assert rows(R.adjacency_density(adj, 10)) == [("1", 0, 1), ("1", 1, 1), ("1", 2, 1), ("2", 0, 1)]
    assert R.adjacency_density(adj, 100, full=True).first()["n"] == 1
    assert R.translocation_fraction(adj).first()[0] == 0.5
    s, c = segs(spark, (1, 15)), cns(spark, [("1:1-15", "c", 2, 0)])
    assert rows(R.altered_fractions(s, c, 10), "win", "ampl", "del") == [(0, 1.0, 1.0), (1, 0.5, 0.5)]


def test_near_pairs_come_once_and_do_not_move_again(spark):
    rng = random.Random(4)
    rows = [(f"a{i}", k, rng.choice("12"), rng.randrange(-30, 60), rng.choice("+-")) for i in range(150) for k in (0, 1)]
    ends = spark.createDataFrame(rows, "aid string, side int, chr string, coord long, strand string")
    by = {}
    for aid, _, chr_, x, strand in rows:
        by.setdefault(aid, []).append((chr_, strand, x))
    for reach, strict in ((0, False), (7, False), (7, True), (40, False)):
        near = lambda p, q: p[:2] == q[:2] and (abs(p[2] - q[2]) < reach if strict else abs(p[2] - q[2]) <= reach)
        brute = [(a, b) for a in by for b in by if a < b and (near(by[a][0], by[b][0]) and near(by[a][1], by[b][1]) or near(by[a][0], by[b][1]) and near(by[a][1], by[b][0]))]
        found = A.near_pairs(ends, reach, strict)
        assert sorted(map(tuple, found.collect())) == sorted(brute)
        assert found._jdf.queryExecution().optimizedPlan().toString().split("\n")[1].startswith("+- Join")  # nothing is moved once pairs are found


def test_clusters_are_parted_bin_by_bin(spark):
    rng = random.Random(7)
    ends = [(f"a{i}", k, "1", rng.randrange(20_000), rng.choice("+-")) for i in range(400) for k in (0, 1)]
    found = A.split_clusters(A.clusters(spark.createDataFrame(ends, "aid string, side int, chr string, coord long, strand string"), 300))
    brute, last, sub, alone = [], {}, 0, False
    for aid, side, _, x, strand in sorted(ends, key=lambda e: (e[3], e[4] == "+", e[0], e[1])):
        if not last or x - last["x"] > 300:
            sub, alone = 1, True
        elif strand == last["strand"] or not alone:
            sub, alone = sub + 1, True
        else:
            alone = False
        last = {"x": x, "strand": strand}
        brute.append((aid, side, sub))
    assert sorted((r["aid"], r["side"], r["sub"]) for r in found.collect()) == sorted(brute)
    assert not re.search(r"\[chr#\d+L?, cluster#\d+L?\], \[coord", found._jdf.queryExecution().optimizedPlan().toString())  # no window of all a cluster's rows


def test_karyotype_report_makes_its_tables_once(spark):
    """Groups and adjacencies are written before its parts read them, so no part numbers members or places ends anew."""
    from lociflow.plans.queries import QUERIES

    out = QUERIES["q_karyotype_report"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "lineitem" not in plan and "l_partkey" not in plan
    assert out.where("what = 'adjacencies'").count() > 0


def test_near_adjacencies_are_moved_few_times(spark):
    """An adjacency is moved as itself and, on average, in 2.5 rows for the cells it is near to, not for each of five."""
    rng = random.Random(6)
    rows = [(f"a{i}", "1", rng.randrange(100_000), rng.choice("+-"), "1", rng.randrange(100_000), rng.choice("+-")) for i in range(4000)]
    adj = spark.createDataFrame(rows, ADJ)
    found = A.near_adjacencies(adj, 1000)
    order = [tuple(sorted(((r[1], r[3], r[2]), (r[4], r[6], r[5])))) for r in rows]
    near = lambda p, q: p[:2] == q[:2] and abs(p[2] - q[2]) <= 1000
    by = {}
    for k, (p, q) in enumerate(order):
        by.setdefault((p[1], q[1], p[2] // 1000, q[2] // 1000), []).append(k)
    brute = set()
    for (s, t, i, j), own in by.items():
        other = [k for u in (-1, 0, 1) for v in (-1, 0, 1) for k in by.get((s, t, i + u, j + v), ())]
        brute |= {tuple(sorted((rows[a][0], rows[b][0]))) for a in own for b in other if a != b and near(order[a][0], order[b][0]) and near(order[a][1], order[b][1])}
    assert sorted(map(tuple, found.collect())) == sorted(brute) and len(brute) > 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.near_adjacencies(adj, 1000)._jdf.queryExecution()
        exchanges = plan.sparkPlan().toString(), plan.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert exchanges[0].count("SortMergeJoin") == 1 and "Aggregate" not in exchanges[0]  # ends aren't put together first
    # The rows that meet: one side each adjacency, the other those of its cells.
    left, right = (plan.optimizedPlan().children().apply(0).children().apply(k) for k in (0, 1))
    count = lambda side: spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, side).count()
    assert count(left) + count(right) < 4 * len(rows)
