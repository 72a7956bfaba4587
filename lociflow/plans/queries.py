"""Queries over the test tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import model as M
from lociflow.functions.register import register
from lociflow.operators import adjacency as A
from lociflow.operators import filters as FL
from lociflow.operators import graph as G
from lociflow.operators import groups as GR
from lociflow.operators import intervals as I
from lociflow.operators import merging as MG
from lociflow.operators import reports as R
from lociflow.operators import tensor as T
from lociflow.operators.components import connected_components
from lociflow.plans.views import Views, sql
from lociflow.shared import cut as written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "q_cut_scnt"


def query(name: str, text: str | None = None):
    """Registers a function of the views; whole numbers leave as 64 bits."""

    def register(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = make(Views(spark, sf_dir))
            return out.select(*[F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in out.dtypes])

        QUERIES[name] = run
        if text is not None:
            SQL[name] = sql(text)
        return make

    return register


ENDS = ("chr1", "coord1", "strand1", "chr2", "coord2", "strand2")

# --- data model and projections


def _raw(v):
    """Adjacencies with their ends in the order they come in."""
    return v.adj_raw.select("aid", *[x for k in (1, 2) for x in (F.col(f"c{k}").cast("string").alias(f"chr{k}"), F.col(f"x{k}").alias(f"coord{k}"), F.when(F.col(f"s{k}") == 1, "+").otherwise("-").alias(f"strand{k}"))])


@query("q_adj_canonical", "SELECT aid, chr1, coord1, strand1, chr2, coord2, strand2 FROM adj")
def _(v):
    return A.canonical(_raw(v))


@query("q_stable_ids", "SELECT aid, '[' || chr1 || ':' || strand1 || coord1 || ']-[' || chr2 || ':' || strand2 || coord2 || ']N' AS stable_id FROM adj")
def _(v):
    return A.stable_ids(v.adj).select("aid", "stable_id")


@query("q_breakends", "SELECT aid, side::BIGINT AS side, chr, coord, strand FROM breakend")
def _(v):
    return A.breakends(v.adj)


@query("q_segment_lengths", """SELECT sid, "end" - start + 1 AS length, ceil(("end" - start) / 10.0)::BIGINT AS length_10, ceil(("end" - start) / 100.0)::BIGINT AS length_100, ceil(("end" - start) / 1000.0)::BIGINT AS length_1000 FROM seg""")
def _(v):
    return v.seg.select("sid", M.segment_length().alias("length"), *(M.scaled_length(k).alias(f"length_{k}") for k in (10, 100, 1000)))


@query("q_reciprocal_position", "SELECT aid, side::BIGINT AS side, chr, CASE WHEN strand = '+' THEN coord + 1 ELSE coord - 1 END AS coord, CASE WHEN strand = '+' THEN '-' ELSE '+' END AS strand FROM breakend")
def _(v):
    return A.faced(v.breakend)


@query("q_adjacency_distance", "SELECT aid, CASE WHEN chr1 = chr2 THEN abs(coord1 - coord2) ELSE -1 END AS distance FROM adj")
def _(v):
    return v.adj.select("aid", M.distance().alias("distance"))


@query("q_haploid_scn", "SELECT sid, clone, 'A' AS hap, sum(cn)::BIGINT AS cn FROM scnt GROUP BY sid, clone")
def _(v):
    return T.haploid(v.scnt, "sid", "hap")


@query("q_haploid_acn", "SELECT aid, clone, 'AA' AS phasing, sum(cn)::BIGINT AS cn FROM acnt GROUP BY aid, clone")
def _(v):
    return T.haploid(v.acnt, "aid", "phasing")


@query(
    "q_diploid_inflate_edges",
    """SELECT chr || ':' || h || ':-' || start AS u, chr || ':' || h || ':+' || "end" AS v, 'S' AS kind, h || h AS phasing FROM seg, (VALUES ('A'), ('B')) t(h)
    UNION ALL SELECT chr1 || ':' || phasing[1] || ':' || strand1 || coord1, chr2 || ':' || phasing[2] || ':' || strand2 || coord2, 'N', phasing FROM adj, ph""",
)
def _(v):
    return G.inflated(v.seg, v.adj)


@query("q_phasing_flip", "SELECT aid, clone, reverse(phasing) AS flipped, cn FROM acnt WHERE cn > 0")
def _(v):
    return v.acnt.where("cn > 0").select("aid", "clone", M.flipped_phasing("phasing").alias("flipped"), "cn")


@query("q_phased_ends", """SELECT clone, aid, 0::BIGINT AS side, chr1 AS chr, coord1 AS coord, strand1 AS strand, phasing[1] AS hap, cn FROM acnt JOIN adj USING (aid) WHERE cn > 0
    UNION ALL SELECT clone, aid, 1, chr2, coord2, strand2, phasing[2], cn FROM acnt JOIN adj USING (aid) WHERE cn > 0""")
def _(v):
    return G.phased_ends(v.adj.select("aid", *ENDS), v.acnt)


# --- filters

_HITS = """WITH hits AS (
  SELECT a.aid, bool_or(r.chr = a.chr1 AND a.coord1 BETWEEN r.start AND r."end") AS one, bool_or(r.chr = a.chr2 AND a.coord2 BETWEEN r.start AND r."end") AS two,
         bool_or(a.chr1 = a.chr2 AND r.chr = a.chr1 AND r.start >= least(a.coord1, a.coord2) AND r."end" <= greatest(a.coord1, a.coord2)) AS whole
  FROM adj a JOIN regions r ON r.chr = a.chr1 OR r.chr = a.chr2 GROUP BY a.aid)
"""


@query("q_filter_region_both", _HITS + "SELECT aid FROM adj JOIN hits USING (aid) WHERE one AND two")
def _(v):
    return FL.filter_by_regions(v.adj, v.regions).select("aid")


@query("q_filter_region_any", _HITS + "SELECT aid FROM adj JOIN hits USING (aid) WHERE one OR two")
def _(v):
    return FL.filter_by_regions(v.adj, v.regions, include_both=False).select("aid")


@query("q_filter_region_spanning", _HITS + "SELECT aid FROM adj JOIN hits USING (aid) WHERE (one AND two) OR whole")
def _(v):
    return FL.filter_by_regions(v.adj, v.regions, include_spanning=True).select("aid")


@query("q_filter_region_exclude", _HITS + "SELECT aid FROM adj LEFT JOIN hits USING (aid) WHERE NOT coalesce(one OR two, false)")
def _(v):
    return FL.filter_by_regions(v.adj, exclude=v.regions).select("aid")


@query("q_filter_region_annotate", """SELECT a.aid, string_agg(DISTINCT r.rid, ',' ORDER BY r.rid) AS retained_by FROM adj a JOIN regions r
    ON (r.chr = a.chr1 AND a.coord1 BETWEEN r.start AND r."end") OR (r.chr = a.chr2 AND a.coord2 BETWEEN r.start AND r."end") GROUP BY a.aid""")
def _(v):
    return FL.filter_by_regions(v.adj, v.regions, include_both=False, annotate=True).select("aid", F.array_join("retained_by", ",").alias("retained_by"))


@query("q_filter_size", "SELECT aid FROM adj WHERE CASE WHEN chr1 <> chr2 THEN true ELSE abs(coord1 - coord2) BETWEEN 1000 AND 200000 END")
def _(v):
    return FL.filter_by_size(v.adj, M.distance(), 1000, 200000).select("aid")


@query("q_filter_size_intra", "SELECT aid FROM adj WHERE chr1 = chr2 AND abs(coord1 - coord2) <= 300000 AND NOT (coord1 = coord2 AND strand1 = strand2)")
def _(v):
    return FL.filter_by_size(v.adj, M.distance(), 0, 300000, inter=False, self_loops=False).select("aid")


def _with_extra(v):
    return v.adj.withColumn("extra", F.create_map(F.lit("sources"), F.col("sources")))


@query("q_filter_extra_regex_keep", "SELECT aid FROM adj WHERE regexp_matches(sources, '^a') OR regexp_matches(sources, 'c$')")
def _(v):
    return FL.filter_by_extra(_with_extra(v), keep={"sources": ["^a", "c$"]}).select("aid")


@query("q_filter_extra_regex_remove", "SELECT aid FROM adj WHERE NOT regexp_matches(sources, 'b') AND \"at\" = 'N'")
def _(v):
    return FL.filter_by_extra(_with_extra(v), keep={"at": ["N"]}, remove={"sources": ["b"]}, type_col="at").select("aid")


@query("q_seg_filter_region_full", """SELECT sid FROM seg s WHERE EXISTS (SELECT 1 FROM regions r WHERE r.chr = s.chr AND s.start >= r.start AND s."end" <= r."end")""")
def _(v):
    return FL.filter_segments_by_regions(v.seg, v.regions).select("sid")


@query("q_seg_filter_region_partial", """SELECT sid FROM seg s WHERE EXISTS (SELECT 1 FROM regions r WHERE r.chr = s.chr AND s.start <= r."end" AND s."end" >= r.start)""")
def _(v):
    return FL.filter_segments_by_regions(v.seg, v.regions, include_full=False).select("sid")


@query("q_seg_filter_region_exclude", """SELECT sid FROM seg s WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.chr = s.chr AND s.start <= r."end" AND s."end" >= r.start)""")
def _(v):
    return FL.filter_segments_by_regions(v.seg, exclude=v.regions).select("sid")


@query("q_seg_filter_size", """SELECT sid FROM seg WHERE "end" - start BETWEEN 7600 AND 1000000000""")
def _(v):
    return FL.filter_segments_by_size(v.seg, 7600).select("sid")


@query("q_drop_short_novel", "SELECT aid FROM adj WHERE chr1 <> chr2 OR abs(coord1 - coord2) >= 50000")
def _(v):
    return FL.drop_short(v.adj, 50000).select("aid")


# --- joins


@query("q_cn_lookup_default", "SELECT s.sid, h.clone, h.hap, coalesce(t.cn, 0) AS cn FROM seg s CROSS JOIN (SELECT DISTINCT clone, hap FROM scnt) h LEFT JOIN (SELECT * FROM scnt WHERE cn > 1) t ON t.sid = s.sid AND t.clone = h.clone AND t.hap = h.hap")
def _(v):
    keys = v.seg.select("sid").crossJoin(v.scnt.select("clone", "hap").distinct())
    return T.looked_up(keys, v.scnt.where("cn > 1"), ["sid", "clone", "hap"])


@query("q_mate_join", "SELECT aid || '_1' AS id, aid || '_2' AS mate, chr1, coord1, chr2, coord2 FROM adj")
def _(v):
    half = lambda k, o: v.adj.select(F.concat("aid", F.lit(f"_{k}")).alias("id"), F.concat("aid", F.lit(f"_{o}")).alias("mate_id"), F.col(f"chr{k}").alias("chr"), F.col(f"coord{k}").alias("coord"), (F.col("k") * 2 + k).alias("ord"))
    pairs = A.mate_join(half(1, 2).unionByName(half(2, 1)))
    return pairs.select("id", F.col("m_id").alias("mate"), F.col("chr").alias("chr1"), F.col("coord").alias("coord1"), F.col("m_chr").alias("chr2"), F.col("m_coord").alias("coord2"))


@query("q_update_adjacencies", "SELECT aid, chr1, coord1 + CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END AS coord1, strand1, chr2, coord2, strand2 FROM adj")
def _(v):
    source = v.adj.where("k % 3 = 0").withColumn("coord1", F.col("coord1") + 5)
    return A.updated(v.adj, source).select("aid", *ENDS)


_KEPT = """WITH kept AS (SELECT m.*, count(*) OVER (PARTITION BY gid) AS n_all FROM member m),
left_ AS (SELECT k.gid, k.agt, k.pos, k.aid, k.side, k.n_all FROM kept k JOIN adj a USING (aid) WHERE a.k % 3 <> 0),
g AS (SELECT gid, agt, n_all, count(*) AS n, string_agg(aid, ',' ORDER BY pos) AS aids, string_agg(side::VARCHAR, ',' ORDER BY pos) AS agl FROM left_ GROUP BY gid, agt, n_all)
"""


@query("q_project_groups", _KEPT + "SELECT CASE WHEN n < n_all AND agt <> 'N' THEN gid || '_p' ELSE gid END AS gid, agt, aids, agl FROM g WHERE agt <> 'L' OR n >= 2")
def _(v):
    out = GR.projected(v.groups(), v.adj.where("k % 3 <> 0"))
    return out.select("gid", "agt", F.array_join("aids", ",").alias("aids"), F.array_join(F.transform("agl", lambda x: x.cast("string")), ",").alias("agl"))


@query("q_group_members", "SELECT gid, pos::BIGINT AS pos, aid, side::BIGINT AS side FROM member")
def _(v):
    return GR.exploded(v.groups())


@query("q_positions_outside", """SELECT aid, side::BIGINT AS side, chr, coord, strand FROM breakend b WHERE NOT EXISTS (SELECT 1 FROM seg s WHERE s.chr = b.chr AND b.coord BETWEEN s.start AND s."end")""")
def _(v):
    return I.outside(v.breakend, v.seg)


@query("q_positions_aligned", """WITH p AS (SELECT DISTINCT chr, coord, strand FROM breakend), q AS (SELECT DISTINCT chr, coord, strand FROM breakend WHERE strand = '+')
    SELECT (SELECT count(*) = 0 FROM (SELECT * FROM q EXCEPT SELECT * FROM p)) AS some_among_all, (SELECT count(*) = 0 FROM (SELECT * FROM p EXCEPT SELECT * FROM q)) AS all_among_some""")
def _(v):
    some = v.breakend.where("strand = '+'")
    return v.spark.createDataFrame([(GR.positions_aligned(some, v.breakend), GR.positions_aligned(v.breakend, some))], "some_among_all boolean, all_among_some boolean")


@query("q_groups_concur", "SELECT true AS whole, (SELECT count(*) = 0 FROM member m WHERE NOT EXISTS (SELECT 1 FROM adj a WHERE a.aid = m.aid AND a.k % 2 = 0)) AS half")
def _(v):
    groups = v.groups()
    return v.spark.createDataFrame([(GR.concur(groups, v.adj), GR.concur(groups, v.adj.where("k % 2 = 0")))], "whole boolean, half boolean")


@query("q_spanned_extremities", """SELECT DISTINCT e.* FROM (SELECT chr, start AS coord, '-' AS strand FROM seg UNION ALL SELECT chr, "end", '+' FROM seg) e JOIN regions r ON r.chr = e.chr AND e.coord BETWEEN r.start AND r."end\"""")
def _(v):
    return I.spanned_extremities(v.seg, v.regions)


_CUTS = """WITH cuts AS (SELECT DISTINCT chr, CASE WHEN strand = '+' THEN coord ELSE coord - 1 END AS c FROM breakend),
starts AS (SELECT s.sid AS fid, s.chr, c.c + 1 AS start, s."end" AS f_end FROM seg s JOIN cuts c ON c.chr = s.chr AND c.c >= s.start AND c.c < s."end"
  UNION ALL SELECT sid, chr, start, "end" FROM seg),
pieces AS (SELECT fid, chr, start, coalesce(lead(start) OVER (PARTITION BY fid ORDER BY start) - 1, f_end) AS "end" FROM starts),
cutseg AS (SELECT chr || ':' || start || '-' || "end" AS sid, chr, start, "end", fid FROM pieces)
"""


@query("q_cut_segments", _CUTS + """SELECT sid, chr, start, "end", fid FROM cutseg""")
def _(v):
    return I.cut_segments(v.seg, v.breakend)


@query("q_cut_scnt", _CUTS + """SELECT t.clone, t.hap, count(*) AS n, sum(t.cn * (c."end" - c.start + 1))::BIGINT AS length FROM cutseg c JOIN scnt t ON t.sid = c.fid GROUP BY t.clone, t.hap""")
def _(v):
    segs, cn, _ = I.refined_at(v.seg, v.scnt, v.breakend, strict=False)
    return cn.join(segs, "sid").groupBy("clone", "hap").agg(F.count("*").alias("n"), F.sum(F.col("cn") * M.segment_length()).cast("long").alias("length"))


@query("q_cut_inherited", _CUTS + "SELECT c.sid, t.clone, t.hap, t.cn FROM cutseg c JOIN scnt t ON t.sid = c.fid")
def _(v):
    return I.refined_at(v.seg, v.scnt, v.breakend, strict=False)[1]


@query("q_segment_to_fragment", _CUTS + """SELECT c.sid, min_by(c.sid, c.start) OVER w || '-' || max_by(c.sid, c.start) OVER w AS fid FROM cutseg c WINDOW w AS (PARTITION BY c.fid)""")
def _(v):
    return I.segments_to_fragments(I.cut_segments(v.seg, v.breakend), v.seg)


@query("q_near_duplicates", """SELECT DISTINCT x.aid, y.aid AS bid FROM adj x JOIN adj y ON x.aid < y.aid AND (
    (x.chr1 = y.chr1 AND x.chr2 = y.chr2 AND x.strand1 = y.strand1 AND x.strand2 = y.strand2 AND abs(x.coord1 - y.coord1) <= 20000 AND abs(x.coord2 - y.coord2) <= 20000)
    OR (x.chr1 = y.chr2 AND x.chr2 = y.chr1 AND x.strand1 = y.strand2 AND x.strand2 = y.strand1 AND abs(x.coord1 - y.coord2) <= 20000 AND abs(x.coord2 - y.coord1) <= 20000))""")
def _(v):
    return A.near_pairs(v.breakend, 20000)


# --- aggregates


@query("q_scn_combined", "SELECT sid, clone, hap, sum(cn)::BIGINT AS cn FROM (SELECT * FROM scnt UNION ALL SELECT * FROM scnt2) GROUP BY ALL")
def _(v):
    return T.combined([v.scnt, v.scnt2], "sid", "hap")


@query("q_acn_combined", "SELECT aid, clone, phasing, 2 * cn AS cn FROM acnt")
def _(v):
    return T.combined([v.acnt, v.acnt], "aid", "phasing", M.PHASINGS)


@query("q_clone_lengths", """SELECT clone, sum(cn * ("end" - start + 1))::BIGINT AS length FROM scnt JOIN seg USING (sid) GROUP BY clone""")
def _(v):
    return T.clone_lengths(v.scnt, v.seg)


@query("q_max_cn", "SELECT clone, max(cn) AS max_cn FROM scnt GROUP BY clone")
def _(v):
    return T.max_cn(v.scnt, ["clone"])


_WIDE = """w AS (SELECT sid, clone, coalesce(sum(cn) FILTER (hap = 'A'), 0)::BIGINT AS a, coalesce(sum(cn) FILTER (hap = 'B'), 0)::BIGINT AS b FROM scnt GROUP BY sid, clone),
w2 AS (SELECT sid, clone, coalesce(sum(cn) FILTER (hap = 'A'), 0)::BIGINT AS a, coalesce(sum(cn) FILTER (hap = 'B'), 0)::BIGINT AS b FROM scnt2 GROUP BY sid, clone),
len AS (SELECT sid, chr, "end" - start + 1 AS length FROM seg)
"""


@query("q_cn_distance_intra", "WITH " + _WIDE + "SELECT x.clone AS clone1, y.clone AS clone2, sum(l.length * (abs(x.a - y.a) + abs(x.b - y.b)))::BIGINT AS distance FROM w x JOIN w y ON x.sid = y.sid AND x.clone < y.clone JOIN len l ON l.sid = x.sid GROUP BY 1, 2")
def _(v):
    return T.distance_within(v.scnt, v.seg)


_COSTS = "WITH " + _WIDE + """, costs AS (SELECT l.chr AS fid, x.clone AS clone1, y.clone AS clone2, sum(l.length * (abs(x.a - y.a) + abs(x.b - y.b)))::BIGINT AS ab, sum(l.length * (abs(x.a - y.b) + abs(x.b - y.a)))::BIGINT AS ba
  FROM w x JOIN w2 y ON x.sid = y.sid JOIN len l ON l.sid = x.sid GROUP BY 1, 2, 3),
cases AS (SELECT * FROM (VALUES (0, 'c1', 'c1'), (0, 'c2', 'c2'), (1, 'c1', 'c2'), (1, 'c2', 'c1')) t(case_id, clone1, clone2)),
chosen AS (SELECT case_id, clone1, clone2, CASE WHEN sum(ab) OVER (PARTITION BY case_id, fid) <= sum(ba) OVER (PARTITION BY case_id, fid) THEN ab ELSE ba END AS d FROM cases JOIN costs USING (clone1, clone2)),
per AS (SELECT case_id, clone1, clone2, sum(d)::BIGINT AS distance FROM chosen GROUP BY 1, 2, 3)
"""


def _costs(v):
    return T.pair_costs(v.scnt, v.scnt2, v.seg, v.seg.select("sid", F.col("chr").alias("fid")))


@query("q_cn_pair_costs", _COSTS + "SELECT * FROM costs")
def _(v):
    return _costs(v)


@query("q_cn_distance_inter", _COSTS + "SELECT case_id::BIGINT AS case_id, clone1, clone2, distance, (sum(distance) OVER (PARTITION BY case_id))::BIGINT AS total FROM per")
def _(v):
    return T.distance_between(_costs(v), T.matchings(["c1", "c2"], ["c1", "c2"]))


@query("q_cn_matchings_top", _COSTS + "SELECT case_id::BIGINT AS case_id, clone1, clone2, distance, total FROM (SELECT *, (sum(distance) OVER (PARTITION BY case_id))::BIGINT AS total FROM per) WHERE case_id = (SELECT case_id FROM per GROUP BY case_id ORDER BY sum(distance), case_id LIMIT 1)")
def _(v):
    return T.distance_between(_costs(v), T.matchings(["c1", "c2"], ["c1", "c2"]), top=1)


@query("q_cn_accuracy", "WITH " + _WIDE + """, t AS (SELECT sid, list_distinct(list((a, b))) AS t FROM w GROUP BY sid),
i AS (SELECT sid, list_distinct(list((a, b))) AS i, list_distinct(list((b, a))) AS r FROM w2 GROUP BY sid),
pr AS (SELECT l.length, len(list_intersect(t.t, i.i)) / len(i.i) AS p1, len(list_intersect(t.t, i.i)) / len(t.t) AS r1, len(list_intersect(t.t, i.r)) / len(i.r) AS p2, len(list_intersect(t.t, i.r)) / len(t.t) AS r2 FROM t JOIN i USING (sid) JOIN len l USING (sid)),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1, CASE WHEN p2 + r2 > 0 THEN 2 * p2 * r2 / (p2 + r2) ELSE 0.0 END AS f2 FROM pr)
SELECT round(sum(length * CASE WHEN f1 > f2 THEN p1 ELSE p2 END) / sum(length), 9) AS precision, round(sum(length * CASE WHEN f1 > f2 THEN r1 ELSE r2 END) / sum(length), 9) AS recall FROM f""")
def _(v):
    return T.accuracy(v.scnt, v.scnt2, v.seg).select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("q_tensors_compatible", "WITH " + _WIDE + "SELECT bool_and((x.a = y.a AND x.b = y.b) OR (x.a = y.b AND x.b = y.a)) AS compatible FROM w x JOIN w2 y USING (sid, clone)")
def _(v):
    return T.compatible(v.scnt, v.scnt2, v.seg)


@query("q_infinite_sites_violations", "SELECT chr, coord, strand, count(DISTINCT aid) AS n FROM breakend GROUP BY ALL HAVING count(DISTINCT aid) > 1")
def _(v):
    return A.reused_extremities(v.breakend)


@query("q_group_size_tally", "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM member GROUP BY gid) GROUP BY size")
def _(v):
    return GR.size_tally(v.groups())


@query("q_group_size_report", """SELECT o.ord::BIGINT AS ord, o.label, count(s.size) AS n FROM (SELECT i - 19 AS ord, CASE WHEN i = 19 THEN '<20' WHEN i = 40 THEN '>=40' ELSE i::VARCHAR END AS label, i FROM range(19, 41) t(i)) o
    LEFT JOIN (SELECT count(*) AS size FROM member GROUP BY gid) s ON CASE WHEN s.size < 20 THEN 19 WHEN s.size >= 40 THEN 40 ELSE s.size END = o.i GROUP BY o.ord, o.label""")
def _(v):
    return GR.size_report(v.groups(), 20, 40)


_SIZE = "CASE WHEN chr1 = chr2 THEN abs(coord1 - coord2) ELSE -1 END"


def _edge_case(value: str, edges) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {e} THEN {e}" for e in edges) + f" ELSE {M.FAR} END"


@query("q_source_tally", f"SELECT sources, ({_edge_case(_SIZE, R.SOURCE_EDGES)})::BIGINT AS below, count(*) AS n FROM adj GROUP BY ALL")
def _(v):
    return R.source_tally(v.adj, "sources", M.distance(), pivot=False)


@query("q_source_tally_pivot", "SELECT sources, " + ", ".join(f"count(*) FILTER (b = {e}) AS below_{e}" for e in (*R.SOURCE_EDGES, M.FAR)) + f" FROM (SELECT sources, ({_edge_case(_SIZE, R.SOURCE_EDGES)})::BIGINT AS b FROM adj) GROUP BY sources")
def _(v):
    return R.source_tally(v.adj, "sources", M.distance())


@query("q_length_bins_by_strand", f"SELECT strand1 || strand2 AS annotation, ({_edge_case(_SIZE, R.LENGTH_EDGES)})::BIGINT AS below, count(*) AS n FROM adj GROUP BY ALL")
def _(v):
    return R.length_bins(v.adj, F.concat("strand1", "strand2"), M.distance())


_TYPE = "CASE WHEN chr1 <> chr2 THEN 'TRA' WHEN strand1 = '-' AND strand2 = '+' THEN 'DUP' WHEN strand1 = strand2 THEN 'INV' WHEN k % 5 = 0 THEN 'INS' WHEN k % 5 = 1 THEN 'DEL' WHEN k % 7 - 3 > 0 THEN 'INS' ELSE 'DEL' END"


def _typed(v):
    own = F.when(F.col("k") % 5 == 0, "Insertion").when(F.col("k") % 5 == 1, "DEL").otherwise("BND")
    return A.standard_type(own, (F.col("k") % 7 - 3).cast("string"))


@query("q_svtype_standard", f"SELECT aid, {_TYPE} AS svtype FROM adj")
def _(v):
    return v.adj.select("aid", _typed(v).alias("svtype"))


@query("q_length_bins_by_svtype", f"SELECT {_TYPE} AS annotation, ({_edge_case(_SIZE, R.LENGTH_EDGES)})::BIGINT AS below, count(*) AS n FROM adj GROUP BY ALL")
def _(v):
    return R.length_bins(v.adj, _typed(v), M.distance())


@query("q_read_support_hist", "SELECT adjacencies, count(*) AS reads FROM (SELECT count(DISTINCT aid) AS adjacencies FROM support GROUP BY read) GROUP BY adjacencies")
def _(v):
    return R.read_support(v.support)


@query("q_support_capped", "SELECT least(r, 3) AS reads, count(*) AS adjacencies FROM (SELECT count(DISTINCT read) AS r FROM support GROUP BY aid) GROUP BY 1")
def _(v):
    return R.capped_support(v.support, 3)


@query("q_source_cooccurrence", "SELECT a.s AS one, b.s AS two, count(*) AS n FROM (SELECT aid, unnest(string_split(sources, ',')) AS s FROM adj) a JOIN (SELECT aid, unnest(string_split(sources, ',')) AS s FROM adj) b ON a.aid = b.aid AND a.s <= b.s GROUP BY 1, 2")
def _(v):
    return R.source_cooccurrence(v.adj, "sources")


@query("q_origin_sources", "SELECT sources, count(*) AS n FROM adj GROUP BY sources")
def _(v):
    tagged = F.array_join(F.transform(F.split("sources", ","), lambda s: F.concat(s, F.lit("_"), F.col("aid"))), ",")
    return R.origin_sources(v.adj.withColumn("origin_ids", tagged), "origin_ids", "([a-z]+)_")


@query("q_origin_support", "SELECT 'm' || (k % 50) AS aid, floor(avg(r))::BIGINT AS mean_reads FROM adj JOIN (SELECT aid, count(DISTINCT read) AS r FROM support GROUP BY aid) s USING (aid) GROUP BY 1")
def _(v):
    merged = v.adj.groupBy(F.concat(F.lit("m"), (F.col("k") % 50).cast("string")).alias("aid")).agg(F.array_join(F.array_sort(F.collect_list("aid")), ",").alias("origin_ids"))
    return R.origin_support(merged, v.support)


@query("q_window_density_breakend", "SELECT chr, (coord - 1) // 50000 AS win, count(*) AS n FROM breakend GROUP BY ALL")
def _(v):
    return R.breakend_density(v.breakend, 50000)


@query("q_window_density_adj", "SELECT chr, win, count(*) AS n FROM (SELECT DISTINCT aid, chr, (coord - 1) // 50000 AS win FROM breakend) GROUP BY ALL")
def _(v):
    return R.adjacency_density(v.adj, 50000)


@query("q_window_density_full", "SELECT chr1 AS chr, (coord1 - 1) // 50000 AS win, count(*) AS n FROM adj WHERE chr1 = chr2 AND (coord1 - 1) // 50000 = (coord2 - 1) // 50000 GROUP BY ALL")
def _(v):
    return R.adjacency_density(v.adj, 50000, full=True)


_FRACTIONS = "WITH " + _WIDE + """, wins AS (SELECT s.sid, s.chr, w.w AS win, greatest(s.start, w.w * 50000 + 1) AS lo, least(s."end", (w.w + 1) * 50000) AS hi FROM seg s, LATERAL (SELECT unnest(range((s.start - 1) // 50000, (s."end" - 1) // 50000 + 1)) AS w) w)
SELECT x.chr, x.win, w.clone, sum(CASE WHEN {up} THEN hi - lo + 1 ELSE 0 END) / 50000 AS ampl, sum(CASE WHEN {down} THEN hi - lo + 1 ELSE 0 END) / 50000 AS del FROM wins x JOIN w ON w.sid = x.sid GROUP BY ALL"""


@query("q_cna_fractions", _FRACTIONS.format(up="w.a > 1 OR w.b > 1", down="w.a < 1 OR w.b < 1"))
def _(v):
    return R.altered_fractions(v.seg, v.scnt, 50000)


@query("q_cna_fractions_haploid", _FRACTIONS.format(up="w.a + w.b > 2", down="w.a + w.b < 2"))
def _(v):
    return R.altered_fractions(v.seg, v.scnt, 50000, haploid=True)


@query("q_translocation_fraction", "SELECT avg((chr1 <> chr2)::INT) AS fraction FROM adj")
def _(v):
    return R.translocation_fraction(v.adj)


@query("q_absent_fraction", "SELECT 1 - avg(there) AS absent FROM (SELECT (sum(cn) > 0)::INT AS there FROM acnt GROUP BY aid)")
def _(v):
    return R.absent_fraction(v.acnt)


@query("q_karyotype_counts", "SELECT 'segments' AS what, chr AS name, count(*) AS n FROM seg GROUP BY chr UNION ALL SELECT 'adjacencies', \"at\", count(*) FROM adj GROUP BY \"at\"")
def _(v):
    return R.karyotype_counts(v.seg, v.adj)


# --- order-dependent operators

_REFS = """WITH pairs AS (SELECT chr, "end" AS coord1, lead(start) OVER (PARTITION BY chr ORDER BY start, "end") AS coord2, start, "end" FROM seg),
refs AS (SELECT 'r' || row_number() OVER (ORDER BY chr, start, "end") AS aid, chr AS chr1, coord1, '+' AS strand1, chr AS chr2, coord2, '-' AS strand2, 'R' AS at FROM pairs WHERE coord2 IS NOT NULL)
"""


@query("q_ref_adjacencies", _REFS + "SELECT * FROM refs")
def _(v):
    return I.reference_adjacencies(v.seg)


@query("q_ref_telomeres", """SELECT chr, min(start) AS coord, '-' AS strand FROM seg GROUP BY chr UNION ALL SELECT chr, max("end"), '+' FROM seg GROUP BY chr""")
def _(v):
    return I.reference_telomeres(v.seg)


@query("q_overlap_check", """SELECT sid, previous_end FROM (SELECT sid, start, lag("end") OVER (PARTITION BY chr ORDER BY start, "end", sid) AS previous_end FROM (SELECT sid, chr, start, CASE WHEN i % 9 = 0 THEN "end" + 5000 ELSE "end" END AS "end" FROM seg)) WHERE previous_end >= start""")
def _(v):
    longer = v.seg.withColumn("end", F.when(F.col("i") % 9 == 0, F.col("end") + 5000).otherwise(F.col("end")))
    return I.overlapping_segments(longer).select("sid", "previous_end")


_REFINED = """WITH vec AS (SELECT sid, string_agg(clone || hap || cn, ',' ORDER BY clone, hap) AS cns FROM scnt GROUP BY sid),
marked AS (SELECT s.*, v.cns, CASE WHEN lag("end") OVER w IS NULL OR s.start - lag("end") OVER w > {merge_gap} OR v.cns <> lag(v.cns) OVER w OR NOT {merge} THEN 1 ELSE 0 END AS new FROM seg s JOIN vec v USING (sid) WINDOW w AS (PARTITION BY chr ORDER BY start, "end", sid)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY start, "end", sid) AS island FROM marked),
mrg AS (SELECT chr, island, min(start) AS start, max("end") AS "end", min(sid) AS any_sid FROM isl GROUP BY chr, island),
gaps AS (SELECT *, lead(start) OVER v - "end" AS after, start - lag("end") OVER v AS ahead, lag("end") OVER v AS before_end FROM mrg WINDOW v AS (PARTITION BY chr ORDER BY start)),
fill AS (SELECT chr, island, CASE WHEN {fill} AND ahead BETWEEN 2 AND 1000000000 THEN before_end + ahead // 2 + 1 ELSE start END AS start, CASE WHEN {fill} AND after BETWEEN 2 AND 1000000000 THEN "end" + after // 2 ELSE "end" END AS "end" FROM gaps),
ref AS (SELECT *, chr || ':' || start || '-' || "end" AS sid FROM fill)
"""


@query("q_refine_merge", _REFINED.format(merge="true", fill="false", merge_gap=100) + 'SELECT sid, chr, start, "end" FROM ref')
def _(v):
    return I.refined(v.seg, v.scnt, max_merge_gap=100, fill=False)[0]


@query("q_refine_fill", _REFINED.format(merge="true", fill="true", merge_gap=10**9) + 'SELECT sid, chr, start, "end" FROM ref')
def _(v):
    return I.refined(v.seg, v.scnt)[0]


_CUT_REFINED = _REFINED.format(merge="true", fill="true", merge_gap=10**9) + """, tel AS (SELECT chr, min(start) AS coord, '-' AS strand FROM seg GROUP BY chr UNION ALL SELECT chr, max("end"), '+' FROM seg GROUP BY chr),
cuts AS (SELECT DISTINCT chr, CASE WHEN strand = '+' THEN coord ELSE coord - 1 END AS c FROM (SELECT chr, coord, strand FROM breakend UNION ALL SELECT * FROM tel)),
st AS (SELECT r.sid AS fid, r.chr, c.c + 1 AS start, r."end" AS fe FROM ref r JOIN cuts c ON c.chr = r.chr AND c.c >= r.start AND c.c < r."end" UNION ALL SELECT sid, chr, start, "end" FROM ref),
pc AS (SELECT fid, chr, start, coalesce(lead(start) OVER (PARTITION BY fid ORDER BY start) - 1, fe) AS "end" FROM st)
"""


def _refined_input(v):
    return I.refined_input(v.seg, v.scnt, v.adj, I.reference_telomeres(v.seg), strict=False)


@query("q_refine_input", _CUT_REFINED + """SELECT chr || ':' || start || '-' || "end" AS sid, chr, start, "end", fid FROM pc""")
def _(v):
    return _refined_input(v)[1].select("sid", "chr", "start", "end", "fid")


@query("q_refine_input_scnt", _CUT_REFINED + """SELECT DISTINCT p.chr || ':' || p.start || '-' || p."end" AS sid, t.clone, t.hap, t.cn FROM pc p JOIN ref r ON r.sid = p.fid JOIN isl i ON i.chr = r.chr AND i.island = r.island JOIN scnt t ON t.sid = i.sid""")
def _(v):
    return _refined_input(v)[2]


@query("q_sample", "SELECT aid, chr1, coord1, chr2, coord2 FROM adj ORDER BY md5('7:' || aid), aid LIMIT 100")
def _(v):
    return A.sampled(v.adj, 100).select("aid", "chr1", "coord1", "chr2", "coord2")


@query(
    "q_sql_functions",
    """SELECT aid, chr1 || ':' || (CASE WHEN strand1 = '+' THEN coord1 + 1 ELSE coord1 - 1 END) || '-' || coord2 AS sid, CASE WHEN strand2 = '+' THEN '-' ELSE '+' END AS strand,
    CASE WHEN chr1 = chr2 THEN abs(coord1 - coord2) ELSE -1 END AS distance FROM adj WHERE length(chr1) = 1""",
)
def _(v):
    register(v.spark)
    text = """SELECT aid, sid(strip_chr(concat('chr', chr1)), reciprocal(coord1, strand1), coord2) AS sid, flipped_strand(strand2) AS strand,
    adjacency_distance(chr1, coord1, chr2, coord2) AS distance FROM {adj} WHERE chr_rank(chr1).n = 1"""
    return v.spark.sql(text, adj=v.adj)


@query(
    "q_sql_windows",
    """SELECT sid, k AS n, greatest(start, k * 3000 + 1) AS begin, least("end", (k + 1) * 3000) AS last FROM (SELECT *, unnest(range((start - 1) // 3000, ("end" - 1) // 3000 + 1)) AS k FROM seg)""",
)
def _(v):
    register(v.spark)
    return v.spark.sql("SELECT s.sid, w.n, w.begin, w.last FROM {seg} s, LATERAL segment_windows(s.chr, s.start, s.`end`, 3000) w", seg=v.seg)


@query("q_refine_mapping", _REFINED.format(merge="true", fill="true", merge_gap=10**9) + "SELECT r.sid, i.sid AS old_sid FROM ref r JOIN isl i ON i.chr = r.chr AND i.island = r.island")
def _(v):
    return I.refined(v.seg, v.scnt)[2]


@query("q_refine_scnt", _REFINED.format(merge="true", fill="true", merge_gap=10**9) + "SELECT DISTINCT r.sid, t.clone, t.hap, t.cn FROM ref r JOIN isl i ON i.chr = r.chr AND i.island = r.island JOIN scnt t ON t.sid = i.sid")
def _(v):
    return I.refined(v.seg, v.scnt)[1]


@query("q_refine_scnb", _REFINED.format(merge="true", fill="true", merge_gap=10**9) + "SELECT r.sid, t.clone, t.hap, 'u' AS bound, min_by(t.cn + 1, i.start) AS value FROM ref r JOIN isl i ON i.chr = r.chr AND i.island = r.island JOIN scnt t ON t.sid = i.sid GROUP BY ALL")
def _(v):
    scnb = v.scnt.select("sid", "clone", "hap", F.lit("u").alias("bound"), (F.col("cn") + 1).alias("value"))
    return I.inherited_bounds(scnb, I.refined(v.seg, v.scnt)[2], v.seg.select(F.col("sid").alias("old_sid"), F.col("start").alias("ord")))


_CLUSTERS = """WITH lagged AS (SELECT *, lag(coord) OVER (PARTITION BY chr ORDER BY coord, (strand = '+')::INT, aid, side) AS pc FROM breakend),
clu AS (SELECT *, sum(CASE WHEN coord - pc <= 300 THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY coord, (strand = '+')::INT, aid, side)::BIGINT AS cluster FROM lagged),
runs AS (SELECT *, sum(same) OVER (PARTITION BY chr, cluster ORDER BY coord, (strand = '+')::INT, aid, side) AS run FROM (SELECT *, CASE WHEN strand = lag(strand) OVER (PARTITION BY chr, cluster ORDER BY coord, (strand = '+')::INT, aid, side) THEN 1 ELSE 0 END AS same FROM clu)),
odd AS (SELECT *, row_number() OVER (PARTITION BY chr, cluster, run ORDER BY coord, (strand = '+')::INT, aid, side) % 2 AS o FROM runs),
spl AS (SELECT *, sum(o) OVER (PARTITION BY chr, cluster ORDER BY coord, (strand = '+')::INT, aid, side)::BIGINT AS sub FROM odd)
"""


@query("q_cluster_breakends", _CLUSTERS + "SELECT aid, side::BIGINT AS side, chr, coord, strand, cluster FROM clu")
def _(v):
    return A.clusters(v.breakend)


@query("q_cluster_split", _CLUSTERS + "SELECT aid, side::BIGINT AS side, chr, cluster, sub FROM spl")
def _(v):
    return A.split_clusters(A.clusters(v.breakend)).select("aid", "side", "chr", "cluster", "sub")


@query("q_cluster_snap", _CLUSTERS + "SELECT aid, side::BIGINT AS side, CASE WHEN count(*) OVER w = 1 THEN coord WHEN strand = '+' THEN (sum(coord) OVER w // count(*) OVER w)::BIGINT - 1 ELSE (sum(coord) OVER w // count(*) OVER w)::BIGINT END AS new_coord FROM spl WINDOW w AS (PARTITION BY chr, cluster, sub)")
def _(v):
    return A.snapped(A.split_clusters(A.clusters(v.breakend))).select("aid", "side", "new_coord")


_MOVES = """WITH pos AS (SELECT chr, coord, strand, list(DISTINCT aid) AS aids FROM breakend GROUP BY ALL),
nxt AS (SELECT *, lead(coord) OVER w AS nc, lead(strand) OVER w AS ns, lead(aids) OVER w AS na FROM pos WINDOW w AS (PARTITION BY chr ORDER BY coord, (strand = '+')::INT)),
fit AS (SELECT *, coalesce(nc - coord <= 50 AND ns <> strand AND NOT list_has_any(aids, na), false) AS fits FROM nxt),
runs AS (SELECT *, sum(CASE WHEN fits THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY coord, (strand = '+')::INT) AS run FROM fit),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chr, run ORDER BY coord, (strand = '+')::INT) AS rk FROM runs WHERE fits),
mid AS (SELECT *, coord + (nc - coord) // 2 AS m FROM ranked WHERE rk % 2 = 1),
moves AS (SELECT chr, coord, strand, CASE WHEN strand = '+' THEN m ELSE m + 1 END AS new_coord FROM mid UNION ALL SELECT chr, nc, ns, CASE WHEN ns = '+' THEN m ELSE m + 1 END FROM mid)
"""


@query("q_reciprocal_moves", _MOVES + "SELECT * FROM moves")
def _(v):
    return A.reciprocal_moves(v.breakend)


@query("q_reciprocal_merge", _MOVES + "SELECT a.aid, a.chr1, coalesce(x.new_coord, a.coord1) AS coord1, a.strand1, a.chr2, coalesce(y.new_coord, a.coord2) AS coord2, a.strand2 FROM adj a LEFT JOIN moves x ON x.chr = a.chr1 AND x.coord = a.coord1 AND x.strand = a.strand1 LEFT JOIN moves y ON y.chr = a.chr2 AND y.coord = a.coord2 AND y.strand = a.strand2")
def _(v):
    return A.reciprocal(v.adj).select("aid", *ENDS)


#: Positions as often as adjacencies have them, numbered; what lies between two ends is looked up row by row.
_SHORT = """WITH pos AS (SELECT b.*, row_number() OVER (PARTITION BY chr ORDER BY coord, (strand = '+')::INT, b.aid, side) - 1 AS ix, a.chr1 <> a.chr2 AS tra FROM breakend b JOIN adj a USING (aid)),
last_ AS (SELECT chr, coord, strand, max(ix) AS ix FROM pos GROUP BY ALL),
one AS (SELECT min(aid) AS aid, chr1, coord1, strand1, chr2, coord2, strand2 FROM adj WHERE chr1 = chr2 AND abs(coord1 - coord2) <= {longest} {more} GROUP BY ALL),
ix AS (SELECT o.aid, o.chr1 AS chr, x.ix AS i1, y.ix AS i2 FROM one o JOIN last_ x ON x.chr = chr1 AND x.coord = coord1 AND x.strand = strand1 JOIN last_ y ON y.chr = chr2 AND y.coord = coord2 AND y.strand = strand2),
shared AS (SELECT chr, coord, strand, bool_or(NOT tra) AS same, bool_or(tra) AS tra FROM pos GROUP BY ALL),
btw AS (SELECT ix.aid, bool_or(s.same) AS same, bool_or(s.tra) AS tra FROM ix JOIN pos p ON p.chr = ix.chr AND p.ix > ix.i1 AND p.ix < ix.i2 JOIN shared s ON s.chr = p.chr AND s.coord = p.coord AND s.strand = p.strand GROUP BY ix.aid)
SELECT 'sl_' || ix.aid AS gid FROM ix LEFT JOIN btw USING (aid) WHERE i2 - i1 = 1 OR (i2 - i1 > 1 AND ({allow}))"""


@query("q_short_labeling", _SHORT.format(longest=50000, more="", allow="false"))
def _(v):
    return A.short_labelings(v.adj, 50000).select("gid")


@query("q_short_labeling_over_same", _SHORT.format(longest=20000, more="", allow="same"))
def _(v):
    return A.short_labelings(v.adj, 20000, over_same=True).select("gid")


@query("q_short_labeling_over_tra", _SHORT.format(longest=20000, more="", allow="tra"))
def _(v):
    return A.short_labelings(v.adj, 20000, over_tra=True).select("gid")


@query("q_short_labeling_strands", _SHORT.format(longest=50000, more="AND strand1 <> strand2", allow="same OR tra"))
def _(v):
    return A.short_labelings(v.adj, 50000, over_same=True, over_tra=True, inversions=False).select("gid")


@query("q_walk_adjacencies", """WITH p AS (SELECT chr, start, "end", lead(start) OVER (PARTITION BY chr ORDER BY i) AS n FROM seg) SELECT chr AS chr1, "end" AS coord1, chr AS chr2, n AS coord2 FROM p WHERE n IS NOT NULL""")
def _(v):
    walk = v.seg.select(F.lit("ref").alias("genome"), F.col("chr").alias("chrom"), F.col("i").alias("pos"), "chr", "start", "end", F.lit(False).alias("reversed"))
    return I.walk_adjacencies(walk).select("chr1", "coord1", "chr2", "coord2")


_ALIGNED = """WITH s2 AS (SELECT chr, start, "end", sid FROM seg2),
one AS (SELECT 'x' AS sample, chr, start, "end", sid FROM seg UNION ALL SELECT 'y', chr, start, "end", sid FROM s2),
gaps AS (SELECT *, lead(start) OVER w - "end" AS after, start - lag("end") OVER w AS ahead, lag("end") OVER w AS pe FROM one WINDOW w AS (PARTITION BY sample, chr ORDER BY start)),
fil AS (SELECT sample, chr, sid, CASE WHEN ahead >= 2 THEN pe + ahead // 2 + 1 ELSE start END AS start, CASE WHEN after >= 2 THEN "end" + after // 2 ELSE "end" END AS "end" FROM gaps),
ext AS (SELECT sample, chr, sid, CASE WHEN start = min(start) OVER (PARTITION BY sample, chr) THEN min(start) OVER (PARTITION BY chr) ELSE start END AS start, CASE WHEN "end" = max("end") OVER (PARTITION BY sample, chr) THEN max("end") OVER (PARTITION BY chr) ELSE "end" END AS "end" FROM fil),
cuts AS (SELECT DISTINCT chr, start - 1 AS c FROM ext UNION SELECT DISTINCT chr, "end" FROM ext),
st AS (SELECT e.sample, e.sid, e.chr, c.c + 1 AS start, e."end" AS fe FROM ext e JOIN cuts c ON c.chr = e.chr AND c.c >= e.start AND c.c < e."end" UNION ALL SELECT sample, sid, chr, start, "end" FROM ext),
pc AS (SELECT sample, sid AS fid, chr, start, coalesce(lead(start) OVER (PARTITION BY sample, sid ORDER BY start) - 1, fe) AS "end" FROM st)
"""


def _samples(v):
    segs = v.seg.select(F.lit("x").alias("sample"), "sid", "chr", "start", "end").unionByName(v.seg2.select(F.lit("y").alias("sample"), "sid", "chr", "start", "end"))
    cn = v.scnt.withColumn("sample", F.lit("x")).unionByName(v.scnt2b.withColumn("sample", F.lit("y")))
    return segs, cn


@query("q_align_two_samples", _ALIGNED + """SELECT sample, chr || ':' || start || '-' || "end" AS sid, chr, start, "end" FROM pc""")
def _(v):
    return I.aligned(*_samples(v))[0]


@query("q_align_two_scnt", _ALIGNED + """SELECT p.sample, p.chr || ':' || p.start || '-' || p."end" AS sid, t.clone, t.hap, t.cn FROM pc p JOIN (SELECT 'x' AS sample, * FROM scnt UNION ALL SELECT 'y', * FROM scnt2b) t ON t.sample = p.sample AND t.sid = p.fid""")
def _(v):
    return I.aligned(*_samples(v))[1]


# --- bounds


@query("q_bounds_fix", "SELECT sid, clone, hap, cn AS l, cn AS u FROM scnt")
def _(v):
    return T.bounds(v.scnt, v.seg, "fix")


@query("q_bounds_uniform", "SELECT sid, clone, hap, 0::BIGINT AS l, 10::BIGINT AS u FROM scnt")
def _(v):
    return T.bounds(v.scnt, v.seg, "uniform-min-max")


@query("q_bounds_spread", "SELECT sid, clone, hap, CASE WHEN cn > 0 THEN greatest(cn - 1, 1) ELSE 0 END AS l, cn + 1 AS u FROM scnt")
def _(v):
    return T.bounds(v.scnt, v.seg, "uniform-spread", zero_for_positive=(10**9, 10**9))


#: Segments of chromosomes x and y among others, 99,999 to 10,000,000 long, two rows of three without copy numbers.
_LONG = """lw AS (SELECT *, CASE i % 5 WHEN 0 THEN 99999 WHEN 1 THEN 100000 WHEN 2 THEN 999999 WHEN 3 THEN 1000000 ELSE 10000000 END AS w, CASE WHEN c = 21 THEN 'chrX' WHEN c = 22 THEN 'y' ELSE chr END AS name FROM seg),
ls AS (SELECT name || ':' || (i::BIGINT * 20000000 + 1) || '-' || (i::BIGINT * 20000000 + w) AS sid, name AS chr, w, c, i FROM lw),
lc AS (SELECT ls.sid, ls.chr, ls.w, cl.clone, h AS hap, CASE WHEN (c + i + kk + CASE h WHEN 'A' THEN 0 ELSE 1 END) % 3 = 0 THEN i % 6 END AS given FROM ls, cl, (VALUES ('A'), ('B')) x(h)),
lx AS (SELECT *, coalesce(given, 0) AS cn FROM lc)
"""


def _long(v):
    w = F.expr("CASE i % 5 WHEN 0 THEN 99999 WHEN 1 THEN 100000 WHEN 2 THEN 999999 WHEN 3 THEN 1000000 ELSE 10000000 END")
    seg = v.seg.select(F.expr("CASE WHEN c = 21 THEN 'chrX' WHEN c = 22 THEN 'y' ELSE chr END").alias("chr"), (F.col("i").cast("long") * 20_000_000 + 1).alias("start"), (F.col("i").cast("long") * 20_000_000 + w).alias("end"), "c", "i").withColumn("sid", M.segment_id())
    rows = seg.crossJoin(v.cl).select("*", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("hap"))
    given = rows.where("(c + i + kk + if(hap = 'A', 0, 1)) % 3 = 0").select("sid", "clone", "hap", (F.col("i") % 6).cast("long").alias("cn"))
    return seg, given


@query(
    "q_bounds_length",
    "WITH " + _LONG + """SELECT sid, clone, hap, CASE WHEN w < 100000 THEN 0 ELSE greatest(cn - s, 0) END AS l, CASE WHEN w < 100000 THEN 20 ELSE cn + s END AS u
    FROM (SELECT *, CASE WHEN w < 1000000 THEN 3 WHEN w < 10000000 THEN 2 ELSE 1 END AS s FROM lx)""",
)
def _(v):
    seg, given = _long(v)
    return T.bounds(given, seg, "length-spread")


@query(
    "q_bounds_guarded",
    "WITH " + _LONG + """SELECT sid, clone, hap, CASE WHEN chr = 'chrX' AND hap = 'B' THEN 0 WHEN cn = 1 AND w > 999999 THEN 1 ELSE greatest(cn - 1, 0) END AS l,
    CASE WHEN chr = 'chrX' AND hap = 'B' THEN 0 WHEN cn = 0 AND w < 100000 THEN 0 ELSE cn + 1 END AS u FROM lx""",
)
def _(v):
    seg, given = _long(v)
    return T.bounds(given, seg, "uniform-spread", zero_for_positive=(-1, 999_999), positive_for_zero=(100_000, 10**9), sex="m")


@query(
    "q_bound_violations",
    """WITH b AS (SELECT sid, clone, hap, cn AS l, cn + 1 AS u FROM scnt), t AS (SELECT s.sid, s.clone, s.hap, s.cn, CASE WHEN g.i % 2 = 0 THEN CASE s.hap WHEN 'A' THEN 'B' ELSE 'A' END ELSE s.hap END AS turned
    FROM scnt2 s JOIN seg g USING (sid)) SELECT DISTINCT t.clone, t.sid FROM t JOIN b ON b.sid = t.sid AND b.clone = t.clone AND b.hap = t.turned WHERE t.cn < l OR t.cn > u""",
)
def _(v):
    scnb = v.scnt.select("sid", "clone", "hap", F.col("cn").alias("l"), (F.col("cn") + 1).alias("u"))
    return T.bound_violations(v.scnt2, scnb, v.seg.where("i % 2 = 0").select("sid"))


@query(
    "q_extend_outermost",
    """WITH o AS (SELECT chr, c, min(start) AS first, max("end") AS last FROM seg GROUP BY chr, c), e AS (SELECT *, c % 3 * 1000 - 1500 AS low, 999000 + c % 4 * 3000 AS high FROM o WHERE c > 2)
    SELECT s.sid, CASE WHEN s.start = e.first AND s.start > low THEN greatest(low - 700, 0) ELSE s.start END AS start, CASE WHEN s."end" = e.last AND s."end" < high THEN high + 700 ELSE s."end" END AS "end" FROM seg s LEFT JOIN e USING (chr)""",
)
def _(v):
    ends = v.seg.where("c > 2").groupBy("chr", "c").agg(F.count("*")).select("chr", (F.col("c") % 3 * 1000 - 1500).alias("low"), (F.col("c") % 4 * 3000 + 999_000).alias("high"))
    return I.extended_outermost(v.seg, ends, 700).select("sid", "start", "end")


@query(
    "q_alignment_labelings",
    """WITH e AS (SELECT DISTINCT s.read, b.chr, b.coord, b.strand, b.aid, b.side, b.coord * 2 + CASE b.strand WHEN '+' THEN 1 ELSE 0 END AS o FROM support s JOIN breakend b USING (aid)),
    n AS (SELECT l.read, l.chr, l.o AS lo, min(r.o) AS ro FROM e l JOIN e r ON r.read = l.read AND r.chr = l.chr AND l.strand = '-' AND r.strand = '+' AND r.o > l.o GROUP BY ALL
      UNION SELECT r.read, r.chr, max(l.o), r.o FROM e l JOIN e r ON r.read = l.read AND r.chr = l.chr AND l.strand = '-' AND r.strand = '+' AND r.o > l.o GROUP BY r.read, r.chr, r.o)
    SELECT n.read, n.read || '_' || n.chr || '_' || lo // 2 || '_' || ro // 2 AS gid, string_agg(e.aid || ':' || e.side, ',' ORDER BY e.o, e.aid, e.side) AS ends FROM n JOIN e ON e.read = n.read AND e.chr = n.chr AND e.o IN (lo, ro) GROUP BY ALL""",
)
def _(v):
    aligned, support = step_queries._aligned(v)
    ends = F.zip_with("aids", "agl", lambda a, s: F.concat(a, F.lit(":"), s.cast("string")))
    return GR.alignment_labelings(v.breakend, aligned, support=support).select("read", "gid", F.array_join(ends, ",").alias("ends"))


# --- set operations


@query("q_cat_unique", "SELECT aid, chr1, coord1 FROM adj")
def _(v):
    return A.concatenated([v.adj.where("k % 2 = 0"), v.adj.withColumn("coord1", F.when(F.col("k") % 2 == 0, F.col("coord1") + 1).otherwise(F.col("coord1")))], unique="skip").select("aid", "chr1", "coord1")


@query("q_cat_all", "SELECT aid, chr1, coord1 FROM adj UNION ALL SELECT aid, chr1, coord1 FROM adj WHERE k % 2 = 0")
def _(v):
    return A.concatenated([v.adj, v.adj.where("k % 2 = 0")]).select("aid", "chr1", "coord1")


_EDGES = """ed AS (SELECT DISTINCT chr1 || ':' || strand1 || coord1 AS u, chr2 || ':' || strand2 || coord2 AS v, k FROM adj)
"""


@query("q_edge_intersection", "WITH " + _EDGES + "SELECT u, v FROM ed WHERE k % 2 = 0 INTERSECT SELECT u, v FROM ed WHERE k % 3 = 0")
def _(v):
    return G.common_edges(G.adjacency_edges(v.adj.where("k % 2 = 0")), G.adjacency_edges(v.adj.where("k % 3 = 0")))


@query("q_edge_complements", "WITH " + _EDGES + "(SELECT u, v, 1::BIGINT AS only FROM ed WHERE k % 2 = 0 EXCEPT SELECT u, v, 1 FROM ed WHERE k % 3 = 0) UNION ALL (SELECT u, v, 2 FROM ed WHERE k % 3 = 0 EXCEPT SELECT u, v, 2 FROM ed WHERE k % 2 = 0)")
def _(v):
    return G.edge_differences(G.adjacency_edges(v.adj.where("k % 2 = 0")), G.adjacency_edges(v.adj.where("k % 3 = 0")))


# --- graph

_BALANCE = """half AS (
  SELECT t.clone, s.chr || ':-' || s.start AS node, t.cn FROM seg s JOIN scnt t USING (sid) UNION ALL SELECT t.clone, s.chr || ':+' || s."end", t.cn FROM seg s JOIN scnt t USING (sid)
  UNION ALL SELECT c.clone, a.chr1 || ':' || a.strand1 || a.coord1, -c.cn FROM adj a JOIN acnt c USING (aid) UNION ALL SELECT c.clone, a.chr2 || ':' || a.strand2 || a.coord2, -c.cn FROM adj a JOIN acnt c USING (aid)),
bal AS (SELECT clone, node, sum(cn)::BIGINT AS imbalance FROM half WHERE cn <> 0 GROUP BY clone, node)
"""


def _edges(v):
    s = v.seg.join(v.scnt, "sid")
    return G.segment_edges(s, "clone", "cn").unionByName(G.adjacency_edges(v.adj.join(v.acnt, "aid"), "clone", "cn"))


@query("q_node_imbalance", "WITH " + _BALANCE + "SELECT * FROM bal")
def _(v):
    return G.imbalance(_edges(v), ["clone"])


@query("q_telomeres", "WITH " + _BALANCE + "SELECT * FROM bal WHERE imbalance > 0")
def _(v):
    return G.telomeres(_edges(v), ["clone"])


@query("q_balance_violations", "WITH " + _BALANCE + "SELECT * FROM bal WHERE imbalance < 0")
def _(v):
    return G.balance_violations(_edges(v), ["clone"])


@query("q_chromosome_count", "WITH " + _BALANCE + "SELECT clone, trunc(sum(imbalance) / 2)::BIGINT AS chromosomes FROM bal GROUP BY clone")
def _(v):
    return G.chromosome_counts(_edges(v), ["clone"])


@query("q_nonzero_edges", """SELECT s.chr || ':-' || s.start AS u, s.chr || ':+' || s."end" AS v, 'S' AS kind, t.clone, t.cn FROM seg s JOIN scnt t USING (sid) WHERE t.cn <> 0
    UNION ALL SELECT a.chr1 || ':' || a.strand1 || a.coord1, a.chr2 || ':' || a.strand2 || a.coord2, 'N', c.clone, c.cn FROM adj a JOIN acnt c USING (aid) WHERE c.cn <> 0""")
def _(v):
    return FL.drop_zero_copies(_edges(v))


@query("q_novel_degrees", "WITH " + _EDGES + "SELECT node, count(*) AS degree FROM (SELECT DISTINCT u AS node, u, v FROM ed UNION SELECT DISTINCT v, u, v FROM ed) GROUP BY node")
def _(v):
    return G.novel_degrees(G.adjacency_edges(v.adj).distinct())


@query("q_exclusivity_violations", "WITH " + _EDGES + "SELECT node, count(*) AS degree FROM (SELECT DISTINCT u AS node, u, v FROM ed UNION SELECT DISTINCT v, u, v FROM ed) GROUP BY node HAVING count(*) > 1")
def _(v):
    return G.exclusivity_violations(G.adjacency_edges(v.adj).distinct())


@query("q_graph_counts", _CUTS + "SELECT 'S' AS kind, count(*) AS n FROM cutseg UNION ALL SELECT 'R', (SELECT count(*) FROM (SELECT lead(start) OVER (PARTITION BY chr ORDER BY start) AS n FROM cutseg) WHERE n IS NOT NULL)")
def _(v):
    cut = I.cut_segments(v.seg, v.breakend)
    return G.graph(cut, I.reference_adjacencies(cut)).groupBy("kind").agg(F.count("*").alias("n"))


_CHAINED = """ch AS (SELECT chr1 || ':' || (coord1 // 500) AS u, chr2 || ':' || (coord2 // 500) AS v FROM adj),
sym AS (SELECT u, v FROM ch UNION SELECT v, u FROM ch UNION SELECT u, u FROM ch UNION SELECT v, v FROM ch),
reach(node, other) AS (SELECT u, v FROM sym UNION SELECT r.node, s.v FROM reach r JOIN sym s ON r.other = s.u)
"""


@query("q_components", "WITH RECURSIVE " + _CHAINED + "SELECT node, min(other) AS component FROM reach GROUP BY node")
def _(v):
    bin_ = lambda k: F.concat(f"chr{k}", F.lit(":"), F.floor(F.col(f"coord{k}") / 500).cast("string"))
    return connected_components(v.adj.select(bin_(1).alias("u"), bin_(2).alias("v")), "u", "v")


_SIGNATURES = """pl AS (SELECT aid, chr1 || ':' || CASE WHEN strand1 = '+' THEN c1 ELSE c1 - 1 END AS u, chr2 || ':' || CASE WHEN strand2 = '+' THEN c2 ELSE c2 - 1 END AS v FROM (SELECT aid, chr1, strand1, chr2, strand2, coord1 // 500 AS c1, coord2 // 500 AS c2 FROM adj)),
sym AS (SELECT u, v FROM pl UNION SELECT v, u FROM pl UNION SELECT u, u FROM pl UNION SELECT v, v FROM pl),
reach(node, other) AS (SELECT u, v FROM sym UNION SELECT r.node, s.v FROM reach r JOIN sym s ON r.other = s.u),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
"""


@query("q_complex_signatures", "WITH RECURSIVE " + _SIGNATURES + "SELECT c.component AS signature, string_agg(DISTINCT p.aid, ',' ORDER BY p.aid) AS aids, k.k FROM pl p JOIN comp c ON c.node = p.u JOIN (SELECT component, count(*) AS k FROM comp GROUP BY component HAVING count(*) >= 3) k ON k.component = c.component GROUP BY c.component, k.k")
def _(v):
    binned = v.adj.select("aid", "chr1", F.floor(F.col("coord1") / 500).cast("long").alias("coord1"), "strand1", "chr2", F.floor(F.col("coord2") / 500).cast("long").alias("coord2"), "strand2")
    return G.complex_signatures(binned).select("signature", F.array_join("aids", ",").alias("aids"), "k")


_PHASED = """pe AS (SELECT DISTINCT a.chr1 AS chr, a.coord1 AS coord, a.strand1 AS strand, c.phasing[1] AS hap FROM adj a JOIN acnt c USING (aid) WHERE c.cn > 0 UNION SELECT DISTINCT a.chr2, a.coord2, a.strand2, c.phasing[2] FROM adj a JOIN acnt c USING (aid) WHERE c.cn > 0),
pb AS (SELECT chr, coord // 500 AS coord, strand, hap FROM pe)
"""


def _phased(v):
    return G.phased_ends(v.adj.select("aid", *ENDS), v.acnt).withColumn("coord", F.floor(F.col("coord") / 500).cast("long"))


@query("q_homologous_exclusivity", "WITH " + _PHASED + "SELECT chr, coord, strand FROM pb GROUP BY ALL HAVING count(DISTINCT hap) > 1")
def _(v):
    return G.homologous_violations(_phased(v))


@query("q_reciprocal_exclusivity", "WITH " + _PHASED + "SELECT DISTINCT p.chr, p.coord AS left, p.hap AS left_hap, m.hap AS right_hap FROM pb p JOIN pb m ON p.chr = m.chr AND p.strand = '+' AND m.strand = '-' AND m.coord - 1 = p.coord AND p.hap <> m.hap".replace("AS left,", 'AS "left",'))
def _(v):
    return G.reciprocal_violations(_phased(v))


# --- groups


@query("q_molecule_groups", "SELECT read AS gid, string_agg(DISTINCT aid, ',' ORDER BY aid) AS aids FROM support GROUP BY read HAVING count(DISTINCT aid) >= 2")
def _(v):
    return GR.molecule_groups(v.support).select("gid", F.array_join("aids", ",").alias("aids"))


_LABELS = """lm AS (SELECT gid, pos, CASE WHEN m.side = 0 THEN a.chr1 || ':' || a.strand1 || a.coord1 ELSE a.chr2 || ':' || a.strand2 || a.coord2 END AS node FROM member m JOIN adj a USING (aid) WHERE agt = 'L'),
lk AS (SELECT gid, node AS u, lead(node) OVER (PARTITION BY gid ORDER BY pos) AS v FROM lm)
"""


@query("q_labeling_links", "WITH " + _LABELS + "SELECT gid, u, v FROM lk WHERE v IS NOT NULL")
def _(v):
    return GR.labeling_links(v.groups(), v.adj)


@query("q_group_violations_m", """WITH cl2 AS (SELECT DISTINCT clone FROM acnt), pr AS (SELECT aid, clone, (sum(cn) > 0)::INT AS there FROM acnt GROUP BY aid, clone),
sh AS (SELECT m.gid, m.fp, c.clone, 1 - avg(coalesce(p.there, 0)) AS absent FROM member m CROSS JOIN cl2 c LEFT JOIN pr p ON p.aid = m.aid AND p.clone = c.clone WHERE m.agt = 'M' GROUP BY ALL)
SELECT gid, round(min(absent), 9) AS best FROM sh GROUP BY gid, fp HAVING min(absent) > fp + 1e-9""")
def _(v):
    return GR.molecule_violations(v.groups(), v.acnt).select("gid", F.round("best", 9).alias("best"))


@query("q_group_violations_n", """WITH pr AS (SELECT aid, (sum(cn) > 0)::INT AS there FROM acnt GROUP BY aid)
SELECT m.gid, round(1 - avg(coalesce(p.there, 0)), 9) AS absent FROM member m LEFT JOIN pr p ON p.aid = m.aid WHERE m.agt = 'N' GROUP BY m.gid, m.fp HAVING 1 - avg(coalesce(p.there, 0)) > m.fp + 1e-9""")
def _(v):
    return GR.general_violations(v.groups(), v.acnt).select("gid", F.round("absent", 9).alias("absent"))


@query("q_group_violations_l", "SELECT m.gid FROM member m JOIN acnt c USING (aid) WHERE m.agt = 'L' AND c.cn > 0 GROUP BY m.gid HAVING count(DISTINCT CASE WHEN m.side = 0 THEN c.phasing[1] ELSE c.phasing[2] END) > 1")
def _(v):
    return GR.labeling_violations(v.groups(), v.acnt)


# --- order-dependent merging: no SQL, held against brute force in tests


@query("q_merger")
def _(v):
    clusters, members = MG.merged(v.adj.withColumn("ord", F.col("k")), 20000)
    return members.join(clusters, "mid").select("aid", "mid", *ENDS, "n")


# --- integer program


def _inputs(v):
    from lociflow.operators import milp

    cut = written(I.cut_segments(v.seg, v.breakend), "segments")
    refs = I.reference_adjacencies(cut).select("aid", *ENDS, "at")
    ends = cut.select(F.explode(F.array(*(M.position_id("chr", x, F.lit(s)) for x, s in (("start", "-"), ("end", "+"))))).alias("node")).distinct()
    held = A.breakends(v.adj).withColumn("node", M.position_id("chr", "coord", "strand")).join(ends, "node", "left_semi").groupBy("aid").agg(F.count("*").alias("n")).where("n = 2").select("aid")
    adj = written(v.adj.select("aid", *ENDS, "at").join(held, "aid", "left_semi").unionByName(refs), "adjacencies")
    scnt = written(v.scnt, "copies", rows=1)  # some thousands of rows
    cn = cut.select("sid", "fid").join(scnt.withColumnRenamed("sid", "fid"), "fid").select("sid", "clone", "hap", "cn")
    bounds = T.bounds(cn, cut, "uniform-min-max")
    return milp.Inputs(cut, cn, bounds, adj, I.reference_telomeres(v.seg))


_MODEL = _CUTS + """, refs AS (SELECT 'r' || row_number() OVER (ORDER BY chr, start, "end") AS aid, chr AS chr1, "end" AS coord1, '+' AS strand1, chr AS chr2, n AS coord2, '-' AS strand2, 'R' AS "at" FROM (SELECT *, lead(start) OVER (PARTITION BY chr ORDER BY start, "end") AS n FROM cutseg) WHERE n IS NOT NULL),
ends AS (SELECT chr, start AS coord, '-' AS strand FROM cutseg UNION SELECT chr, "end", '+' FROM cutseg),
ok AS (SELECT aid FROM breakend b JOIN ends USING (chr, coord, strand) GROUP BY aid HAVING count(*) = 2),
al AS (SELECT aid, chr1, coord1, strand1, chr2, coord2, strand2, "at" FROM adj JOIN ok USING (aid) UNION ALL SELECT * FROM refs)
"""


@query("q_milp_var_counts", _MODEL + """, n AS (SELECT (SELECT count(DISTINCT fid) FROM cutseg) AS f, 2 AS c, (SELECT count(*) FROM cutseg) AS s, (SELECT count(*) FROM al WHERE "at" = 'R') AS r, (SELECT count(*) FROM al WHERE "at" = 'N') AS nv)
SELECT 'acn' AS kind, c * 4 * (r + nv) AS n FROM n UNION ALL SELECT 'cn', c * 2 * s FROM n UNION ALL SELECT 'delta', c * 2 * s FROM n UNION ALL SELECT 'flip', f FROM n UNION ALL SELECT 'ncn', c * nv FROM n UNION ALL SELECT 'overall', 4 * (r + nv) FROM n UNION ALL SELECT 'present', c * 4 * (r + nv) FROM n UNION ALL SELECT 'rcn', c * 4 * r FROM n""")
def _(v):
    from lociflow.operators import milp

    return milp.variables(_inputs(v)).groupBy(F.substring_index("name", "|", 1).alias("kind")).agg(F.count("*").alias("n"))


@query("q_milp_balance_rows", _MODEL + """, tel AS (SELECT chr, min(start) AS coord, '-' AS strand FROM seg GROUP BY chr UNION ALL SELECT chr, max("end"), '+' FROM seg GROUP BY chr)
SELECT 'node|' || c.clone || '|' || e.chr || ':' || e.strand || e.coord || '|' || h.hap AS row, CASE WHEN t.chr IS NOT NULL THEN '>=' ELSE '=' END AS sense FROM ends e CROSS JOIN cl c CROSS JOIN (VALUES ('A'), ('B')) h(hap) LEFT JOIN tel t USING (chr, coord, strand)""")
def _(v):
    from lociflow.operators import milp

    return milp.balance_rows(_inputs(v))[0][0].select("row", "sense")


@query("q_milp_delta_rows", _MODEL + "SELECT k || h || '|' || c.clone || '|' || s.sid AS row FROM cutseg s CROSS JOIN cl c CROSS JOIN (VALUES ('A'), ('B')) h(h) CROSS JOIN (VALUES ('over'), ('under')) k(k)")
def _(v):
    from lociflow.operators import milp

    parts = milp.delta_rows(_inputs(v))
    out = parts[0][0]
    for x, _ in parts[1:]:
        out = out.unionByName(x)
    return out.select("row")


from lociflow.plans import io_queries, model_queries, step_queries, stream_queries  # noqa: E402, F401  (registers their queries)
