"""The interval adjacency graph as an edge table: ``(u, v, kind, cn)``, kind S (segment), R or N (adjacency).

A node is a position's text (chr:strandcoord, with the haplotype before the strand in haplotype-specific graphs).
Clone-specific tables have a ``clone`` column beside; it is carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions.model import HAPLOTYPES, c, position_id
from lociflow.operators.components import connected_components


def segment_edges(segments: DataFrame, *keep: str) -> DataFrame:
    return segments.select(position_id("chr", "start", F.lit("-")).alias("u"), position_id("chr", "end", F.lit("+")).alias("v"), F.lit("S").alias("kind"), *keep)


def adjacency_edges(adjacencies: DataFrame, *keep: str, at: Column | str = "at") -> DataFrame:
    return adjacencies.select(position_id("chr1", "coord1", "strand1").alias("u"), position_id("chr2", "coord2", "strand2").alias("v"), c(at).alias("kind"), *keep)


def graph(segments: DataFrame, adjacencies: DataFrame) -> DataFrame:
    """Distinct edges. An adjacency whose end is no segment's end is an error."""
    own = segment_edges(segments).distinct()
    others = adjacency_edges(adjacencies).distinct()
    nodes = own.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if lost := others.select(F.explode(F.array("u", "v")).alias("node")).join(nodes, "node", "left_anti").first():
        raise ValueError(f"no segment ends at {lost['node']}")
    return own.unionByName(others)


def half_edges(edges: DataFrame, *keep: str) -> DataFrame:
    """Each edge at both its ends; a loop stands twice at its node."""
    return edges.select(F.explode(F.array("u", "v")).alias("node"), "kind", *keep)


def proper_topology(edges: DataFrame) -> DataFrame:
    """``(node, n)`` of nodes that don't have exactly one segment edge; none in a proper graph."""
    n = F.sum(F.when(F.col("kind") == "S", 1).otherwise(0))
    return half_edges(edges).groupBy("node").agg(n.alias("n")).where("n <> 1")


def novel_degrees(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'N'").select(F.explode(F.array_distinct(F.array("u", "v"))).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def exclusivity_violations(edges: DataFrame, most: int = 1) -> DataFrame:
    """Nodes with more than ``most`` novel edges."""
    return novel_degrees(edges).where(F.col("degree") > most)


def imbalance(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Copies of a node's segment less those of its adjacencies, a loop counting twice."""
    by = by or []
    signed = F.when(F.col("kind") == "S", F.col("cn")).otherwise(-F.col("cn"))
    return half_edges(edges.where("cn <> 0"), *by, "cn").groupBy(*by, "node").agg(F.sum(signed).cast("long").alias("imbalance"))


def telomeres(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    return imbalance(edges, by).where("imbalance > 0")


def balance_violations(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    return imbalance(edges, by).where("imbalance < 0")


def chromosome_counts(edges: DataFrame, by: list[str]) -> DataFrame:
    """Half the sum of imbalances."""
    return imbalance(edges, by).groupBy(*by).agg((F.sum("imbalance") / 2).cast("long").alias("chromosomes"))


def edge_components(edges: DataFrame, kinds: tuple[str, ...] = ("R", "N")) -> DataFrame:
    return connected_components(edges.where(F.col("kind").isin(*kinds)), "u", "v")


def common_edges(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.select("u", "v").intersect(two.select("u", "v"))


def edge_differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """``(u, v, only)``: edges of just the first or second."""
    a, b = one.select("u", "v"), two.select("u", "v")
    return a.subtract(b).withColumn("only", F.lit(1)).unionByName(b.subtract(a).withColumn("only", F.lit(2)))


def topology_matches(edges: DataFrame, genome: DataFrame, exact: bool = True) -> bool:
    """Whether a genome's edges are just those of the graph, or with ``exact=False`` among them."""
    a, b = edges.select("u", "v"), genome.select("u", "v")
    return b.subtract(a).isEmpty() and (not exact or a.subtract(b).isEmpty())


def from_genomes(reference: DataFrame, mutants: DataFrame) -> DataFrame:
    """Adjacencies of reference and mutant walks, once each: R if the reference has it, else N."""
    key = [f"{f}{k}" for k in (1, 2) for f in ("chr", "coord", "strand")]
    r = reference.select(*key).distinct()
    return r.withColumn("at", F.lit("R")).unionByName(mutants.select(*key).distinct().join(r, key, "left_anti").withColumn("at", F.lit("N")))


def with_copies(edges: DataFrame, profile: DataFrame, on: list[str]) -> DataFrame:
    """Edges with the copies of a profile, 0 where it has none."""
    return edges.drop("cn").join(profile, on, "left").withColumn("cn", F.coalesce("cn", F.lit(0)))


def matches_profile(edges: DataFrame, profile: DataFrame, on: list[str]) -> bool:
    """Whether edges and profile have equal copies, absent ones being 0."""
    other = profile.select(*on, F.col("cn").alias("__cn"))
    return edges.join(other, on, "full").where(F.coalesce("cn", F.lit(0)) != F.coalesce("__cn", F.lit(0))).isEmpty()


def represents_a_genome(edges: DataFrame) -> bool:
    """All copies are known and no node has more of adjacencies than of its segment."""
    return edges.where("cn is null").isEmpty() and balance_violations(edges).isEmpty()


def inflated(segments: DataFrame, adjacencies: DataFrame) -> DataFrame:
    """Haplotype-specific edges: segments on A and B, reference adjacencies AA and BB, novel ones in all four phasings."""
    node = lambda k, h: F.concat(F.col(f"chr{k}"), F.lit(":"), h, F.lit(":"), F.col(f"strand{k}"), F.col(f"coord{k}").cast("string"))
    haps = F.explode(F.array(*map(F.lit, HAPLOTYPES))).alias("h")
    s = segments.select("*", haps).select(position_id("chr", "start", F.lit("-"), "h").alias("u"), position_id("chr", "end", F.lit("+"), "h").alias("v"), F.lit("S").alias("kind"), F.concat("h", "h").alias("phasing"))
    ph = F.explode(F.when(F.col("at") == "R", F.array(F.lit("AA"), F.lit("BB"))).otherwise(F.array(*map(F.lit, ("AA", "AB", "BA", "BB"))))).alias("p")
    a = adjacencies.select("*", ph)
    a = a.select(node(1, F.substring("p", 1, 1)).alias("u"), node(2, F.substring("p", 2, 1)).alias("v"), F.col("at").alias("kind"), F.col("p").alias("phasing"))
    return s.unionByName(a)


def phased_ends(adjacencies: DataFrame, acnt: DataFrame) -> DataFrame:
    """``(clone, aid, side, chr, coord, strand, hap, cn)`` of phased adjacencies that have copies."""
    rows = acnt.where("cn > 0").join(adjacencies, "aid")
    ends = F.posexplode(F.array(*(F.struct(F.col(f"chr{k}").alias("chr"), F.col(f"coord{k}").alias("coord"), F.col(f"strand{k}").alias("strand"), F.substring("phasing", k, 1).alias("hap")) for k in (1, 2)))).alias("side", "e")
    return rows.select("clone", "aid", "cn", ends).select("clone", "aid", "side", "e.*", "cn")


def homologous_violations(ends: DataFrame) -> DataFrame:
    """Positions with novel adjacencies on both haplotypes."""
    return ends.groupBy("chr", "coord", "strand").agg(F.count_distinct("hap").alias("haps")).where("haps > 1").drop("haps")


def reciprocal_violations(ends: DataFrame) -> DataFrame:
    """Pairs (position on -, + before it) that novel adjacencies use on different haplotypes."""
    own = ends.select("chr", "coord", "strand", "hap").distinct()
    plus = own.where("strand = '+'").select("chr", F.col("coord").alias("left"), F.col("hap").alias("left_hap"))
    minus = own.where("strand = '-'").select("chr", (F.col("coord") - 1).alias("left"), F.col("hap").alias("right_hap"))
    return plus.join(minus, ["chr", "left"]).where("left_hap <> right_hap").select("chr", "left", "left_hap", "right_hap")


def complex_signatures(adjacencies: DataFrame, least: int = 3) -> DataFrame:
    """``(signature, aids, k)``: novel adjacencies that share reference locations; a location is named by its + side.

    ``k`` counts the locations; signatures of fewer than ``least`` are left out. Named by the smallest location.
    """
    place = lambda k: F.concat(F.col(f"chr{k}"), F.lit(":"), F.when(F.col(f"strand{k}") == "+", F.col(f"coord{k}")).otherwise(F.col(f"coord{k}") - 1).cast("string"))
    e = adjacencies.select("aid", place(1).alias("u"), place(2).alias("v"))
    comp = connected_components(e, "u", "v")
    k = comp.groupBy("component").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    aids = e.join(comp, e["u"] == comp["node"]).groupBy("component").agg(F.array_sort(F.collect_set("aid")).alias("aids"))
    return k.join(aids, "component").select(F.col("component").alias("signature"), "aids", "k")
