"""Histograms, pivots and densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions.model import FAR, segment_length
from lociflow.operators.intervals import cut_segments

#: Left edges of the length report, and inner edges of the survey of merged sources.
LENGTH_EDGES = (-1, 0, 50, 100, 200, 400, 600, 800, 1000, 2500, 5000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 10_000_000, 500_000_000)
SOURCE_EDGES = (1, 100, 200, 300, 400, 500, 750, 1000, 2000, 5000, 10_000, 50_000, 100_000, 500_000)


def first_edge_above(value: Column, edges: tuple[int, ...]) -> Column:
    """The first edge that the value lies below; FAR beyond all."""
    out = F.lit(FAR)
    for e in reversed(edges):
        out = F.when(value < e, F.lit(e)).otherwise(out)
    return out.cast("long")


def length_bins(adjacencies: DataFrame, by: Column, size: Column, edges: tuple[int, ...] = LENGTH_EDGES) -> DataFrame:
    return adjacencies.groupBy(by.alias("annotation"), first_edge_above(size, edges).alias("below")).agg(F.count("*").alias("n"))


def source_tally(adjacencies: DataFrame, sources: str, size: Column, edges: tuple[int, ...] = SOURCE_EDGES, pivot: bool = True) -> DataFrame:
    """Counts by the sorted set of sources and size bin; with ``pivot`` a column for each bin, 0 where empty."""
    names = F.array_join(F.array_sort(F.array_distinct(F.split(sources, ","))), ",")
    rows = adjacencies.select(names.alias("sources"), first_edge_above(size, edges).alias("below"))
    if not pivot:
        return rows.groupBy("sources", "below").agg(F.count("*").alias("n"))
    wide = rows.groupBy("sources").pivot("below", [*edges, FAR]).count()
    return wide.select("sources", *[F.coalesce(F.col(f"`{e}`"), F.lit(0)).cast("long").alias(f"below_{e}") for e in (*edges, FAR)])


def read_support(support: DataFrame) -> DataFrame:
    """``(adjacencies, reads)``: how many reads support so many adjacencies."""
    per = support.groupBy("read").agg(F.count_distinct("aid").alias("adjacencies"))
    return per.groupBy("adjacencies").agg(F.count("*").alias("reads"))


def source_cooccurrence(adjacencies: DataFrame, sources: str) -> DataFrame:
    """``(one, two, n)``: rows that name both sources, one <= two."""
    s = F.array_distinct(F.split(sources, ","))
    pairs = F.flatten(F.transform(s, lambda x: F.transform(F.filter(s, lambda y: y >= x), lambda y: F.struct(x.alias("one"), y.alias("two")))))
    return adjacencies.select(F.explode(pairs).alias("p")).groupBy("p.one", "p.two").agg(F.count("*").alias("n"))


def origin_sources(adjacencies: DataFrame, origins: str, pattern: str) -> DataFrame:
    """``(sources, n)``: multisets of sources, read from merged rows' origin ids by the pattern's first group."""
    own = F.array_sort(F.transform(F.split(origins, ","), lambda x: F.regexp_extract(x, "^(?:" + pattern + ")", 1)))
    return adjacencies.groupBy(F.array_join(own, ",").alias("sources")).agg(F.count("*").alias("n"))


def capped_support(support: DataFrame, most: int = 30) -> DataFrame:
    per = support.groupBy("aid").agg(F.count_distinct("read").alias("reads"))
    return per.groupBy(F.least("reads", F.lit(most)).alias("reads")).agg(F.count("*").alias("adjacencies"))


def origin_support(merged: DataFrame, support: DataFrame, origins: str = "origin_ids") -> DataFrame:
    """``(aid, mean_reads)``: the truncated mean of the reads of a merged adjacency's origins."""
    one = merged.select(F.col("aid").alias("maid"), F.explode(F.split(origins, ",")).alias("aid"))
    per = support.groupBy("aid").agg(F.count_distinct("read").alias("reads"))
    return one.join(per, "aid").groupBy(F.col("maid").alias("aid")).agg(F.floor(F.avg("reads")).cast("long").alias("mean_reads"))


def window_of(coord: Column, width: int) -> Column:
    return F.floor((coord - 1) / width).cast("long")


def breakend_density(ends: DataFrame, width: int = 10**7) -> DataFrame:
    return ends.groupBy("chr", window_of(F.col("coord"), width).alias("win")).agg(F.count("*").alias("n"))


def adjacency_density(adjacencies: DataFrame, width: int = 10**7, full: bool = False) -> DataFrame:
    """Adjacencies by the windows that hold an end, each once a window; with ``full`` those with both ends in it."""
    place = lambda k: F.struct(F.col(f"chr{k}").alias("chr"), window_of(F.col(f"coord{k}"), width).alias("win"))
    if full:
        rows = adjacencies.where(place(1) == place(2)).select(place(1).alias("p"))
    else:
        rows = adjacencies.select(F.explode(F.array_distinct(F.array(place(1), place(2)))).alias("p"))
    return rows.groupBy("p.chr", "p.win").agg(F.count("*").alias("n"))


def altered_fractions(segments: DataFrame, scnt: DataFrame, width: int = 10**7, haploid: bool = False) -> DataFrame:
    """``(chr, win, clone, ampl, del)``: the share of a window that lies in segments with more, or fewer, copies than the base
    (2 in all, or with haplotypes 1 of either). Segments are cut at the windows' edges."""
    edges = segments.select("chr", F.explode(F.sequence(window_of(F.col("start"), width), window_of(F.col("end"), width))).alias("w"))
    points = edges.select("chr", ((F.col("w") + 1) * width).alias("coord"), F.lit("+").alias("strand")).distinct()
    pieces = cut_segments(segments, points)
    of = lambda h: F.sum(F.when(F.col("hap") == h, F.col("cn")).otherwise(0))
    cn = scnt.groupBy(F.col("sid").alias("fid"), "clone").agg(of("A").alias("a"), of("B").alias("b"))
    rows = pieces.join(cn, "fid")
    up, down = ((F.col("a") + F.col("b") > 2), (F.col("a") + F.col("b") < 2)) if haploid else ((F.col("a") > 1) | (F.col("b") > 1), (F.col("a") < 1) | (F.col("b") < 1))
    share = lambda x: F.sum(F.when(x, segment_length()).otherwise(0)) / F.lit(width)
    return rows.groupBy("chr", window_of(F.col("start"), width).alias("win"), "clone").agg(share(up).alias("ampl"), share(down).alias("del"))


def translocation_fraction(adjacencies: DataFrame) -> DataFrame:
    return adjacencies.agg(F.avg((F.col("chr1") != F.col("chr2")).cast("int")).alias("fraction"))


def absent_fraction(acnt: DataFrame) -> DataFrame:
    """Share of adjacencies without a copy in any clone."""
    per = acnt.groupBy("aid").agg((F.sum("cn") > 0).cast("int").alias("there"))
    return per.agg((1 - F.avg("there")).alias("absent"))


def absent_adjacencies(adjacencies: DataFrame, acnt: DataFrame) -> DataFrame:
    """Adjacencies without a copy in any clone, or without any row of copies."""
    there = acnt.groupBy("aid").agg(F.max("cn").alias("most")).where("most > 0").select("aid")
    return adjacencies.join(there, "aid", "left_anti")


def karyotype_counts(segments: DataFrame, adjacencies: DataFrame) -> DataFrame:
    """``(what, name, n)``: segments by chromosome, adjacencies by type."""
    s = segments.groupBy(F.lit("segments").alias("what"), F.col("chr").alias("name")).agg(F.count("*").alias("n"))
    return s.unionByName(adjacencies.groupBy(F.lit("adjacencies").alias("what"), F.col("at").alias("name")).agg(F.count("*").alias("n")))
