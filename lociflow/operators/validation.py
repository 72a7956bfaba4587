"""A karyotype checked as a whole: sizes, groups, balance and telomeres in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions.model import position_id, segment_length
from lociflow.operators.graph import phased_ends
from lociflow.operators.groups import general_violations, labeling_violations, molecule_violations
from lociflow.operators.intervals import reference_telomeres
from lociflow.shared import cut

ENDS = ("chr1", "coord1", "strand1", "chr2", "coord2", "strand2")


def excess(segments: DataFrame, adjacencies: DataFrame, scnt: DataFrame, acnt: DataFrame) -> DataFrame:
    """``(clone, chr, coord, strand, hap, excess)``: per clone and haplotype the copies of a segment at its end less those of the adjacencies there."""
    ends = F.explode(F.array(F.struct(F.col("start").alias("coord"), F.lit("-").alias("strand")), F.struct(F.col("end").alias("coord"), F.lit("+").alias("strand")))).alias("e")
    own = segments.join(scnt, "sid").select("clone", "chr", "hap", "cn", ends).select("clone", "chr", "e.coord", "e.strand", "hap", "cn")
    used = phased_ends(adjacencies.select("aid", *ENDS), acnt).select("clone", "chr", "coord", "strand", "hap", (-F.col("cn")).alias("cn"))
    return own.unionByName(used).groupBy("clone", "chr", "coord", "strand", "hap").agg(F.sum("cn").cast("long").alias("excess"))


def karyotype_report(segments: DataFrame, adjacencies: DataFrame, scnt: DataFrame, acnt: DataFrame, groups: DataFrame | None = None, telomeres: DataFrame | None = None) -> DataFrame:
    """``(what, clone, name, value)``: counts of ``chromosomes``, ``segments`` by chromosome and ``adjacencies`` by type; ``length`` and
    ``chromosome_count`` (half the sum of the excess) of a clone; and what is wrong: ``molecule_group``, ``labeling_group`` and
    ``general_group`` that the copies break, ``negative_excess`` at a segment's end and haplotype, and each ``unexpected_telomere``, a position
    with an excess that isn't among ``telomeres`` (those of the segments by default)."""
    telomeres = reference_telomeres(segments) if telomeres is None else telomeres
    none = F.lit(None).cast("string")
    row = lambda rows, what, value: rows.select(F.lit(what).alias("what"), *(F.col(x).alias(x) if x in rows.columns else none.alias(x) for x in ("clone", "name")), value.cast("double").alias("value"))
    count = lambda rows, what, *by: row(rows.groupBy(*by).agg(F.count("*").alias("n")), what, F.col("n"))
    adjacencies = cut(adjacencies.select("aid", *ENDS, "at"), "adjacencies")  # made by joins and read twice
    found = cut(excess(segments, adjacencies, scnt, acnt), "excess")  # a few rows a segment, from all adjacencies; read three times
    node: Column = F.concat("chr", F.lit(":"), "hap", F.lit(":"), "strand", F.col("coord").cast("string")).alias("name")
    own = scnt.join(segments, "sid").groupBy("clone").agg(F.sum(F.col("cn") * segment_length()).alias("x"))
    inferred = found.where("excess > 0").select("clone", "chr", "coord", "strand").distinct().join(telomeres.select("chr", "coord", "strand").distinct(), ["chr", "coord", "strand"], "left_anti")
    parts = [
        count(segments.select("chr").distinct(), "chromosomes"),
        count(segments.withColumn("name", F.col("chr")), "segments", "name"),
        count(adjacencies.withColumn("name", F.col("at")), "adjacencies", "name"),
        row(own, "length", F.col("x")),
        row(found.groupBy("clone").agg(F.sum("excess").alias("x")), "chromosome_count", F.col("x") / 2),
        row(found.where("excess < 0").select("clone", node, "excess"), "negative_excess", F.col("excess")),
        row(inferred.select("clone", position_id("chr", "coord", "strand").alias("name")), "unexpected_telomere", F.lit(1)),
    ]
    if groups is not None:
        groups = cut(groups, "groups")  # of each kind read twice
        for what, broken in (("molecule_group", molecule_violations), ("labeling_group", labeling_violations), ("general_group", general_violations)):
            parts.append(row(broken(groups, acnt).select(F.col("gid").alias("name")), what, F.lit(1)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
