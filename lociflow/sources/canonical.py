"""Readers of the canonical tables: segments, adjacencies, groups, positions, regions, chromosome sizes.

Paths are anything that Spark reads. Columns are found by name; ``extra`` becomes a map of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.extras import adjacency_cn, legacy_bounds, legacy_cn, parse_extra, segment_bounds, segment_cn
from lociflow.functions.model import FAR, MAIN_CHROMOSOMES, PHASINGS, adjacency_id, segment_id
from lociflow.operators.adjacency import canonical, derived_type


def table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """All columns as texts, in the order of the file (``ord``)."""
    rows = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote="")
    return rows.withColumn("ord", F.monotonically_increasing_id())


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines (``value``, ``ord``) that are neither empty nor comments."""
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return rows.select(F.trim("value").alias("value"), "ord").where((F.length("value") > 0) & ~F.col("value").startswith("#"))


def _maybe(rows: DataFrame, name: str):
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def segments(spark: SparkSession, path: str, sep: str = "\t", pair: str = ";") -> DataFrame:
    """``(sid, chr, start, end, extra, cn, cnb, ord)``; copy numbers of a legacy ``CNs`` column give way to those of ``extra``."""
    rows = table(spark, path, sep)
    rows = rows.withColumn("extra_", parse_extra(_maybe(rows, "extra"), pair=pair)).withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))
    cn = F.coalesce(segment_cn(F.try_element_at("extra_", F.lit("cn"))), legacy_cn(_maybe(rows, "CNs"), ("A", "B")))
    return rows.select(segment_id().alias("sid"), "chr", "start", "end", F.col("extra_").alias("extra"), cn.alias("cn"), segment_bounds(F.try_element_at("extra_", F.lit("cnb"))).alias("cnb"), "ord")


def scnt(segs: DataFrame, clones: list[str] | None = None) -> DataFrame:
    """``(sid, clone, hap, cn)``. A row without copy numbers, or a clone asked for that no row has, is an error."""
    if bad := segs.where("cn is null").first():
        raise ValueError(f"no copy numbers for {bad['sid']}")
    out = segs.select("sid", F.explode("cn").alias("clone", "h")).select("sid", "clone", F.explode("h").alias("hap", "cn"))
    return _asked(out, clones)


def _asked(rows: DataFrame, clones: list[str] | None) -> DataFrame:
    if clones is None:
        return rows
    found = {r[0] for r in rows.select("clone").distinct().collect()}  # a handful of clones
    if lost := sorted(set(clones) - found):
        raise ValueError(f"no copy numbers for clones {', '.join(lost)}")
    return rows.where(F.col("clone").isin(*clones))


def scnb(segs: DataFrame, clones: list[str] | None = None, allow_missing: bool = True) -> DataFrame:
    """``(sid, clone, hap, bound, value)``"""
    if not allow_missing and (bad := segs.where("cnb is null").first()):
        raise ValueError(f"no bounds for {bad['sid']}")
    one = segs.select("sid", F.explode("cnb").alias("clone", "h")).select("sid", "clone", F.explode("h").alias("hap", "b"))
    return _asked(one.select("sid", "clone", "hap", F.explode("b").alias("bound", "value")), clones)


def adjacencies(spark: SparkSession, path: str, sep: str = "\t", pair: str = ";") -> DataFrame:
    """``(aid, chr1, coord1, strand1, chr2, coord2, strand2, at, extra, cn, ord)``, ends in model order."""
    rows = table(spark, path, sep)
    rows = rows.withColumn("extra_", parse_extra(_maybe(rows, "extra"), strict=True, pair=pair))
    cn = F.coalesce(adjacency_cn(F.try_element_at("extra_", F.lit("cn"))), legacy_cn(_maybe(rows, "CNs"), PHASINGS))
    places = [F.col("coord1").cast("long").alias("coord1"), F.col("coord2").cast("long").alias("coord2")]
    at = derived_type("aid", F.try_element_at("extra_", F.lit("at")))
    out = rows.select("aid", "chr1", places[0], "strand1", "chr2", places[1], "strand2", at.alias("at"), F.col("extra_").alias("extra"), cn.alias("cn"), "ord")
    return canonical(out)


def acnt(adjs: DataFrame, clones: list[str] | None = None) -> DataFrame:
    """``(aid, stable_id, clone, phasing, cn)``"""
    if bad := adjs.where("cn is null").first():
        raise ValueError(f"no copy numbers for {bad['aid']}")
    one = adjs.select("aid", adjacency_id("at").alias("stable_id"), F.explode("cn").alias("clone", "p"))
    return _asked(one.select("aid", "stable_id", "clone", F.explode("p").alias("phasing", "cn")), clones)


def positions(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    rows = table(spark, path, sep)
    return rows.select("chr", F.col("coord").cast("long").alias("coord"), "strand")


def groups(spark: SparkSession, path: str, sep: str = "\t", pair: str = ";") -> DataFrame:
    """``(gid, aids, agt, fp, agl, extra)``; groups are molecules unless they say otherwise."""
    rows = table(spark, path, sep)
    rows = rows.withColumn("extra_", parse_extra(_maybe(rows, "extra"), pair=pair))
    of = lambda k: F.try_element_at("extra_", F.lit(k))
    return rows.select(
        "gid", F.split("aids", ",").alias("aids"), F.coalesce(of("agt"), F.lit("M")).alias("agt"), of("fp").cast("double").alias("fp"), F.transform(F.split(of("agl"), ","), lambda x: x.cast("int")).alias("agl"), F.col("extra_").alias("extra")
    )


def chr_sizes(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", r"\s+")
    return lines(spark, path).select(parts[0].alias("chr"), parts[1].cast("long").alias("size"))


def parse_regions(rows: DataFrame, value: str = "value") -> DataFrame:
    """``(rid, chr, start, end)`` of ``chr``, ``chr:a-b`` or ``chr<tab>a<tab>b`` texts; a bare name is the whole chromosome."""
    v = F.col(value)
    range_ = r"^([^:\t]+):(\d+)-(\d+)$"
    tabs = F.split(v, "\t")
    ranged, tabbed = v.rlike(range_), F.size(tabs) >= 3
    chr_ = F.when(ranged, F.regexp_extract(v, range_, 1)).when(tabbed, tabs[0]).otherwise(v)
    pick = lambda k, alone: F.when(ranged, F.regexp_extract(v, range_, k).try_cast("long")).when(tabbed, F.try_element_at(tabs, F.lit(k)).try_cast("long")).otherwise(F.lit(alone)).cast("long")
    start, end = pick(2, 0), pick(3, FAR)
    start = F.when(tabbed & ~ranged, F.try_element_at(tabs, F.lit(2)).try_cast("long")).otherwise(start)
    end = F.when(tabbed & ~ranged, F.try_element_at(tabs, F.lit(3)).try_cast("long")).otherwise(end)
    return rows.select(v.alias("rid"), chr_.alias("chr"), start.cast("long").alias("start"), end.cast("long").alias("end"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    return parse_regions(lines(spark, path))


def region_list(spark: SparkSession, texts: list[str]) -> DataFrame:
    return parse_regions(spark.createDataFrame([(x,) for x in texts], "value string"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.col("value").alias("read")).distinct()


def main_chromosomes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in MAIN_CHROMOSOMES], "chr string")


def legacy_scnb(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``(sid, clone, hap, bound, value)`` of ``chr start end (clone,lA-uA,lB-uB);...`` lines under a header."""
    p = F.split("value", sep)
    rows = lines(spark, path).where(~F.lower("value").startswith("chr" + sep))
    own = rows.select(F.concat(F.get(p, F.lit(0)), F.lit(":"), F.get(p, F.lit(1)), F.lit("-"), F.get(p, F.lit(2))).alias("sid"), legacy_bounds(F.get(p, F.lit(3))).alias("cnb"))
    return scnb(own)


def legacy_scnt(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``(sid, clone, hap, cn)`` of ``chr start end (clone,a,b);...`` lines, blank ones, comments and a header skipped."""
    p = F.split("value", sep)
    rows = lines(spark, path).where(~F.lower("value").startswith("chr" + sep))
    return scnt(rows.select(F.concat(F.get(p, F.lit(0)), F.lit(":"), F.get(p, F.lit(1)), F.lit("-"), F.get(p, F.lit(2))).alias("sid"), legacy_cn(F.get(p, F.lit(3)), ("A", "B")).alias("cn")))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """``(read, aln, flag, chr, start, end, strand, line)`` of the mapped lines of SAM texts, in any order.

    The end is found from the reference-consuming operations of the CIGAR text.
    """
    rows = spark.read.text(path).withColumn("aln", F.monotonically_increasing_id()).where(~F.col("value").startswith("@"))
    p = F.split("value", "\t")
    own = rows.select(F.get(p, F.lit(0)).alias("read"), "aln", F.get(p, F.lit(1)).cast("int").alias("flag"), F.get(p, F.lit(2)).alias("chr"), F.get(p, F.lit(3)).cast("long").alias("start"), F.get(p, F.lit(5)).alias("cigar"), F.col("value").alias("line"))
    moves = F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    length = F.aggregate(moves, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))
    mapped = own.where((F.col("chr") != "*") & (F.col("flag").bitwiseAND(F.lit(4)) == 0))
    strand = F.when(F.col("flag").bitwiseAND(F.lit(16)) == 0, "+").otherwise("-")
    return mapped.select("read", "aln", "flag", "chr", "start", (F.col("start") + length - 1).alias("end"), strand.alias("strand"), "line")


def filter_alignments(spark: SparkSession, path: str, names: DataFrame, keep: bool = True) -> DataFrame:
    """Lines of SAM texts, header included, of the named reads (or of all others)."""
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    head, body = rows.where(F.col("value").startswith("@")), rows.where(~F.col("value").startswith("@"))
    own = body.withColumn("read", F.split("value", "\t")[0]).join(names, "read", "left_semi" if keep else "left_anti")
    return head.unionByName(own.select("value", "ord")).orderBy("ord").select("value")
