"""Adjacencies from callers that write tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.model import flipped_strand, strip_chr
from lociflow.operators.adjacency import canonical, numbered_ids, standard_type
from lociflow.operators.filters import in_samples
from lociflow.operators.scan import numbered
from lociflow.sources.canonical import table


def _row_number(rows: DataFrame) -> DataFrame:
    """``n``: a row's place in the file, from 0, counted within ranges and shifted by those before. Several files follow one another in order of their paths."""
    # Spark deals files out by size, so only within a file ``ord`` rises with the place.
    return numbered(rows.withColumn("__file", F.input_file_name()), "n", "__file", "ord").withColumn("n", F.col("n") - 1).drop("__file")


def _finished(rows: DataFrame, suffix: str, strip: bool, svtype: Column | None = None, svlen: Column | None = None) -> DataFrame:
    """From ``(aid, ord, chr1 .. strand2, extra)``."""
    name = strip_chr if strip else F.col
    rows = rows.withColumn("chr1", name("chr1")).withColumn("chr2", name("chr2"))
    if svtype is not None:
        new = F.create_map(F.lit("svtype"), standard_type(svtype, svlen), F.lit("or_svtype"), svtype)
        rows = rows.withColumn("extra", F.map_concat(F.map_filter("extra", lambda k, v: ~k.isin("svtype", "or_svtype")), F.map_filter(new, lambda k, v: v.isNotNull())))
    rows = rows.withColumn("at", F.lit("N"))
    return numbered_ids(canonical(rows), suffix=suffix).select("aid", "chr1", "coord1", "strand1", "chr2", "coord2", "strand2", "at", "extra", "ord")


def _external(*more) -> Column:
    return F.create_map(F.lit("external_id"), F.col("aid"), *more)


def naibr(spark: SparkSession, path: str, suffix: str = "", strip: bool = True) -> DataFrame:
    """Named by place in the file."""
    rows = _row_number(table(spark, path)).withColumn("aid", F.col("n").cast("string"))
    rows = rows.select("aid", "ord", F.col("Chr1").alias("chr1"), F.col("Break1").cast("long").alias("coord1"), F.substring("Orientation", 1, 1).alias("strand1"), F.col("Chr2").alias("chr2"), F.col("Break2").cast("long").alias("coord2"), F.substring("Orientation", 2, 1).alias("strand2"), _external().alias("extra"))
    return _finished(rows, suffix, strip, F.lit(None).cast("string"), F.lit(None).cast("string"))


def gundem2015(spark: SparkSession, path: str, samples: list[str] | None = None, least: int = 1, flip: bool = True, sep: str = "\t", suffix: str = "", strip: bool = True) -> DataFrame:
    """Adds ``per_sample_support``, a map from patient-sample to reads. The second strand is flipped. With ``samples`` just
    rows that any of them supports with ``least`` reads."""
    rows = _row_number(table(spark, path, sep)).withColumn("aid", F.col("n").cast("string"))
    names = F.transform(F.split("samples", "/"), lambda s: F.concat("patient", F.lit("-"), s))
    counts = F.map_from_arrays(names, F.transform(F.split("`tumour-counts`", "/"), lambda x: x.cast("int")))
    strand2 = flipped_strand("str2") if flip else F.col("str2")
    support = F.array_join(F.transform(F.map_entries(counts), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    rows = rows.select("aid", "ord", "chr1", F.col("pos1").cast("long").alias("coord1"), F.col("str1").alias("strand1"), "chr2", F.col("pos2").cast("long").alias("coord2"), strand2.alias("strand2"), _external(F.lit("per_sample_support"), support).alias("extra"), counts.alias("per_sample_support"))
    if samples:
        rows = in_samples(rows, "per_sample_support", samples, least=least)
    held = rows.select("ord", "per_sample_support")
    return _finished(rows.drop("per_sample_support"), suffix, strip).join(held, "ord")


def remixt(spark: SparkSession, path: str, clones: tuple[str, ...] = ("1", "2"), correct: bool = True, skip_absent: bool = False, sep: str = "\t", suffix: str = "", strip: bool = True) -> DataFrame:
    """Copies of either clone on AA, as a literal in ``cn`` of the extras. Coordinates on + are one less."""
    rows = table(spark, path, sep)
    place = lambda k: F.col(f"position_{k}").cast("long") - F.when(F.lit(correct) & (F.col(f"strand_{k}") == "+"), 1).otherwise(0)
    cn = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f"'{c}':{{'AA':"), F.col(f"cn_{c}"), F.lit("}")) for c in clones)), F.lit("}"))
    total = sum((F.col(f"cn_{c}").cast("int") for c in clones), F.lit(0))
    rows = rows.withColumn("aid", F.col("prediction_id"))
    if skip_absent:
        rows = rows.where(total > 0)
    rows = rows.select("aid", "ord", F.col("chromosome_1").alias("chr1"), place(1).alias("coord1"), F.col("strand_1").alias("strand1"), F.col("chromosome_2").alias("chr2"), place(2).alias("coord2"), F.col("strand_2").alias("strand2"), _external(F.lit("cn"), cn).alias("extra"))
    return _finished(rows, suffix, strip)


def majority_strand(text: Column | str) -> Column:
    """Of ``10+3-``: + unless there are more of -."""
    n = lambda k: F.regexp_extract(text, r"^(\d+)\+(\d+)-$", k).cast("int")
    return F.when(n(1) >= n(2), "+").otherwise("-")


def breakdancer(spark: SparkSession, path: str, suffix: str = "", strip: bool = True) -> DataFrame:
    """Eleven columns without a name; size -1 across chromosomes."""
    every = _row_number(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))
    rows = every.where((F.length(F.trim("value")) > 0) & ~F.trim("value").startswith("#")).withColumn("aid", F.col("n").cast("string"))
    p = F.split(F.trim("value"), "\t")
    size = F.when(F.get(p, F.lit(6)) == "CTX", "-1").otherwise(F.get(p, F.lit(7)))
    whole = lambda x: x.cast("double").cast("long").cast("string")
    extra = _external(F.lit("svtype"), F.get(p, F.lit(6)), F.lit("svlen"), size, F.lit("score"), whole(F.get(p, F.lit(8))), F.lit("num_reads"), whole(F.get(p, F.lit(9))), F.lit("num_reads_lib"), F.get(p, F.lit(10)))
    rows = rows.select("aid", "ord", F.get(p, F.lit(0)).alias("chr1"), F.get(p, F.lit(1)).cast("long").alias("coord1"), majority_strand(F.get(p, F.lit(2))).alias("strand1"), F.get(p, F.lit(3)).alias("chr2"), F.get(p, F.lit(4)).cast("long").alias("coord2"), majority_strand(F.get(p, F.lit(5))).alias("strand2"), extra.alias("extra"))
    return _finished(rows, suffix, strip, F.try_element_at("extra", F.lit("svtype")), F.try_element_at("extra", F.lit("svlen")))
