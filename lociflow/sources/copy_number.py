"""Copy numbers from callers: each gives ``(segments, scnt)``. Clones are texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.model import segment_id, strip_chr
from lociflow.sources.canonical import lines, table


def _made(rows: DataFrame, strip: bool) -> tuple[DataFrame, DataFrame]:
    """From ``(chr, start, end, clones)``; ``clones`` an array of (clone, a, b), b null for haploid data."""
    rows = rows.withColumn("chr", strip_chr("chr") if strip else F.col("chr")).withColumn("sid", segment_id())
    one = rows.select("sid", F.explode("clones").alias("c"))
    haps = F.explode(F.array(F.struct(F.lit("A").alias("hap"), F.col("c.a").alias("cn")), F.struct(F.lit("B").alias("hap"), F.col("c.b").alias("cn")))).alias("h")
    return rows.select("sid", "chr", "start", "end"), one.select("sid", "c.clone", haps).select("sid", "clone", "h.hap", "h.cn").where("cn is not null")


def _clone(name: str | Column, a: Column, b: Column | None) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("clone"), a.cast("int").alias("a"), (F.lit(None) if b is None else b).cast("int").alias("b"))


def _span(start: str, end: str, shift: int = 0) -> list[Column]:
    return [F.col(start).cast("long").alias("start"), (F.col(end).cast("long") + shift).alias("end")]


def battenberg(spark: SparkSession, path: str, sample: str, sep: str = "\t", strip: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clones 1 and 2; negative numbers are 0, NA in clone 2 is clone 1's number."""
    rows = table(spark, path, sep)
    if "sample" in rows.columns:
        rows = rows.where(F.col("sample") == sample)
    n = lambda c: F.greatest(F.col(c).cast("int"), F.lit(0))
    second = lambda c, first: F.when(F.col(c) == "NA", n(first)).otherwise(F.greatest(F.col(c).try_cast("int"), F.lit(0)))
    both = F.array(_clone("1", n("nMaj1_A"), n("nMin1_A")), _clone("2", second("nMaj2_A", "nMaj1_A"), second("nMin2_A", "nMin1_A")))
    return _made(rows.select("chr", *_span("startpos", "endpos"), both.alias("clones")), strip)


def hatchet_clones(spark: SparkSession, path: str, sample: str, sep: str = "\t", min_usage: float = 0.01) -> list[str]:
    """Clones that some segment of the sample uses, numbered by column."""
    p = F.split("value", sep)
    rows = lines(spark, path).where(F.get(p, F.lit(3)) == sample).select(F.posexplode(F.slice(p, F.lit(7), F.greatest(F.size(p) - 6, F.lit(0)))).alias("k", "x")).where("k % 2 = 1")
    used = rows.where(F.col("x").cast("double") >= min_usage).select((F.floor(F.col("k") / 2) + 1).cast("string").alias("c")).distinct()
    return sorted((r["c"] for r in used.collect()), key=int)  # a handful of clones


def hatchet(spark: SparkSession, path: str, sample: str, clones: list[str] | None = None, min_usage: float = 0.01, sep: str = "\t", strip: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pairs of (a|b, usage) from the seventh column on; the end is exclusive."""
    clones = hatchet_clones(spark, path, sample, sep, min_usage) if clones is None else clones
    p = F.split("value", sep)
    rows = lines(spark, path).where(F.get(p, F.lit(3)) == sample)
    cn = lambda c, k: F.split(F.get(p, F.lit(6 + 2 * (int(c) - 1))), r"\|")[k]
    all_ = F.array(*(_clone(c, cn(c, 0), cn(c, 1)) for c in clones)) if clones else F.array().cast("array<struct<clone:string,a:int,b:int>>")
    return _made(rows.select(F.get(p, F.lit(0)).alias("chr"), F.get(p, F.lit(1)).cast("long").alias("start"), (F.get(p, F.lit(2)).cast("long") - 1).alias("end"), all_.alias("clones")), strip)


def remixt(spark: SparkSession, path: str, sep: str = "\t", strip: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clones 1 and 2; the end is exclusive."""
    both = F.array(*(_clone(c, F.col(f"major_{c}"), F.col(f"minor_{c}")) for c in "12"))
    return _made(table(spark, path, sep).select(F.col("chromosome").alias("chr"), *_span("start", "end", -1), both.alias("clones")), strip)


def corrected(major: Column, minor: Column, total: Column, how: str) -> tuple[Column, Column]:
    """Copies made up to the corrected total: by halves (``equal``), by their ratio (``relative-dist``), or not (``None``)."""
    diff = total - major - minor
    if how == "None":
        return major, minor
    if how == "equal":
        more = F.ceil(diff / 2)
    elif how == "relative-dist":
        more = F.ceil(diff / (1 + minor / F.when(major == 0, None).otherwise(major)))
    else:
        raise ValueError("how is None, equal or relative-dist")
    more = F.coalesce(more.cast("int"), diff)
    return major + more, minor + diff - more


def titan_clones(spark: SparkSession, path: str, sample: str, sep: str = "\t") -> list[str]:
    rows = table(spark, path, sep).where((F.col("Sample") == sample) & (F.col("Clonal_Cluster") != "NA"))
    return sorted(r[0] for r in rows.select("Clonal_Cluster").distinct().collect())  # a handful of clones


def titan(spark: SparkSession, path: str, sample: str, clones: list[str] | None = None, fix: str = "None", sep: str = "\t", strip: bool = True) -> tuple[DataFrame, DataFrame]:
    """A segment belongs to one clone; the others have 1 and 1 there."""
    clones = titan_clones(spark, path, sample, sep) if clones is None else clones
    rows = table(spark, path, sep).where(F.col("Sample") == sample)
    n = lambda c: F.col(c).cast("int")
    a, b = corrected(F.greatest(n("MajorCN"), n("MinorCN")), F.least(n("MajorCN"), n("MinorCN")), n("Corrected_Copy_Number"), fix)
    own = lambda c, x: F.when(F.col("Clonal_Cluster") == c, x).otherwise(1)
    all_ = F.array(*(_clone(c, own(c, a), own(c, b)) for c in clones)) if clones else F.array().cast("array<struct<clone:string,a:int,b:int>>")
    return _made(rows.select(F.col("Chromosome").alias("chr"), *_span("Start", "End"), all_.alias("clones")), strip)


def ginkgo(spark: SparkSession, path: str, sample: str, clone: str = "1", sep: str = "\t", strip: bool = True) -> tuple[DataFrame, DataFrame]:
    """Haploid: the sample's column on haplotype A."""
    rows = table(spark, path, sep)
    if sample not in rows.columns:
        raise ValueError(f"no column for sample {sample}; names are compared in their case")
    return _made(rows.select(F.col("CHR").alias("chr"), *_span("START", "END"), F.array(_clone(clone, F.col(f"`{sample}`"), None)).alias("clones")), strip)


def gff(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, missing: str = "keep", strip: bool = True) -> DataFrame:
    """Segments with their attributes as extras. ``mapping`` renames chromosomes; those it lacks are kept or with ``skip`` left out."""
    p = F.split("value", "\t")
    rows = lines(spark, path)
    chr_ = F.get(p, F.lit(0))
    if mapping is not None:
        known = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")
        if missing == "skip":
            rows = rows.where(F.map_contains_key(known, F.get(p, F.lit(0))))
        chr_ = F.coalesce(F.try_element_at(known, F.get(p, F.lit(0))), F.get(p, F.lit(0)))
    pairs = F.filter(F.transform(F.split(F.get(p, F.lit(8)), ";"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    gtf = ~F.get(p, F.lit(8)).contains("=")
    key = lambda x: F.when(gtf, F.substring_index(x, " ", 1)).otherwise(F.substring_index(x, "=", 1))
    value = lambda x: F.regexp_replace(F.when(gtf, F.regexp_replace(x, "^[^ ]* ?", "")).otherwise(F.regexp_replace(x, "^[^=]*=?", "")), '^"|"$', "")
    made = F.transform(pairs, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    extra = F.map_from_entries(F.filter(made, lambda e, i: ~F.exists(F.slice(made, F.lit(1), i), lambda q: q["k"] == e["k"])))
    rows = rows.select((strip_chr(chr_) if strip else chr_).alias("chr"), F.get(p, F.lit(3)).cast("long").alias("start"), F.get(p, F.lit(4)).cast("long").alias("end"), extra.alias("extra"))
    return rows.select(segment_id().alias("sid"), "chr", "start", "end", "extra")
