"""Writers of canonical tables and of formats for other programs. Each makes the rows (``*_rows``) or writes them as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions.extras import stringify_extra
from lociflow.functions.model import distance

_EMPTY = "map<string,string>"


def write_table(rows: DataFrame, path: str, sep: str = "\t", header: bool = True, single: bool = False) -> None:
    """Delimited text; parts in order. ``single``: one file, for programs that read no others."""
    (rows.coalesce(1) if single else rows).write.csv(path, sep=sep, header=header, quote="", escape="", emptyValue="")


def write_lines(rows: DataFrame, path: str, single: bool = True) -> None:
    (rows.coalesce(1) if single else rows).write.text(path)


def nested_scnt(scnt: DataFrame) -> DataFrame:
    """``(sid, cn)`` with the nested map."""
    one = scnt.groupBy("sid", "clone").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hap", "cn")))).alias("h"))
    return one.groupBy("sid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("clone", F.to_json("h").alias("j"))))).alias("m")).select("sid", _joined("m").alias("cn"))


def _joined(m: str) -> Column:
    """A map of JSON texts as one dict literal."""
    parts = F.transform(F.map_entries(m), lambda e: F.concat(F.lit("'"), e["key"], F.lit("':"), e["value"]))
    return F.replace(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")), F.lit('"'), F.lit("'"))


def nested_scnb(scnb: DataFrame) -> DataFrame:
    one = scnb.groupBy("sid", "clone", "hap").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bound", "value")))).alias("b"))
    two = one.groupBy("sid", "clone").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hap", F.to_json("b").alias("j"))))).alias("m")).select("sid", "clone", _joined("m").alias("h"))
    return two.groupBy("sid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("clone", "h")))).alias("m")).select("sid", _joined("m").alias("cnb"))


def nested_acnt(acnt: DataFrame) -> DataFrame:
    one = acnt.groupBy("aid", "clone").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phasing", "cn")))).alias("h"))
    return one.groupBy("aid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("clone", F.to_json("h").alias("j"))))).alias("m")).select("aid", _joined("m").alias("cn"))


def _with(extra: Column | None, key: str, value: Column) -> Column:
    base = F.coalesce(extra, F.create_map().cast(_EMPTY)) if extra is not None else F.create_map().cast(_EMPTY)
    return F.map_concat(F.map_filter(base, lambda k, v: F.lower(k) != key), F.create_map(F.lit(key), value))


def segment_rows(segments: DataFrame, scnt: DataFrame | None = None, scnb: DataFrame | None = None, fields: list[str] | None = None, fill: str = "") -> DataFrame:
    """``chr, start, end, extra`` sorted by name of the chromosome, start and end."""
    rows = segments if "extra" in segments.columns else segments.withColumn("extra", F.create_map().cast(_EMPTY))
    for key, nested in (("cn", nested_scnt(scnt) if scnt is not None else None), ("cnb", nested_scnb(scnb) if scnb is not None else None)):
        if nested is not None:
            rows = rows.drop(key).join(nested, "sid", "left").withColumn("extra", F.when(F.col(key).isNotNull(), _with(F.col("extra"), key, F.col(key))).otherwise(F.col("extra")))
    return rows.select("chr", "start", "end", stringify_extra("extra", fields, fill).alias("extra")).orderBy("chr", "start", "end")


def adjacency_rows(adjacencies: DataFrame, acnt: DataFrame | None = None, fields: list[str] | None = None, fill: str = "", mixed: bool = True, reference: bool = True) -> DataFrame:
    """``aid, chr1 .. strand2, extra``. Sorted by coordinates; not ``mixed``: novel ones first, then the reference's."""
    rows = adjacencies if "extra" in adjacencies.columns else adjacencies.withColumn("extra", F.create_map().cast(_EMPTY))
    if not reference:
        rows = rows.where("at <> 'R'")
    if acnt is not None:
        rows = rows.drop("cn").join(nested_acnt(acnt), "aid", "left").withColumn("extra", F.when(F.col("cn").isNotNull(), _with(F.col("extra"), "cn", F.col("cn"))).otherwise(F.col("extra")))
    if fields is None:
        rows = rows.withColumn("extra", _with(F.col("extra"), "at", F.col("at")))
    first = [] if mixed else [F.when(F.col("at") == "N", 0).otherwise(1)]
    ends = ("chr1", "coord1", "strand1", "chr2", "coord2", "strand2")
    return rows.orderBy(*first, "chr1", "coord1", "chr2", "coord2", "aid").select("aid", *ends, stringify_extra("extra", fields, fill).alias("extra"))


def position_rows(positions: DataFrame) -> DataFrame:
    return positions.select("chr", "coord", "strand").orderBy("chr", "coord", "strand")


def group_rows(groups: DataFrame) -> DataFrame:
    """``gid, aids, extra``; the type always, rate and labels where there are some."""
    base = F.coalesce("extra", F.create_map().cast(_EMPTY)) if "extra" in groups.columns else F.create_map().cast(_EMPTY)
    kept = F.map_filter(base, lambda k, v: ~F.lower(k).isin("agt", "fp", "agl"))
    more = F.map_filter(F.create_map(F.lit("agt"), F.col("agt"), F.lit("fp"), F.col("fp").cast("string"), F.lit("agl"), F.array_join(F.transform("agl", lambda x: x.cast("string")), ",")), lambda k, v: v.isNotNull())
    return groups.select("gid", F.array_join("aids", ",").alias("aids"), stringify_extra(F.map_concat(kept, more)).alias("extra")).orderBy("gid")


def bedpe_rows(adjacencies: DataFrame, inter: bool = True) -> DataFrame:
    rows = adjacencies if inter else adjacencies.where("chr1 = chr2")
    return rows.select("chr1", F.col("coord1").alias("start1"), (F.col("coord1") + 1).alias("end1"), "chr2", F.col("coord2").alias("start2"), (F.col("coord2") + 1).alias("end2"), F.col("aid").alias("name"), F.lit("NA").alias("score"), "strand1", "strand2")


def circa_adjacency_rows(adjacencies: DataFrame, size: Column | None = None) -> DataFrame:
    """``mid`` lies between the ends; -1 across chromosomes."""
    mid = F.when(F.col("chr1") == F.col("chr2"), F.col("coord1") + F.floor(F.abs(F.col("coord2") - F.col("coord1")) / 2).cast("long")).otherwise(-1)
    return adjacencies.select("chr1", "coord1", "chr2", "coord2", "strand1", "strand2", (distance() if size is None else F.coalesce(size, distance())).alias("size"), mid.alias("mid"))


def circa_segment_rows(segments: DataFrame, *extras: str) -> DataFrame:
    mid = F.floor(F.col("start") + F.abs(F.col("end") - F.col("start")) / 2).cast("long")
    return segments.select("chr", "start", "end", mid.alias("mid"), *(F.try_element_at("extra", F.lit(x)).alias(x) for x in extras))


def circa_density_rows(density: DataFrame, width: int) -> DataFrame:
    return density.select("chr", (F.col("win") * width + 1).alias("start"), ((F.col("win") + 1) * width).alias("end"), F.col("n").alias("value"))


def shatterseek_rows(segments: DataFrame, scnt: DataFrame, clone: str) -> DataFrame:
    total = scnt.where(F.col("clone") == clone).groupBy("sid").agg(F.sum("cn").alias("total_cn"))
    return segments.join(total, "sid", "left").select(F.col("chr").alias("chromosome"), "start", "end", F.coalesce("total_cn", F.lit(0)).alias("total_cn")).orderBy("chromosome", "start", "end")


def edge_rows(edges: DataFrame) -> DataFrame:
    """``u v cn kind`` with S or A, segments first."""
    return edges.select("u", "v", "cn", F.when(F.col("kind") == "S", "S").otherwise("A").alias("kind")).orderBy(F.col("kind").desc(), "u", "v")


def signature_rows(signatures: DataFrame) -> DataFrame:
    return signatures.select("k", F.array_join("aids", ",").alias("aids"), "signature").orderBy(F.desc("k"), "signature")


def vcf_lines(adjacencies: DataFrame, acnt: DataFrame | None = None, info: list[str] | None = None, formats: list[str] | None = None, sample: str = "sample", date: str | None = None) -> DataFrame:
    """``value``: header and one line for each adjacency, in order of chromosome and coordinate.

    INFO begins with CHR2, END and STRANDS and goes on with the extras (``info``: just these), keys in capitals and in
    order. With copy numbers FORMAT holds a CN key for each clone that any adjacency has, in the order of the names, and
    GT is 0/0 where there are no copies at all.
    """
    rows = adjacencies if "extra" in adjacencies.columns else adjacencies.withColumn("extra", F.create_map().cast(_EMPTY))
    spark, of = rows.sparkSession, lambda k: F.try_element_at("extra", F.lit(k))
    fixed = ("ref", "alt", "or_gt", "cn", *(formats or []))
    keep = F.map_filter("extra", lambda k, v: k.isin(*info) if info is not None else ~k.isin(*fixed))
    more = F.transform(F.array_sort(F.map_entries(F.transform_keys(keep, lambda k, v: F.upper(k)))), lambda e: F.concat(e["key"], F.lit("="), F.regexp_replace(e["value"], "[;\\s]", "_")))
    clones: list[str] = []
    if acnt is not None:
        clones = sorted(r[0] for r in acnt.select("clone").distinct().collect())  # a handful of clones
        per = acnt.groupBy("aid", "clone").agg(F.sum("cn").alias("n")).groupBy("aid").pivot("clone", clones).agg(F.first("n"))
        rows = rows.join(per.select("aid", *(F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(f"cn_{x}") for x in clones)), "aid", "left")
    copies = [F.coalesce(F.col(f"`cn_{x}`"), F.lit(0)).cast("string") for x in clones]
    none = (sum((F.coalesce(F.col(f"`cn_{x}`"), F.lit(0)) for x in clones), F.lit(0)) == 0) if clones else F.lit(False)
    gt = F.when(none, "0/0").otherwise(F.coalesce(of("or_gt"), F.lit("./.")))
    extra_formats = [F.coalesce(of(k), F.lit(".")) for k in sorted(formats or [])]
    keys = ":".join(["GT", *(k.upper() for k in sorted(formats or [])), *(f"CN_{x}" for x in clones)])
    type_ = F.coalesce(of("svtype"), F.lit("BND"))
    body = F.concat_ws(
        "\t",
        "chr1", F.col("coord1").cast("string"), "aid", F.coalesce(of("ref"), F.lit("N")), F.coalesce(of("alt"), F.concat(F.lit("<"), type_, F.lit(">"))), F.lit("."), F.coalesce(of("vcf_filter"), F.lit("PASS")),
        F.concat_ws(";", F.concat(F.lit("CHR2="), "chr2"), F.concat(F.lit("END="), F.col("coord2").cast("string")), F.concat(F.lit("STRANDS="), "strand1", "strand2"), F.array_join(more, ";")),
        F.lit(keys), F.concat_ws(":", gt, *extra_formats, *copies),
    )
    body = F.regexp_replace(body, ";(?=\t)", "")
    day = F.date_format(F.current_date(), "yyyyMMdd") if date is None else F.lit(date)
    head = [("##fileformat=VCFv4.2", 0)]
    heads = spark.createDataFrame(head, "value string, n int").unionByName(spark.range(1).select(F.concat(F.lit("##fileDate="), day).alias("value"), F.lit(1).alias("n")))
    contigs = rows.select(F.explode(F.array("chr1", "chr2")).alias("c")).distinct().select(F.concat(F.lit("##contig=<ID="), "c", F.lit(">")).alias("value"), F.lit(2).alias("n"))
    alts = rows.select(type_.alias("t")).distinct().select(F.concat(F.lit("##ALT=<ID="), "t", F.lit(">")).alias("value"), F.lit(3).alias("n"))
    infos = rows.select(F.explode(F.map_entries(keep)).alias("e")).groupBy(F.upper("e.key").alias("k")).agg(F.bool_or(F.col("e.value").contains(",")).alias("many"))
    infos = infos.select(F.concat(F.lit("##INFO=<ID="), "k", F.lit(",Number="), F.when(F.col("many"), ".").otherwise("1"), F.lit(',Type=String,Description="'), "k", F.lit('">')).alias("value"), F.lit(4).alias("n"))
    given = [(f'##INFO=<ID={k},Number=1,Type=String,Description="{k}">', 4) for k in ("CHR2", "END", "STRANDS")]
    given += [(f'##FORMAT=<ID={k},Number=1,Type=String,Description="{k}">', 5) for k in keys.split(":")]
    given += [("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample]), 6)]
    top = heads.unionByName(contigs).unionByName(alts).unionByName(infos).unionByName(spark.createDataFrame(given, "value string, n int"))
    top = top.select("n", F.lit("").alias("a"), F.lit(0).cast("long").alias("b"), "value")
    return top.unionByName(rows.select(F.lit(7).alias("n"), F.col("chr1").alias("a"), F.col("coord1").alias("b"), body.alias("value"))).orderBy("n", "a", "b", "value").select("value")
