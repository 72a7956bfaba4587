"""Structural-variant calls in VCF texts, to adjacencies.

Every caller's function takes records (``records``) and gives ``(aid, chr1 .. strand2, at, extra)`` with ends in model
order, ids numbered where a call makes several rows, and a standard ``svtype`` in the extras, whose keys are in
small letters; the caller's own type stays as ``or_svtype``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.model import strip_chr
from lociflow.operators.adjacency import canonical, numbered_ids, standard_type

#: Extras that repeat the coordinates.
REPEATED = ("CHR2", "END", "STRANDS")
_EMPTY = "map<string,string>"


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, chrom, pos, id, ref, alt, filter, info, samples)``; of records that repeat an id the last is kept.

    ``info`` maps keys to texts, flags to ``true``; ``samples`` maps a sample to its FORMAT values.
    """
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    head = rows.where(F.col("value").startswith("#CHROM")).first()
    names = head["value"].rstrip("\n").split("\t")[9:] if head else []
    p = F.split("value", "\t")
    pairs = F.transform(F.filter(F.split(F.get(p, F.lit(7)), ";"), lambda x: (F.length(x) > 0) & (x != ".")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("true").alias("v")))
    info = F.map_from_entries(F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == e["k"])))
    keys = F.split(F.get(p, F.lit(8)), ":")
    values = lambda k: F.map_from_entries(F.filter(F.transform(keys, lambda n, i: F.struct(n.alias("k"), F.try_element_at(F.split(F.get(p, F.lit(k)), ":"), i + 1).alias("v"))), lambda e: e["v"].isNotNull()))
    samples = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), values(9 + i))]) if names else F.create_map().cast("map<string,map<string,string>>")
    own = ~F.col("value").startswith("#") & (F.length("value") > 0)
    # Spark may look at later conditions first, so only lines of records have a position.
    out = rows.where(own).select(
        "ord", F.get(p, F.lit(0)).alias("chrom"), F.when(own, F.get(p, F.lit(1))).cast("long").alias("pos"), F.get(p, F.lit(2)).alias("id"), F.get(p, F.lit(3)).alias("ref"), F.get(p, F.lit(4)).alias("alt"), F.get(p, F.lit(6)).alias("filter"), info.alias("info"), samples.alias("samples")
    )
    # Only numbers are gathered by id, however many records share one.
    last = out.groupBy("id").agg(F.max("ord").alias("ord")).select("ord")
    return out.join(last, "ord", "left_semi")


def info(key: str, of: str = "info") -> Column:
    return F.try_element_at(F.col(of), F.lit(key))


def alt_strand(alt: str) -> Column:
    """Of a breakend's ALT text: + if a closing bracket begins or ends it."""
    return F.when(F.col(alt).startswith("]") | F.col(alt).endswith("]"), "+").otherwise("-")


def alt_place(alt: str = "alt") -> tuple[Column, Column]:
    at = r"[\[\]]([^\[\]]+):(\d+)[\[\]]"
    return F.regexp_extract(alt, at, 1), F.regexp_extract(alt, at, 2).try_cast("long")


def _end(chr_: Column, coord: Column, strand: Column | str) -> Column:
    return F.struct(chr_.alias("chr"), coord.cast("long").alias("coord"), (F.lit(strand) if isinstance(strand, str) else strand).alias("strand"))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def inversion(chrom: Column, pos: Column, end: Column) -> Column:
    """Two adjacencies: + to + left of the breaks, - to - right of them."""
    return F.array(_pair(_end(chrom, pos - 1, "+"), _end(chrom, end, "+")), _pair(_end(chrom, pos, "-"), _end(chrom, end + 1, "-")))


def merged_extra(*maps: Column) -> Column:
    """Later maps win."""
    out = F.coalesce(maps[0], F.create_map().cast(_EMPTY))
    for m in maps[1:]:
        out = _over(out, F.coalesce(m, F.create_map().cast(_EMPTY)))
    return out


def _over(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def bases() -> Column:
    """REF and ALT of insertions and deletions given as sequences."""
    given = F.col("alt").rlike("^[A-Za-z,]+$") & F.lower(info("SVTYPE")).rlike("ins|del")
    return F.when(F.coalesce(given, F.lit(False)), F.create_map(F.lit("REF"), F.col("ref"), F.lit("ALT"), F.col("alt"))).otherwise(F.create_map().cast(_EMPTY))


def finished(rows: DataFrame, suffix: str = "", strip: bool = True, standard: bool = True) -> DataFrame:
    """From ``(aid, ord, pairs, extra)``; ``pairs`` an array of two ends each."""
    one = rows.select("aid", "ord", F.posexplode("pairs").alias("n", "p"), "extra")
    name = lambda x: strip_chr(x) if strip else F.col(x)
    flat = one.select("aid", (F.col("ord") * 8 + F.col("n")).alias("ord"), name("p.a.chr").alias("chr1"), F.col("p.a.coord").alias("coord1"), F.col("p.a.strand").alias("strand1"), name("p.b.chr").alias("chr2"), F.col("p.b.coord").alias("coord2"), F.col("p.b.strand").alias("strand2"), "extra")
    kept = F.map_filter("extra", lambda k, v: ~F.upper(k).isin(*REPEATED) & v.isNotNull())
    flat = numbered_ids(canonical(flat.withColumn("extra", kept)), suffix=suffix)
    low = F.transform_keys(F.map_filter("extra", lambda k, v: ~F.map_contains_key("extra", F.lower(k)) | (k == F.lower(k))), lambda k, v: F.lower(k))
    flat = flat.withColumn("extra", low)
    if standard:
        of = lambda k: F.try_element_at("extra", F.lit(k))
        own = of("svtype")
        new = F.map_concat(F.map_filter("extra", lambda k, v: ~k.isin("svtype", "or_svtype")), F.create_map(F.lit("svtype"), standard_type(own, of("svlen"), of("ref"), of("alt"))), F.when(own.isNotNull(), F.create_map(F.lit("or_svtype"), own)).otherwise(F.create_map().cast(_EMPTY)))
        flat = flat.withColumn("extra", new)
    return flat.select("aid", "chr1", "coord1", "strand1", "chr2", "coord2", "strand2", F.lit("N").alias("at"), "extra", "ord")


def _base(rows: DataFrame) -> DataFrame:
    return rows.withColumn("svtype", info("SVTYPE")).withColumn("end", info("END").try_cast("long")).withColumn("mate", F.split(info("MATEID"), ",")[0])


def _noted(*more: Column) -> Column:
    return merged_extra(F.col("info"), F.create_map(F.lit("vcf_filter"), F.col("filter"), F.lit("external_id"), F.col("id")), *more)


def mates(rows: DataFrame) -> DataFrame:
    """Breakend records with their mates' columns (prefix ``m_``), each pair once, led by the first; without the mate none."""
    m = rows.select(*[F.col(c).alias(f"m_{c}") for c in rows.columns])
    pairs = rows.join(m, (F.col("mate") == F.col("m_id")))
    back = F.coalesce(F.col("m_mate") == F.col("id"), F.lit(False))
    return pairs.where(~back | (F.col("ord") < F.col("m_ord")))


def mate_pair() -> Column:
    """The strand of an end is read from the mate's ALT."""
    return F.array(_pair(_end(F.col("chrom"), F.col("pos"), alt_strand("m_alt")), _end(F.col("m_chrom"), F.col("m_pos"), alt_strand("alt"))))


def _unknown(rows: DataFrame, known: list[str]) -> None:
    if bad := rows.where(~F.coalesce(F.col("svtype").isin(*known), F.lit(False))).first():
        raise ValueError(f"unknown SV type {bad['svtype']} of {bad['id']}")


def lumpy(recs: DataFrame, suffix: str = "", strip: bool = True) -> DataFrame:
    rows = _base(recs)
    _unknown(rows, ["DUP", "DEL", "BND", "INV"])
    wrong = F.when(F.col("svtype") == "BND", ~F.col("id").contains("_")).otherwise(F.col("id").contains("_"))
    if bad := rows.where(wrong).first():
        raise ValueError(f"id {bad['id']} is not one of a {bad['svtype']}")
    chrom, pos, end = F.col("chrom"), F.col("pos"), F.col("end")
    pairs = F.when(F.col("svtype") == "DUP", F.array(_pair(_end(chrom, pos, "-"), _end(chrom, end, "+")))).when(F.col("svtype") == "DEL", F.array(_pair(_end(chrom, pos - 1, "+"), _end(chrom, end + 1, "-")))).otherwise(inversion(chrom, pos, end))
    plain = rows.where("svtype <> 'BND'").select(F.col("id").alias("aid"), "ord", pairs.alias("pairs"), _noted(bases()).alias("extra"))
    bnd = mates(rows.where("svtype = 'BND'"))
    base = F.split("id", "_")[0]
    both = bnd.select(base.alias("aid"), "ord", mate_pair().alias("pairs"), merged_extra(_noted(), F.col("m_info"), F.create_map(F.lit("vcf_filter2"), F.col("m_filter"), F.lit("external_id"), base)).alias("extra"))
    return finished(plain.unionByName(both), suffix, strip)


def longranger(recs: DataFrame, suffix: str = "", strip: bool = True) -> DataFrame:
    rows = _base(recs)
    several = F.size(F.split("id", "_")) > 2
    alone = rows.where(~several & (F.col("svtype") != "UNK"))
    _unknown(alone, ["INV", "DEL", "DUP"])
    chrom, pos, end = F.col("chrom"), F.col("pos"), F.col("end")
    pairs = F.when(F.col("svtype") == "DUP", F.array(_pair(_end(chrom, pos, "-"), _end(chrom, end, "+")))).when(F.col("svtype") == "DEL", F.array(_pair(_end(chrom, pos, "+"), _end(chrom, end, "-")))).otherwise(inversion(chrom, pos, end))
    plain = alone.select(F.col("id").alias("aid"), "ord", pairs.alias("pairs"), _noted(bases()).alias("extra"))
    led = rows.where(several).withColumn("mate", F.explode(F.split(info("MATEID"), ",")))
    base = F.regexp_replace("id", "_[^_]*$", "")
    both = mates(led).select(base.alias("aid"), "ord", mate_pair().alias("pairs"), merged_extra(_noted(), F.col("m_info"), F.create_map(F.lit("vcf_filter2"), F.col("m_filter"), F.lit("external_id"), base)).alias("extra"))
    return finished(plain.unionByName(both), suffix, strip, standard=False)


def manta(recs: DataFrame, suffix: str = "", strip: bool = True) -> DataFrame:
    rows = _base(recs)
    _unknown(rows, ["BND", "INV", "DUP", "DEL", "INS"])
    if bad := rows.where((F.col("svtype") == "INV") & info("INV3").isNull() & info("INV5").isNull()).first():
        raise ValueError(f"inversion {bad['id']} is neither INV3 nor INV5")
    s1 = F.when(F.col("svtype") == "INV", F.when(info("INV3").isNotNull(), "-").otherwise("+")).when(F.col("svtype") == "DUP", "-").otherwise("+")
    s2 = F.when(F.col("svtype") == "INV", F.when(info("INV3").isNotNull(), "-").otherwise("+")).when(F.col("svtype") == "DUP", "+").otherwise("-")
    pairs = F.array(_pair(_end(F.col("chrom"), F.col("pos"), s1), _end(F.col("chrom"), F.col("end"), s2)))
    length = F.when((F.col("svtype") == "INS") & info("SVLEN").isNotNull(), F.create_map(F.lit("SVLEN"), F.split(info("SVLEN"), ",")[0])).otherwise(F.create_map().cast(_EMPTY))
    plain = rows.where("svtype <> 'BND'").select(F.col("id").alias("aid"), "ord", pairs.alias("pairs"), _noted(bases(), length).alias("extra"))
    both = mates(rows.where("svtype = 'BND'")).select(F.col("id").alias("aid"), "ord", mate_pair().alias("pairs"), _noted(F.create_map(F.lit("vcf_filter2"), F.col("m_filter"), F.lit("external_id2"), F.col("m_id"))).alias("extra"))
    return finished(plain.unionByName(both), suffix, strip)


def _long_read_ends(rows: DataFrame) -> tuple[Column, Column]:
    """Chromosome and coordinate of the second end: CHR2 and END, else by length, else from ALT."""
    seq = F.col("alt").rlike("^[A-Za-z]+$")
    by_bases = F.when(seq, F.when(F.length("ref") == 1, F.length("alt")).otherwise(F.length("ref")))
    length = F.coalesce(F.abs(info("SVLEN").try_cast("double").cast("long")), by_bases.cast("long"))
    far = F.coalesce(F.col("end"), F.col("pos") + length)
    own = F.coalesce(F.lower("svtype").rlike("ins|del"), F.lit(False))
    a_chr, a_pos = alt_place()
    chr2 = F.when(info("CHR2").isNotNull(), info("CHR2")).when(own, F.col("chrom")).otherwise(a_chr)
    return chr2, F.when(info("CHR2").isNotNull() | own, far).otherwise(a_pos)


def sniffles(recs: DataFrame, suffix: str = "", strip: bool = True) -> DataFrame:
    rows = _base(recs)
    own = F.coalesce(F.lower("svtype").rlike("ins|del"), F.lit(False))
    strands = F.coalesce(F.split(info("STRANDS"), ",")[0], F.when(own, "+-"))
    chr2, coord2 = _long_read_ends(rows)
    coord2 = F.when(F.coalesce(F.lower("svtype").contains("ins"), F.lit(False)), F.col("pos") + 1).otherwise(coord2)
    rows = rows.withColumn("strands", strands).withColumn("chr2", chr2).withColumn("coord2", coord2)
    if bad := rows.where("strands is null or coord2 is null").first():
        raise ValueError(f"no strands or no second end for {bad['id']}")
    gts = F.map_values(F.transform_values("samples", lambda k, v: F.try_element_at(v, F.lit("GT"))))
    last = F.try_element_at(gts, F.lit(-1))
    gt = F.when(last.isNotNull(), F.create_map(F.lit("OR_GT"), F.replace(last, F.lit("|"), F.lit("/")))).otherwise(F.create_map().cast(_EMPTY))
    pairs = F.array(_pair(_end(F.col("chrom"), F.col("pos"), F.substring("strands", 1, 1)), _end(F.col("chr2"), F.col("coord2"), F.substring("strands", 2, 1))))
    return finished(rows.select(F.col("id").alias("aid"), "ord", pairs.alias("pairs"), _noted(bases(), gt).alias("extra")), suffix, strip)


def survivor(recs: DataFrame, sources: dict[str, DataFrame] | None = None, suffix: str = "", strip: bool = True, prefix: str = "", sample_extras: bool = False) -> DataFrame:
    """Merged calls. ``sources``: for a sample its adjacencies, looked up by id and by coordinates
    (``chr1_coord1-chr2_coord2``); their extras are taken over where the call has none of the name, samples in order,
    with the sample's name before the key if ``sample_extras``."""
    rows = _base(recs)
    a_chr, a_pos = alt_place()
    chr2, coord2 = F.coalesce(info("CHR2"), a_chr), F.when(info("CHR2").isNotNull(), F.col("end")).otherwise(a_pos)
    strands = F.coalesce(F.split(info("STRANDS"), ",")[0], F.when(F.col("svtype") == "INS", "+-"))
    rows = rows.withColumn("strands", strands)
    if bad := rows.where("strands is null").first():
        raise ValueError(f"no strands for {bad['id']}")
    name = prefix + "_" if prefix else ""
    per = rows.select(F.col("id").alias("rid"), F.posexplode(F.map_entries("samples")).alias("pos", "e")).select("rid", "pos", F.col("e.key").alias("sample"), F.split(F.try_element_at("e.value", F.lit("ID")), ",")[0].alias("source_id"), F.split(F.try_element_at("e.value", F.lit("CO")), ",").alias("cos"))
    flags = rows.select(F.col("id").alias("rid"), F.split(info("SUPP_VEC"), "").alias("flags"))
    per = per.join(flags, "rid").withColumn("flag", F.coalesce(F.try_element_at("flags", F.col("pos") + 1).try_cast("int"), F.lit(0)))
    known = per.where("source_id is not null and source_id <> 'NaN'")
    ids = known.select("rid", "source_id")
    extras = None
    if sources:
        every = None
        for sample, adjs in sources.items():
            place = F.concat(F.col("chr1"), F.lit("_"), F.col("coord1"), F.lit("-"), F.col("chr2"), F.lit("_"), F.col("coord2"))
            own = adjs.select(F.lit(sample).alias("sample"), F.col("aid").alias("source_id"), place.alias("co"), F.coalesce(F.try_element_at("extra", F.lit("external_id")), F.col("aid")).alias("named"), "extra")
            every = own if every is None else every.unionByName(own)
        by_place = known.where(F.size("cos") > 1).select("rid", "sample", F.explode("cos").alias("co")).join(every, ["sample", "co"])
        ids = ids.unionByName(by_place.select("rid", F.col("named").alias("source_id")))
        key = lambda k: F.concat("sample", F.lit("_"), k) if sample_extras else k
        met = known.join(every.drop("co", "named"), ["sample", "source_id"]).select("rid", "pos", F.explode(F.map_entries(F.transform_keys("extra", lambda k, v: F.lower(key(k))))).alias("e"))
        first = met.groupBy("rid", F.col("e.key").alias("k")).agg(F.min_by("e.value", "pos").alias("v"))
        extras = first.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("more"))
    told = per.groupBy("rid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sample"))), lambda x: x["sample"]), ",").alias("all"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("flag") != 0, F.struct("pos", "sample")))), lambda x: x["sample"]), ",").alias("supporting"),
    )
    listed = ids.groupBy("rid").agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("ids"))
    rows = rows.join(told, F.col("id") == F.col("rid"), "left").drop("rid").join(listed, F.col("id") == F.col("rid"), "left").drop("rid")
    more = F.create_map().cast(_EMPTY)
    if extras is not None:
        rows, more = rows.join(extras, F.col("id") == F.col("rid"), "left").drop("rid"), F.col("more")
    low = F.transform_keys("info", lambda k, v: F.lower(k))
    fixed = F.create_map(F.lit(name + "supporting_source_ids"), F.coalesce("ids", F.lit("")), F.lit(name + "sources"), F.coalesce("all", F.lit("")), F.lit(name + "supporting_sources"), F.coalesce("supporting", F.lit("")), F.lit("external_id"), F.col("id"))
    pairs = F.array(_pair(_end(F.col("chrom"), F.col("pos"), F.substring("strands", 1, 1)), _end(chr2, coord2, F.substring("strands", 2, 1))))
    return finished(rows.select(F.col("id").alias("aid"), "ord", pairs.alias("pairs"), merged_extra(more, low, fixed).alias("extra")), suffix, strip)


def _present(samples: list[str], every: bool, only: bool, test, of: str = "samples") -> Column:
    held = F.transform_values(of, lambda k, v: test(F.try_element_at(v, F.lit("GT"))))
    one = [F.coalesce(F.try_element_at(held, F.lit(s)), F.lit(True)) for s in samples]
    out = one[0]
    for x in one[1:]:
        out = (out & x) if every else (out | x)
    if only:
        out = out & ~F.exists(F.map_entries(held), lambda e: ~e["key"].isin(*samples) & F.coalesce(e["value"], F.lit(False)))
    return out


def svaba(recs: DataFrame, kind: str = "sv", samples: list[str] | None = None, every: bool = False, only: bool = False, suffix: str = "", strip: bool = True) -> DataFrame:
    """``kind``: ``sv`` (pairs of breakends) or ``indel`` (typed by the lengths of REF and ALT)."""
    rows = _base(recs)
    called = lambda gt: F.coalesce(gt.rlike(r"(^|[/|])1([/|]|$)"), F.lit(False))
    if samples:
        rows = rows.where(_present(samples, every, only, called))
    if kind == "indel":
        if bad := rows.where((F.length("ref") != 1) & (F.length("alt") != 1)).first():
            raise ValueError(f"{bad['id']} is no plain insertion or deletion")
        gone = F.length("ref") > F.length("alt")
        span = F.coalesce(info("SPAN").try_cast("long"), F.lit(0))
        pairs = F.array(_pair(_end(F.col("chrom"), F.col("pos"), "+"), _end(F.col("chrom"), F.col("pos") + 1 + F.when(gone, span).otherwise(0), "-")))
        extra = _noted(F.create_map(F.lit("SVTYPE"), F.when(gone, "DEL").otherwise("INS"), F.lit("REF"), F.col("ref"), F.lit("ALT"), F.col("alt")))
        return finished(rows.select(F.col("id").alias("aid"), "ord", pairs.alias("pairs"), extra.alias("extra")), suffix, strip)
    if kind != "sv":
        raise ValueError("kind is sv or indel")
    base = F.split("id", ":")[0]
    out = mates(rows).select(base.alias("aid"), "ord", mate_pair().alias("pairs"), merged_extra(_noted(), F.col("m_info"), F.create_map(F.lit("external_id"), base)).alias("extra"))
    return finished(out, suffix, strip)


def grocsvs(recs: DataFrame, samples: list[str] | None = None, every: bool = False, only: bool = False, suffix: str = "", strip: bool = True) -> DataFrame:
    """Named by EVENT."""
    rows = _base(recs)
    _unknown(rows, ["BND"])
    pairs = mates(rows)
    if samples:
        pairs = pairs.where(_present(samples, every, only, lambda gt: gt.isin("1", ".")))
    event = info("EVENT")
    return finished(pairs.select(event.alias("aid"), "ord", mate_pair().alias("pairs"), merged_extra(_noted(), F.col("m_info"), F.create_map(F.lit("external_id"), event)).alias("extra")), suffix, strip)


def ct_strands(ct: Column) -> tuple[Column, Column]:
    """``3to5`` and so on: 3 is +."""
    return F.when(ct.startswith("3"), "+").otherwise("-"), F.when(ct.endswith("3"), "+").otherwise("-")


def delly(recs: DataFrame, suffix: str = "", strip: bool = True) -> DataFrame:
    rows = _base(recs)
    _unknown(rows, ["DEL", "DUP", "INV", "INS", "BND"])
    c1, c2 = ct_strands(info("CT"))
    t = F.col("svtype")
    s1 = F.when(t.isin("DEL", "INS"), "+").when(t == "DUP", "-").otherwise(c1)
    s2 = F.when(t.isin("DEL", "INS"), "-").when(t == "DUP", "+").otherwise(c2)
    if bad := rows.where((t != "INS") & ((s1 != c1) | (s2 != c2))).first():
        raise ValueError(f"CT of {bad['id']} is not that of a {bad['svtype']}")
    length = F.when(t.isin("DEL", "INS") & info("INSLEN").isNotNull(), F.create_map(F.lit("svlen"), info("INSLEN"))).otherwise(F.create_map().cast(_EMPTY))
    pairs = F.array(_pair(_end(F.col("chrom"), F.col("pos"), s1), _end(info("CHR2"), F.col("end"), s2)))
    return finished(rows.select(F.col("id").alias("aid"), "ord", pairs.alias("pairs"), _noted(bases(), length).alias("extra")), suffix, strip, standard=False)


def pbsv(recs: DataFrame, sample: str | None = None, suffix: str = "", strip: bool = True, skip_unknown: bool = True) -> DataFrame:
    rows = _base(recs)
    known = ["DEL", "INS", "INV", "BND", "DUP"]
    if not skip_unknown:
        _unknown(rows, known)
    rows = rows.where(F.col("svtype").isin(*known))
    entry = F.try_element_at(F.filter(F.map_entries("samples"), lambda e: F.lit(sample is None) | (F.lower(e["key"]) == (sample or "").lower())), F.lit(1))
    gt = F.try_element_at(entry["value"], F.lit("GT"))
    l, r = F.split(gt, "[/|]")[0], F.try_element_at(F.split(gt, "[/|]"), F.lit(2))
    ad = F.split(F.try_element_at(entry["value"], F.lit("AD")), ",")
    reads = F.when(l.isin("1", "."), F.coalesce(ad[0].try_cast("long"), F.lit(0))).otherwise(0) + F.when(r.isin("1", "."), F.coalesce(F.try_element_at(ad, F.lit(2)).try_cast("long"), F.lit(0))).otherwise(0)
    support = F.when(gt.isNotNull(), F.create_map(F.lit("OR_GT"), F.replace(gt, F.lit("|"), F.lit("/")), F.lit("re"), reads.cast("string"), F.lit("rcnt"), F.try_element_at(entry["value"], F.lit("DP")))).otherwise(F.create_map().cast(_EMPTY))
    t, chrom, pos, end = F.col("svtype"), F.col("chrom"), F.col("pos"), F.col("end")
    put_in = (t == "DUP") & F.lower("id").contains("ins")
    plain = F.when(put_in, F.array(_pair(_end(chrom, end, "+"), _end(chrom, end + 1, "-")))).when(t == "DUP", F.array(_pair(_end(chrom, pos, "-"), _end(chrom, end, "+"))))
    plain = plain.when(t == "INV", inversion(chrom, pos, end)).otherwise(F.array(_pair(_end(chrom, pos, "+"), _end(chrom, F.when((t == "INS") & (pos == end), end + 1).otherwise(end), "-"))))
    length = F.when((put_in | (t == "INS")) & info("SVLEN").isNotNull(), F.create_map(F.lit("SVLEN"), F.split(info("SVLEN"), ",")[0])).otherwise(F.create_map().cast(_EMPTY))
    alone = rows.where("svtype <> 'BND'").select(F.col("id").alias("aid"), "ord", plain.alias("pairs"), _noted(bases(), length, support).alias("extra"))
    both = mates(rows.where("svtype = 'BND'")).select(F.col("id").alias("aid"), "ord", mate_pair().alias("pairs"), merged_extra(_noted(support), F.col("m_info"), F.create_map(F.lit("external_id2"), F.col("m_id"))).alias("extra"))
    return finished(alone.unionByName(both), suffix, strip)


CALLERS = {"lumpy": lumpy, "longranger": longranger, "manta": manta, "sniffles": sniffles, "survivor": survivor, "svaba": svaba, "grocsvs": grocsvs, "delly": delly, "pbsv": pbsv}


def read(spark: SparkSession, path: str, caller: str, **options) -> DataFrame:
    return CALLERS[caller](records(spark, path), **options)
