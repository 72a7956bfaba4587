"""Copy numbers as tidy rows: sums, distances, accuracy, bounds."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions.model import HAPLOTYPES, segment_length


def looked_up(keys: DataFrame, tensor: DataFrame, on: list[str]) -> DataFrame:
    """Copy numbers of the keys, 0 where the tensor has none."""
    return keys.join(tensor, on, "left").withColumn("cn", F.coalesce("cn", F.lit(0)))


def summed(tensor: DataFrame, by: list[str]) -> DataFrame:
    """Over haplotypes or phasings (``by`` a clone), or over several tensors."""
    return tensor.groupBy(*by).agg(F.sum("cn").cast("long").alias("cn"))


def haploid(tensor: DataFrame, key: str, part: str) -> DataFrame:
    """All copies on A (or AA), the form of a haploid tensor."""
    name = "A" if part == "hap" else "AA"
    return summed(tensor, [key, "clone"]).select(key, "clone", F.lit(name).alias(part), "cn")


def combined(tensors: list[DataFrame], key: str, part: str, parts: tuple[str, ...] = HAPLOTYPES) -> DataFrame:
    """The sum of profiles, over the given haplotypes or phasings only."""
    out = tensors[0]
    for t in tensors[1:]:
        out = out.unionByName(t)
    return summed(out.where(F.col(part).isin(*parts)), [key, "clone", part])


def of_genome(walks: DataFrame, by: list[str]) -> DataFrame:
    """How often each segment or adjacency is walked."""
    return walks.groupBy(*by).agg(F.count("*").alias("cn"))


def clone_lengths(scnt: DataFrame, segments: DataFrame) -> DataFrame:
    return scnt.join(segments, "sid").groupBy("clone").agg(F.sum(F.col("cn") * segment_length()).cast("long").alias("length"))


def max_cn(scnt: DataFrame, by: list[str]) -> DataFrame:
    """The largest copy number, -1 without any."""
    return scnt.groupBy(*by).agg(F.coalesce(F.max("cn"), F.lit(-1)).alias("max_cn"))


def wide(scnt: DataFrame, segments: DataFrame) -> DataFrame:
    """``(sid, length, clone, a, b)``; 0 for what is absent."""
    of = lambda h: F.coalesce(F.sum(F.when(F.col("hap") == h, F.col("cn"))), F.lit(0)).cast("long")
    return scnt.groupBy("sid", "clone").agg(of("A").alias("a"), of("B").alias("b")).join(segments.select("sid", segment_length().alias("length")), "sid")


def distance_within(scnt: DataFrame, segments: DataFrame) -> DataFrame:
    """``(clone1, clone2, distance)`` for each pair of a sample's clones: sum of length * (|difference of A| + |of B|)."""
    w = wide(scnt, segments)
    x, y = w.alias("x"), w.alias("y")
    pairs = x.join(y, (F.col("x.sid") == F.col("y.sid")) & (F.col("x.clone") < F.col("y.clone")))
    part = F.col("x.length") * (F.abs(F.col("x.a") - F.col("y.a")) + F.abs(F.col("x.b") - F.col("y.b")))
    return pairs.groupBy(F.col("x.clone").alias("clone1"), F.col("y.clone").alias("clone2")).agg(F.sum(part).cast("long").alias("distance"))


def pair_costs(one: DataFrame, two: DataFrame, segments: DataFrame, fragments: DataFrame) -> DataFrame:
    """``(fid, clone1, clone2, ab, ba)``: cost of each pair of clones with two's haplotypes as they are and swapped, by fragment.

    ``fragments`` maps sid to fid. Computed once; each matching of clones is a sum of these.
    """
    x, y = wide(one, segments).alias("x"), wide(two, segments).alias("y")
    rows = x.join(y, F.col("x.sid") == F.col("y.sid")).join(fragments.alias("f"), F.col("f.sid") == F.col("x.sid"))
    cost = lambda p, q: F.sum(F.col("x.length") * (F.abs(F.col("x.a") - F.col(p)) + F.abs(F.col("x.b") - F.col(q)))).cast("long")
    return rows.groupBy(F.col("f.fid").alias("fid"), F.col("x.clone").alias("clone1"), F.col("y.clone").alias("clone2")).agg(cost("y.a", "y.b").alias("ab"), cost("y.b", "y.a").alias("ba"))


def matchings(clones1: list[str], clones2: list[str]) -> list[list[tuple[str, str]]]:
    """All one-to-one pairings that use every clone of the smaller side, in order."""
    m = min(len(clones1), len(clones2))
    return [list(zip(a, b)) for a in combinations(sorted(clones1), m) for b in permutations(sorted(clones2), m)]


def distance_between(costs: DataFrame, cases: list[list[tuple[str, str]]], top: int | None = None) -> DataFrame:
    """``(case_id, clone1, clone2, distance, total)``: a fragment is oriented once for all clones of a case, by the smaller sum (a tie: as it is)."""
    spark = costs.sparkSession
    rows = [(i, a, b) for i, case in enumerate(cases) for a, b in case]
    asked = spark.createDataFrame(rows, "case_id int, clone1 string, clone2 string")
    own = asked.join(costs, ["clone1", "clone2"])
    w = Window.partitionBy("case_id", "fid")
    chosen = own.withColumn("d", F.when(F.sum("ab").over(w) <= F.sum("ba").over(w), F.col("ab")).otherwise(F.col("ba")))
    per = chosen.groupBy("case_id", "clone1", "clone2").agg(F.sum("d").cast("long").alias("distance"))
    total = per.groupBy("case_id").agg(F.sum("distance").cast("long").alias("total"))
    if top is not None:
        total = total.orderBy("total", "case_id").limit(top)
    return per.join(total, "case_id")


def accuracy(truth: DataFrame, inferred: DataFrame, segments: DataFrame) -> DataFrame:
    """``(precision, recall)``, means weighted by length: per segment, sets of (a, b) over clones are compared, with the
    inferred haplotypes as they are if that has the higher F-score, else swapped."""
    sets = lambda df, name: wide(df, segments).groupBy("sid", "length").agg(
        F.collect_set(F.struct(F.col("a").alias("p"), F.col("b").alias("q"))).alias(name), F.collect_set(F.struct(F.col("b").alias("p"), F.col("a").alias("q"))).alias(name + "_r")
    )
    t, i = sets(truth, "t"), sets(inferred, "i").drop("length")
    rows = t.join(i, "sid")
    pr = lambda side: (F.size(F.array_intersect("t", side)) / F.size(side), F.size(F.array_intersect("t", side)) / F.size("t"))
    f = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    (p1, r1), (p2, r2) = pr("i"), pr("i_r")
    better = f(p1, r1) > f(p2, r2)
    rows = rows.select("length", F.when(better, p1).otherwise(p2).alias("p"), F.when(better, r1).otherwise(r2).alias("r"))
    mean = lambda x: F.sum(F.col("length") * F.col(x)) / F.sum("length")
    return rows.agg(mean("p").alias("precision"), mean("r").alias("recall"))


def compatible(one: DataFrame, two: DataFrame, segments: DataFrame) -> DataFrame:
    """``(compatible,)``: equal everywhere, up to a swap of haplotypes by segment and clone."""
    x, y = wide(one, segments), wide(two, segments).select("sid", "clone", F.col("a").alias("c"), F.col("b").alias("d"))
    both = x.join(y, ["sid", "clone"], "full")
    z = lambda k: F.coalesce(k, F.lit(0))
    same = ((z("a") == z("c")) & (z("b") == z("d"))) | ((z("a") == z("d")) & (z("b") == z("c")))
    return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("compatible"))


def length_rule(length: Column, cn: Column) -> tuple[Column, Column]:
    """Bounds by length: short segments may be anything to 20, long ones stay near their copy number."""
    spread = F.when(length < 10**6, 3).when(length < 10**7, 2).otherwise(1)
    short = length < 10**5
    low, high = cn - spread, cn + spread
    return F.when(short, 0).otherwise(F.greatest(low, F.lit(0))).cast("long"), F.when(short, 20).otherwise(high).cast("long")


def bounds(
    scnt: DataFrame,
    segments: DataFrame,
    strategy: str,
    low: int = 0,
    high: int = 10,
    spread: int = 1,
    zero_for_positive: tuple[int, int] = (-1, 10**9),
    positive_for_zero: tuple[int, int] = (-1, 10**9),
    sex: str | None = None,
) -> DataFrame:
    """``(sid, clone, hap, l, u)`` for each segment, clone of ``scnt`` and haplotype, by strategy: ``fix`` (the copy number itself),
    ``uniform-spread`` (around it), ``length-spread`` (``length_rule``), ``uniform-min-max``. An absent copy number is 0.

    Only on segments whose length lies within ``zero_for_positive`` may a bound be 0 where there are copies (elsewhere it
    is 1), and only within ``positive_for_zero`` may it be more than 0 where there are none. ``sex='m'`` fixes haplotype B
    of chromosomes with an x in their name, in any case, to none.
    """
    if sex not in (None, "m", "f"):
        raise ValueError("sex is m or f")
    haps = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("hap")
    every = segments.select("sid", "chr", segment_length().alias("length")).crossJoin(F.broadcast(scnt.select("clone").distinct())).select("*", haps)  # a handful of clones
    cn, length = F.coalesce("cn", F.lit(0)), F.col("length")
    if strategy == "fix":
        l, u = cn, cn
    elif strategy == "uniform-spread":
        l, u = F.greatest(cn - spread, F.lit(0)), cn + spread
    elif strategy == "length-spread":
        l, u = length_rule(length, cn)
    elif strategy == "uniform-min-max":
        l, u = F.lit(low), F.lit(high)
    else:
        raise ValueError(f"no strategy {strategy}")
    gone = F.lower("chr").contains("x") & (F.col("hap") == "B") if sex == "m" else F.lit(False)

    def guarded(x):
        x = F.when((x == 0) & (cn > 0) & ~length.between(*zero_for_positive), 1).otherwise(x)
        x = F.when((x > 0) & (cn == 0) & ~length.between(*positive_for_zero), 0).otherwise(x)
        return F.when(gone, 0).otherwise(x).cast("long")

    return every.join(scnt, ["sid", "clone", "hap"], "left").select("sid", "clone", "hap", guarded(l).alias("l"), guarded(u).alias("u"))


def overlaid(base: DataFrame, over: DataFrame) -> DataFrame:
    """Bounds of ``over`` where it has them, else those of ``base``."""
    o = over.select("sid", "clone", "hap", F.col("l").alias("ol"), F.col("u").alias("ou"))
    return base.join(o, ["sid", "clone", "hap"], "left").select("sid", "clone", "hap", F.coalesce("ol", "l").alias("l"), F.coalesce("ou", "u").alias("u"))


def bound_violations(scnt: DataFrame, scnb: DataFrame, exchanged: DataFrame | None = None) -> DataFrame:
    """``(clone, sid)`` where a copy number lies outside its bounds ``(sid, clone, hap, l, u)``. On the segments of ``exchanged``
    (sid) haplotype A of the copies is B of the bounds."""
    own = scnb.select("sid", "clone", "hap", "l", "u")
    if exchanged is not None:
        turned = exchanged.select("sid", F.lit(True).alias("turned")).distinct()
        hap = F.when(F.col("turned"), F.translate("hap", "AB", "BA")).otherwise(F.col("hap"))
        own = own.join(turned, "sid", "left").select("sid", "clone", hap.alias("hap"), "l", "u")
    outside = ~F.col("cn").between(F.col("l"), F.col("u"))
    return scnt.join(own, ["sid", "clone", "hap"]).where(outside).select("clone", "sid").distinct()
