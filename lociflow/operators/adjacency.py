"""Adjacencies and their breakends: canonical form, types, neighbours, clusters, merges, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions.model import adjacency_id, c, position_key, reciprocal_coord, strand_ord
from lociflow.operators.scan import running, runs


#: Positions that one task scans at a time where clusters are parted.
SPLIT_BIN = 1 << 12


def canonical(rows: DataFrame) -> DataFrame:
    """Ends in model order; everything else as it is."""
    key = lambda k: position_key(f"chr{k}", f"coord{k}", f"strand{k}")
    swap = key(1) > key(2)
    one = {f"{f}1": F.when(swap, F.col(f"{f}2")).otherwise(F.col(f"{f}1")) for f in ("chr", "coord", "strand")}
    two = {f"{f}2": F.when(swap, F.col(f"{f}1")).otherwise(F.col(f"{f}2")) for f in ("chr", "coord", "strand")}
    new = one | two
    return rows.select(*[new[x].alias(x) if x in new else F.col(x) for x in rows.columns])


def derived_type(aid: Column | str, at: Column | str | None = None) -> Column:
    """The given type, else R for ids that begin with a small r, else N."""
    own = F.when(c(aid).startswith("r"), "R").otherwise("N")
    return own if at is None else F.coalesce(c(at), own)


def breakends(adjacencies: DataFrame, *keep: str) -> DataFrame:
    """Two rows each: ``(aid, side, chr, coord, strand)``."""
    ends = F.array(*(F.struct(F.col(f"chr{k}").alias("chr"), F.col(f"coord{k}").alias("coord"), F.col(f"strand{k}").alias("strand")) for k in (1, 2)))
    return adjacencies.select("aid", *keep, F.posexplode(ends).alias("side", "e")).select("aid", *keep, "side", "e.chr", "e.coord", "e.strand")


def standard_type(or_type: Column | str, svlen: Column | str, ref: Column | str | None = None, alt: Column | str | None = None) -> Column:
    """TRA, DUP, INV, INS or DEL, by the first rule that fits: chromosomes, strands, the caller's own type, lengths of
    REF and ALT, a positive length."""
    own, inside = F.lower(c(or_type)), F.col("chr1") == F.col("chr2")
    s1, s2 = F.col("strand1"), F.col("strand2")
    out = F.when(~inside, "TRA").when((s1 == "-") & (s2 == "+"), "DUP").when(s1 == s2, "INV")
    out = out.when(F.coalesce(own.contains("ins"), F.lit(False)), "INS").when(F.coalesce(own.contains("del"), F.lit(False)), "DEL")
    if ref is not None and alt is not None:
        bases = F.coalesce(c(ref).rlike("^[A-Za-z]+$") & c(alt).rlike("^[A-Za-z]+$"), F.lit(False))
        out = out.when(bases & (F.length(c(ref)) < F.length(c(alt))), "INS").when(bases & (F.length(c(ref)) > F.length(c(alt))), "DEL")
    length = c(svlen).try_cast("double") if svlen is not None else F.lit(None).cast("double")
    return out.when(F.coalesce(length > 0, F.lit(False)), "INS").otherwise("DEL")


def numbered_ids(rows: DataFrame, id_col: str = "aid", order: str = "ord", suffix: str = "") -> DataFrame:
    """``_1``, ``_2`` ... where an id stands for several rows; then the suffix, unless the id ends with it; colons become underscores."""
    w = Window.partitionBy(id_col).orderBy(order)
    several = F.count("*").over(Window.partitionBy(id_col)) > 1
    own = F.when(several, F.concat(F.col(id_col), F.lit("_"), F.row_number().over(w).cast("string"))).otherwise(F.col(id_col))
    rows = rows.withColumn("__own", own)
    named = F.when(F.lit(bool(suffix)) & ~F.col("__own").endswith(suffix), F.concat("__own", F.lit("_" + suffix))).otherwise(F.col("__own"))
    return rows.withColumn(id_col, F.translate(named, ":", "_")).drop("__own")


def mate_join(records: DataFrame, id_col: str = "id", mate: str = "mate_id", order: str = "ord") -> DataFrame:
    """Each pair of records that name each other once, led by the first; columns of the second have the prefix ``m_``."""
    m = records.select(*[F.col(x).alias(f"m_{x}") for x in records.columns])
    return records.join(m, (F.col(mate) == F.col(f"m_{id_col}")) & (F.col(order) < F.col(f"m_{order}")))


def reused_extremities(ends: DataFrame) -> DataFrame:
    """Positions of more than one adjacency: violations of infinite sites."""
    return ends.groupBy("chr", "coord", "strand").agg(F.count_distinct("aid").alias("n")).where("n > 1")


def near_pairs(ends: DataFrame, reach: int, strict: bool = False) -> DataFrame:
    """``near_adjacencies`` of breakends."""
    p = ends.groupBy("aid").agg(*(F.max(F.when(F.col("side") == k, F.struct("chr", "strand", "coord"))).alias(f"p{k}") for k in (0, 1)))
    return near_adjacencies(p.select("aid", *(F.col(f"p{k}.{f}").alias(f"{f}{k + 1}") for k in (0, 1) for f in ("chr", "coord", "strand"))), reach, strict)


def near_adjacencies(adjacencies: DataFrame, reach: int, strict: bool = False) -> DataFrame:
    """``(aid, bid)``, aid < bid: both ends on equal chromosomes and strands within ``reach``, ends also taken crosswise.

    Ends are put in the order of chromosome, strand and coordinate; ends within reach crosswise then are so straight. Both ends together lie in cells of twice
    ``reach``: a pair shares one or lies in neighbours, of which half are looked at, each only from within reach of it. So a pair comes once from an equality
    join and isn't moved again, and 3.5 rows of an adjacency are on average.
    """
    one, two = (F.struct(*(F.col(f"{f}{k}").alias(f) for f in ("chr", "strand", "coord"))) for k in (1, 2))
    wide = 2 * max(1, reach)
    p = adjacencies.select("aid", F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
    p = p.select("aid", F.concat("x.chr", F.lit("\x1f"), "x.strand", F.lit("\x1f"), "y.chr", F.lit("\x1f"), "y.strand").alias("on"), F.col("x.coord").alias("x"), F.col("y.coord").alias("y"))
    cell = lambda e: F.floor(F.col(e) / wide).cast("long")
    p = p.withColumns({"i": cell("x"), "j": cell("y")})
    # Near to the cell before one, by x or y, is what lies at the one's beginning; near to that after it, by y, what lies at its end.
    beside = F.explode(F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))).alias("d")
    q = p.select("aid", "on", "x", "y", "i", "j", beside).select("aid", "on", "x", "y", "i", "j", "d.di", "d.dj")
    low = lambda e, c: F.col(e) - F.col(c) * wide < reach
    q = q.where(((F.col("di") == 0) | low("x", "i")) & ((F.col("dj") != 1) | low("y", "j")) & ((F.col("dj") != -1) | ((F.col("j") + 1) * wide - F.col("y") <= reach)))
    q = q.select(F.col("aid").alias("bid"), F.col("on").alias("o_on"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("i") - F.col("di")).alias("oi"), (F.col("j") - F.col("dj")).alias("oj"))
    away = lambda e: F.abs(F.col(e) - F.col(f"o{e}"))
    near = [away(e) < reach if strict else away(e) <= reach for e in "xy"]
    same = [F.col("on") == F.col("o_on"), F.col("i") == F.col("oi"), F.col("j") == F.col("oj")]
    once = (F.col("i") != cell("ox")) | (F.col("j") != cell("oy")) | (F.col("aid") < F.col("bid"))
    # Both sides are dealt by cell: sent whole, one would leave the pairs to as few tasks as the table has files.
    return p.hint("merge").join(q, [*same, *near, once]).select(F.least("aid", "bid").alias("aid"), F.greatest("aid", "bid").alias("bid"))


def clusters(ends: DataFrame, window: int = 300) -> DataFrame:
    """Breakends with ``cluster``: numbers within a chromosome, a new one where the next lies further than ``window``.

    Only distinct coordinates are scanned, however many breakends share one.
    """
    spots = runs(ends.select("chr", "coord").distinct(), ["chr"], "coord", ["coord"], F.struct("coord"), lambda p, s: s["coord"] - p["coord"] > window)
    return ends.join(spots.select("chr", "coord", F.col("run").alias("cluster")), ["chr", "coord"]).select(*ends.columns, "cluster")


def split_clusters(clustered: DataFrame) -> DataFrame:
    """Clusters parted so that each has at most one breakend of a strand; adds ``sub``, numbers within a cluster.

    A run ends where a strand repeats; within a run neighbours pair up. On dense data a cluster is a whole chromosome, so it is scanned in two levels, in bins of 4,096 positions.
    """
    by, order = ["chr", "cluster"], ["coord", strand_ord("strand"), "aid", "side"]
    rows = runs(clustered, by, "coord", order, F.struct("strand"), lambda p, s: p["strand"] == s["strand"], SPLIT_BIN)
    return running(rows, by, "coord", order, {"sub": 1 - F.col("place") % 2}, SPLIT_BIN).drop("run", "place")


def snapped(split: DataFrame) -> DataFrame:
    """``new_coord``: the truncated mean of a sub-cluster, one less for +; a breakend alone stays where it is."""
    w = Window.partitionBy("chr", "cluster", "sub")
    mean = F.floor(F.sum("coord").over(w) / F.count("*").over(w)).cast("long")
    moved = F.when(F.col("strand") == "+", mean - 1).otherwise(mean)
    return split.withColumn("new_coord", F.when(F.count("*").over(w) == 1, F.col("coord")).otherwise(moved))


def reciprocal_moves(ends: DataFrame, reach: int = 50) -> DataFrame:
    """``(chr, coord, strand, new_coord)`` of positions that face a neighbour on the other strand within ``reach`` and share no
    adjacency with it; neighbours pair greedily from the left. + goes to the middle, - next to it."""
    spots = ends.select("chr", "coord", "strand").distinct()
    # Of adjacencies with both ends within reach: how far before a position the other end lies, at most reach + 1 numbers.
    own = ends.groupBy("aid").agg(F.min_by(F.struct("chr", "coord", "strand"), "side").alias("p"), F.max_by(F.struct("chr", "coord", "strand"), "side").alias("q"))
    swap = F.struct("p.coord", strand_ord("p.strand")) > F.struct("q.coord", strand_ord("q.strand"))
    own = own.where("p.chr = q.chr and p.strand <> q.strand").select(F.when(swap, F.col("q")).otherwise(F.col("p")).alias("p"), F.when(swap, F.col("p")).otherwise(F.col("q")).alias("q"))
    tied = own.withColumn("d", F.col("q.coord") - F.col("p.coord")).where(F.col("d") <= reach).groupBy("q.chr", "q.coord", "q.strand").agg(F.collect_set("d").alias("tied"))
    spots = spots.join(tied, ["chr", "coord", "strand"], "left")
    apart = lambda p, s: (s["coord"] - p["coord"] > reach) | (s["strand"] == p["strand"]) | F.coalesce(F.array_contains(s["tied"], s["coord"] - p["coord"]), F.lit(False))
    found = runs(spots, ["chr"], "coord", ["coord", strand_ord("strand")], F.struct("coord", "strand", "tied"), apart)
    pair = found.groupBy("chr", "run", F.floor(F.col("place") / 2).alias("pair")).agg(F.min_by(F.struct("coord", "strand"), "place").alias("p"), F.max_by(F.struct("coord", "strand"), "place").alias("q"), F.count("*").alias("n")).where("n = 2")
    moves = pair.select("chr", (F.col("p.coord") + F.floor((F.col("q.coord") - F.col("p.coord")) / 2).cast("long")).alias("m"), F.explode(F.array("p", "q")).alias("p"))
    return moves.select("chr", "p.coord", "p.strand", F.when(F.col("p.strand") == "+", F.col("m")).otherwise(F.col("m") + 1).alias("new_coord"))


def with_moves(adjacencies: DataFrame, moves: DataFrame) -> DataFrame:
    """Coordinates replaced by their ``new_coord``; the ends keep their places."""
    for k in (1, 2):
        m = moves.select(F.col("chr").alias(f"chr{k}"), F.col("coord").alias(f"coord{k}"), F.col("strand").alias(f"strand{k}"), "new_coord")
        adjacencies = adjacencies.join(m, [f"chr{k}", f"coord{k}", f"strand{k}"], "left").withColumn(f"coord{k}", F.coalesce("new_coord", f"coord{k}")).drop("new_coord")
    return adjacencies


def reciprocal(adjacencies: DataFrame, reach: int = 50) -> DataFrame:
    return with_moves(adjacencies, reciprocal_moves(breakends(adjacencies), reach))


def updated(target: DataFrame, source: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, coordinates: bool = True) -> DataFrame:
    """One row for each of ``target``; coordinates, strands and extras of the source's row of the same id, where there is one.

    ``include``: just these keys of the extra map; ``exclude``: all but these.
    """
    places = [f"{f}{k}" for k in (1, 2) for f in ("chr", "coord", "strand")]
    s = source.select("aid", *[F.col(p).alias(f"s_{p}") for p in places], *([F.col("extra").alias("s_extra")] if "extra" in source.columns else []))
    rows = target.join(s, "aid", "left")
    cols = [F.coalesce(f"s_{x}", x).alias(x) if coordinates and x in places else F.col(x) for x in target.columns if x != "extra"]
    if "extra" in target.columns and "extra" in source.columns:
        new = F.coalesce("s_extra", F.create_map().cast("map<string,string>"))
        if include is not None:
            new = F.map_filter(new, lambda k, v: k.isin(*include))
        if exclude is not None:
            new = F.map_filter(new, lambda k, v: ~k.isin(*exclude))
        old = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(new, k))
        cols.append(F.map_concat(old, new).alias("extra"))
    elif "extra" in target.columns:
        cols.append(F.col("extra"))
    return rows.select(*cols)


def concatenated(tables: list[DataFrame], unique: str | None = None, id_col: str = "aid") -> DataFrame:
    """All rows of all tables. ``unique='skip'`` keeps an id's row of the first table (within one, the least row); ``'error'`` raises on a repeat."""
    out = None
    for n, t in enumerate(tables):
        t = t.withColumn("__n", F.lit(n))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if unique is None:
        return out.drop("__n")
    if unique == "error":
        if bad := out.groupBy(id_col).count().where("count > 1").first():
            raise ValueError(f"repeated id {bad[id_col]}")
        return out.drop("__n")
    cols = [x for x in out.columns if x not in ("__n", "extra")]
    w = Window.partitionBy(id_col).orderBy("__n", *cols)
    return out.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__n", "__k")


def neighbours(ends: DataFrame) -> DataFrame:
    """Breakends with ``rank``: dense number of the position along its chromosome."""
    place = ["chr", "coord", "strand"]
    spots = runs(ends.select(*place).distinct(), ["chr"], "coord", ["coord", strand_ord("strand")], F.struct("coord"), lambda p, s: F.lit(True))
    return ends.join(spots.select(*place, F.col("run").alias("rank")), place).select(*ends.columns, "rank")


def short_labelings(adjacencies: DataFrame, longest: int = 1000, over_same: bool = False, over_tra: bool = False, inversions: bool = True) -> DataFrame:
    """Adjacencies within a chromosome, of at most ``longest``, whose ends are neighbours among all positions: both on one haplotype.

    A position that several adjacencies have counts as often, so an end shared with others is no neighbour. What lies between the ends, or
    shares the second one, is allowed if it has adjacencies within a chromosome (``over_same``) or across two (``over_tra``). Without ``inversions``
    equal strands are left out. Of adjacencies at the same two positions one is taken, that of the least id.
    """
    place = ["chr", "coord", "strand"]
    ends = breakends(adjacencies.withColumn("tra", F.col("chr1") != F.col("chr2")), "tra")
    spots = ends.groupBy(*place).agg(F.count("*").alias("m"), F.max(F.when(F.col("tra"), 1).otherwise(0)).alias("t"), F.max(F.when(F.col("tra"), 0).otherwise(1)).alias("s"))
    # Of all up to a position, so what lies between two is a difference.
    upto = running(spots, ["chr"], "coord", ["coord", strand_ord("strand")], {"entries": F.col("m"), "same": F.col("s"), "across": F.col("t")})
    side = lambda k: upto.select(*(F.col(c).alias(f"{c}{k}") for c in (*place, "m", "s", "t", "entries", "same", "across")))
    own = adjacencies.where((F.col("chr1") == F.col("chr2")) & (F.abs(F.col("coord1") - F.col("coord2")) <= longest) & (F.lit(inversions) | (F.col("strand1") != F.col("strand2"))))
    ways = [f"{c}{k}" for k in (1, 2) for c in place]
    own = own.groupBy(*ways).agg(F.min("aid").alias("aid")).join(side(1), [f"{c}1" for c in place]).join(side(2), [f"{c}2" for c in place])
    shared = F.col("m2") > 1
    between = lambda name, flag: (F.col(f"{name}2") - F.col(f"{flag}2") > F.col(f"{name}1")) | (shared & (F.col(f"{flag}2") == 1))
    apart = F.col("entries2") - F.col("entries1")
    allowed = F.lit(over_same) & between("same", "s") | F.lit(over_tra) & between("across", "t")
    own = own.where((apart == 1) | ((apart > 1) & allowed))
    return own.select(F.concat(F.lit("sl_"), "aid").alias("gid"), F.array("aid", "aid").alias("aids"), F.array(F.lit(0), F.lit(1)).alias("agl"))


def stable_ids(adjacencies: DataFrame) -> DataFrame:
    return adjacencies.withColumn("stable_id", adjacency_id("at") if "at" in adjacencies.columns else adjacency_id())


def faced(ends: DataFrame) -> DataFrame:
    """The position that each breakend faces in the reference."""
    return ends.select("aid", "side", "chr", reciprocal_coord("coord", "strand").alias("coord"), F.when(F.col("strand") == "+", "-").otherwise("+").alias("strand"))


def sampled(rows: DataFrame, n: int, id_col: str = "aid", seed: int = 7) -> DataFrame:
    """``n`` rows whose ids have the least hashes (all, if fewer): a sample that doesn't depend on the layout. Each task keeps ``n`` at most."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)
