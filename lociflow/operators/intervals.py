"""Closed intervals on chromosomes: range joins, overlap checks, merging, filling, cutting, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions.model import position_key, segment_id
from lociflow.operators.scan import beside, runs
from lociflow.shared import cut as written

#: Widths of bins, narrowest first. An interval lies in bins of the first width of which it spans few, so
#: intervals of any size lie in few bins and a point in one of each width.
WIDTHS = tuple(1 << b for b in range(13, 33, 3))
FEW = 4


def _level(start: Column, end: Column) -> Column:
    out = F.lit(len(WIDTHS) - 1)
    for k, w in reversed(list(enumerate(WIDTHS[:-1]))):
        out = F.when(end - start < FEW * w, k).otherwise(out)
    return out


def _width(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WIDTHS)), level + 1)


def _bin(x: Column, width: Column) -> Column:
    return F.floor(x / width).cast("long")


def point_join(points: DataFrame, intervals: DataFrame, chr_="chr", coord="coord", i_chr="i_chr", i_start="i_start", i_end="i_end", how: str = "inner") -> DataFrame:
    """Points in closed intervals of their chromosome. Inner, left_semi or left_anti; the columns' names must differ.

    An equality join on chromosome, width and bin with the exact test beside it: no pair outside a shared bin
    is looked at, and no side is broadcast unless Spark finds it small.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(len(WIDTHS) - 1)))
    if how != "inner":
        points = points.withColumn("__row", F.struct(*points.columns))
    p = points.withColumn("__l", levels).withColumn("__b", _bin(F.col(coord), _width(F.col("__l"))))
    i = intervals.withColumn("__il", _level(F.col(i_start), F.col(i_end)))
    i = i.withColumn("__ib", F.explode(F.sequence(_bin(F.col(i_start), _width(F.col("__il"))), _bin(F.col(i_end), _width(F.col("__il"))))))
    same = (F.col(chr_) == F.col(i_chr)) & (F.col("__l") == F.col("__il")) & (F.col("__b") == F.col("__ib"))
    inside = (F.col(coord) >= F.col(i_start)) & (F.col(coord) <= F.col(i_end))
    found = p.join(i, same & inside)
    if how == "inner":
        return found.drop("__l", "__b", "__il", "__ib")
    hit = found.select("__row").distinct().withColumnRenamed("__row", "__hit")
    return points.join(hit, F.col("__row").eqNullSafe(F.col("__hit")), how).drop("__row")


def overlap_join(left: DataFrame, right: DataFrame, chr_="chr", start="start", end="end", i_chr="i_chr", i_start="i_start", i_end="i_end") -> DataFrame:
    """Pairs of closed intervals that share a coordinate. The bin of the later start decides, so a pair comes once."""
    cover = lambda df, s, e, level, name: df.withColumn(name, F.explode(F.sequence(_bin(F.col(s), level), _bin(F.col(e), level))))
    a = left.withColumn("__al", _level(F.col(start), F.col(end)))
    b = right.withColumn("__bl", _level(F.col(i_start), F.col(i_end)))
    # Both sides meet at the wider of their widths: a narrow one is listed at its own and every wider one.
    up = lambda own: F.explode(F.sequence(own, F.lit(len(WIDTHS) - 1)))
    a, b = a.withColumn("__l", up(F.col("__al"))), b.withColumn("__m", up(F.col("__bl")))
    a = cover(a, start, end, _width(F.col("__l")), "__x")
    b = cover(b, i_start, i_end, _width(F.col("__m")), "__y")
    same = (F.col(chr_) == F.col(i_chr)) & (F.col("__l") == F.col("__m")) & (F.col("__x") == F.col("__y"))
    once = (F.col("__l") == F.greatest("__al", "__bl")) & (F.col("__x") == _bin(F.greatest(start, i_start), _width(F.col("__l"))))
    touch = (F.col(start) <= F.col(i_end)) & (F.col(end) >= F.col(i_start))
    return a.join(b, same & once & touch).drop("__al", "__bl", "__l", "__m", "__x", "__y")


def overlapping_segments(segments: DataFrame) -> DataFrame:
    """Segments that begin before the one before them on the chromosome has ended, with that end."""
    rows = beside(segments, ["chr"], "start", ["start", "end", "sid"], F.struct("end"))
    return rows.withColumn("previous_end", F.col("before.end")).where(F.col("previous_end") >= F.col("start")).drop("before", "after")


def reference_adjacencies(segments: DataFrame) -> DataFrame:
    """Between neighbours on a chromosome; named r1, r2, ... by chromosome (as text), start and end."""
    pairs = beside(segments.select("chr", "start", "end"), ["chr"], "start", ["start", "end"], F.struct("start")).where("after is not null")
    numbered = runs(pairs.select("chr", "start", "end", F.col("end").alias("coord1"), F.col("after.start").alias("coord2")), ["chr"], "start", ["start", "end"], F.struct("start"), lambda p, s: F.lit(True))
    # Numbers run within chromosomes and are shifted by those before: one row a chromosome.
    counts = segments.groupBy("chr").agg((F.count("*") - 1).alias("n"))
    before = counts.select("chr", F.coalesce(F.sum("n").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = numbered.join(before, "chr").select(F.concat(F.lit("r"), (F.col("run") + F.col("before")).cast("string")).alias("aid"), "chr", "coord1", "coord2")
    return out.select("aid", F.col("chr").alias("chr1"), "coord1", F.lit("+").alias("strand1"), F.col("chr").alias("chr2"), "coord2", F.lit("-").alias("strand2"), F.lit("R").alias("at"))


def reference_telomeres(segments: DataFrame) -> DataFrame:
    ends = segments.groupBy("chr").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    return ends.select("chr", F.explode(F.array(F.struct(F.col("low").alias("coord"), F.lit("-").alias("strand")), F.struct(F.col("high").alias("coord"), F.lit("+").alias("strand")))).alias("t")).select("chr", "t.coord", "t.strand")


def walk_adjacencies(genome: DataFrame) -> DataFrame:
    """Of ``(genome, chrom, pos, chr, start, end, reversed)`` walks: the adjacency from each segment to the next."""
    w = Window.partitionBy("genome", "chrom").orderBy("pos")
    out = F.struct(F.col("chr"), F.when(F.col("reversed"), F.col("start")).otherwise(F.col("end")).alias("coord"), F.when(F.col("reversed"), "-").otherwise("+").alias("strand"))
    into = F.struct(F.col("chr"), F.when(F.col("reversed"), F.col("end")).otherwise(F.col("start")).alias("coord"), F.when(F.col("reversed"), "+").otherwise("-").alias("strand"))
    pairs = genome.withColumn("a", out).withColumn("b", F.lead(into).over(w)).where("b is not null")
    swapped = position_key("a.chr", "a.coord", "a.strand") > position_key("b.chr", "b.coord", "b.strand")
    pairs = pairs.withColumn("p", F.when(swapped, F.col("b")).otherwise(F.col("a"))).withColumn("q", F.when(swapped, F.col("a")).otherwise(F.col("b")))
    return pairs.select("genome", "chrom", "pos", *[F.col(f"{x}.{f}").alias(f"{f}{i}") for i, x in ((1, "p"), (2, "q")) for f in ("chr", "coord", "strand")])


def walk_telomeres(genome: DataFrame) -> DataFrame:
    """First and last extremity of each walk."""
    first = F.struct(F.col("chr"), F.when(F.col("reversed"), F.col("end")).otherwise(F.col("start")).alias("coord"), F.when(F.col("reversed"), "+").otherwise("-").alias("strand"))
    last = F.struct(F.col("chr"), F.when(F.col("reversed"), F.col("start")).otherwise(F.col("end")).alias("coord"), F.when(F.col("reversed"), "-").otherwise("+").alias("strand"))
    ends = genome.groupBy("genome", "chrom").agg(F.min_by(first, "pos").alias("t0"), F.max_by(last, "pos").alias("t1"))
    return ends.select("genome", "chrom", F.explode(F.array("t0", "t1")).alias("t")).select("genome", "chrom", "t.*")


def vectors(scnt: DataFrame) -> DataFrame:
    """``(sid, cns)``: a segment's copy numbers as one array in order of clone, A before B; absent ones are 0."""
    both = scnt.groupBy("sid", "clone").agg(*(F.sum(F.when(F.col("hap") == h, F.col("cn")).otherwise(0)).alias(h) for h in "AB"))
    return both.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("clone", "A", "B"))).alias("cns"))


def tidy(rows: DataFrame) -> DataFrame:
    """``(sid, clone, hap, cn)`` of rows with ``sid`` and ``cns``."""
    one = rows.select("sid", F.explode("cns").alias("x"))
    return one.select("sid", "x.clone", F.explode(F.create_map(F.lit("A"), F.col("x.A"), F.lit("B"), F.col("x.B"))).alias("hap", "cn"))


def extended_outermost(segments: DataFrame, ends: DataFrame, margin: int = 0) -> DataFrame:
    """A chromosome's first segment that starts after ``low`` of ``ends`` (chr, low, high) starts ``margin`` before it, at 0 at
    least; its last one that ends before ``high`` ends ``margin`` after it. None becomes shorter; other columns are kept."""
    outer = segments.groupBy("chr").agg(F.min("start").alias("__first"), F.max("end").alias("__last"))
    rows = segments.join(outer.join(ends.select("chr", F.col("low").alias("__low"), F.col("high").alias("__high")), "chr", "left"), "chr", "left")
    start = F.when((F.col("start") == F.col("__first")) & (F.col("start") > F.col("__low")), F.greatest(F.col("__low") - margin, F.lit(0))).otherwise(F.col("start"))
    end = F.when((F.col("end") == F.col("__last")) & (F.col("end") < F.col("__high")), F.col("__high") + margin).otherwise(F.col("end"))
    return rows.withColumns({"start": start.cast("long"), "end": end.cast("long")}).select(*segments.columns)


def refined(
    segments: DataFrame, scnt: DataFrame, merge: bool = True, max_merge_gap: int = 10**9, fill: bool = True, max_fill_gap: int = 10**9, outermost: DataFrame | None = None, margin: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbours of equal copy numbers merged, then gaps filled to the middle; with ``outermost`` the ends of chromosomes are
    extended (``extended_outermost``) first.

    Returns segments (sid, chr, start, end), their tidy copy numbers, and the mapping (sid, old_sid). A gap is
    ``start - end before``: up to ``max_merge_gap`` it is merged over; from 2 to ``max_fill_gap`` it is halved, the
    left part being ``gap div 2`` longer. Overlapping segments raise an error.
    """
    if outermost is not None:
        segments = extended_outermost(segments, outermost, margin)
    rows = segments.join(vectors(scnt), "sid", "left")

    def apart(p, s):
        gap = s["start"] - p["end"]
        wrong = F.raise_error(F.concat(F.lit("overlapping segments at "), s["sid"])).cast("boolean")
        return F.when(gap <= 0, wrong).otherwise(F.lit(not merge) | (gap > max_merge_gap) | ~s["cns"].eqNullSafe(p["cns"]))

    islands = runs(rows, ["chr"], "start", ["start", "end", "sid"], F.struct("start", "end", "cns", "sid"), apart)
    islands = written(islands.select("chr", "start", "end", "cns", "sid", "run"), "islands")  # read three times
    merged = islands.groupBy("chr", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("cns").alias("cns"))
    if fill:
        merged = beside(merged, ["chr"], "start", ["start"], F.struct("start", "end"))
        fits = lambda d: (d >= 2) & (d <= max_fill_gap)
        half = lambda d: F.floor(d / 2).cast("long")
        after, ahead = F.col("after.start") - F.col("end"), F.col("start") - F.col("before.end")
        merged = merged.select(
            "chr",
            "run",
            F.when(fits(ahead), F.col("before.end") + half(ahead) + 1).otherwise(F.col("start")).alias("start"),
            F.when(fits(after), F.col("end") + half(after)).otherwise(F.col("end")).alias("end"),
            "cns",
        )
    merged = written(merged.withColumn("sid", segment_id()), "merged")
    mapping = islands.select("chr", "run", F.col("sid").alias("old_sid")).join(merged.select("chr", "run", "sid"), ["chr", "run"]).select("sid", "old_sid")
    return merged.select("sid", "chr", "start", "end"), tidy(merged), mapping


def cut_points(positions: DataFrame) -> DataFrame:
    """``(i_chr, c)``: the last coordinate before each cut, after x for + and before x for -."""
    return positions.select(F.col("chr").alias("i_chr"), F.when(F.col("strand") == "+", F.col("coord")).otherwise(F.col("coord") - 1).alias("c")).distinct()


def cut_segments(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """``(sid, chr, start, end, fid)``: segments cut at the positions; ``fid`` is what each was cut from.

    Positions outside the segments cut nothing. A parent's pieces are ordered within the parent, so
    chromosomes are no unit of work.
    """
    points = cut_points(positions).select(F.col("i_chr").alias("p_chr"), "c")
    inner = point_join(points, segments.select(F.col("sid").alias("fid"), F.col("chr").alias("i_chr"), F.col("start").alias("i_start"), (F.col("end") - 1).alias("i_end"), F.col("end").alias("f_end")).where("i_start <= i_end"), "p_chr", "c")
    starts = inner.select("fid", F.col("p_chr").alias("chr"), (F.col("c") + 1).alias("start"), "f_end")
    starts = starts.unionByName(segments.select(F.col("sid").alias("fid"), "chr", "start", F.col("end").alias("f_end")))
    w = Window.partitionBy("fid").orderBy("start")
    out = starts.withColumn("end", F.coalesce(F.lead("start").over(w) - 1, F.col("f_end")))
    return out.select(segment_id().alias("sid"), "chr", "start", "end", "fid")


def outside(positions: DataFrame, segments: DataFrame) -> DataFrame:
    """Positions in no segment."""
    return point_join(positions, segments.select(F.col("chr").alias("i_chr"), F.col("start").alias("i_start"), F.col("end").alias("i_end")), how="left_anti")


def refined_at(segments: DataFrame, scnt: DataFrame, positions: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments cut at the positions, copy numbers of the parents, and (sid, old_sid).

    ``strict``: a position outside every segment is an error.
    """
    if strict and (lost := outside(positions, segments).first()):
        raise ValueError(f"no segment holds {lost['chr']}:{lost['strand']}{lost['coord']}")
    cut = cut_segments(segments, positions)
    cn = cut.select("sid", "fid").join(scnt.withColumnRenamed("sid", "fid"), "fid").select("sid", "clone", "hap", "cn")
    return cut.drop("fid"), cn, cut.select("sid", F.col("fid").alias("old_sid"))


def refined_input(
    segments: DataFrame, scnt: DataFrame, adjacencies: DataFrame, telomeres: DataFrame | None = None, strict: bool = True, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(fragments, segments, scnt)`` that an inference starts from: neighbours of equal copy numbers merged and gaps filled (``refined``,
    with its ``options``) give the fragments, which are then cut at the ends of the adjacencies and at the telomeres. Segments have ``fid``, their fragment."""
    fragments, copies, _ = refined(segments, scnt, **options)
    ends = adjacencies.select(F.explode(F.array(*(F.struct(F.col(f"chr{k}").alias("chr"), F.col(f"coord{k}").alias("coord"), F.col(f"strand{k}").alias("strand")) for k in (1, 2)))).alias("e")).select("e.*")
    positions = ends if telomeres is None else ends.unionByName(telomeres.select("chr", "coord", "strand"))
    new, own, mapping = refined_at(fragments, copies, positions.distinct(), strict)
    return fragments, new.join(mapping.withColumnRenamed("old_sid", "fid"), "sid"), own


def inherited_bounds(scnb: DataFrame, mapping: DataFrame, order: DataFrame) -> DataFrame:
    """Bounds of new segments: of the first of their old segments, in ``order`` (old_sid, ord), that has one."""
    rows = mapping.join(order, "old_sid").join(scnb.withColumnRenamed("sid", "old_sid"), "old_sid")
    return rows.groupBy("sid", "clone", "hap", "bound").agg(F.min_by("value", "ord").alias("value"))


def aligned(samples: DataFrame, scnt: DataFrame, fill: bool = True, max_fill_gap: int = 10**9) -> tuple[DataFrame, DataFrame]:
    """Samples cut on the grid of all their boundaries; ``samples`` and ``scnt`` have a ``sample`` column.

    Gaps are filled first; then the outermost ends of a chromosome are moved to the outermost of any sample.
    A chromosome that a sample lacks stays absent there. All samples run in one plan.
    """
    name = lambda df: df.withColumn("chr", F.concat_ws("\x1f", "sample", "chr"))
    key = lambda df: df.withColumn("sid", F.concat_ws("\x1f", "sample", "sid"))
    rows = key(name(samples)).select("sid", "chr", "start", "end")
    segs, cn, _ = refined(rows, key(scnt).select("sid", "clone", "hap", "cn"), merge=False, fill=fill, max_fill_gap=max_fill_gap)
    part = lambda i: F.split("chr", "\x1f")[i]
    segs = segs.withColumn("sample", part(0)).withColumn("own", part(1))
    outer = segs.groupBy("chr", "own").agg(F.min("start").alias("__f"), F.max("end").alias("__l"))
    every = outer.groupBy("own").agg(F.min("__f").alias("__low"), F.max("__l").alias("__high"))
    segs = segs.join(outer.join(every, "own").drop("own"), "chr")
    segs = segs.withColumn("start", F.when(F.col("start") == F.col("__f"), F.col("__low")).otherwise(F.col("start"))).withColumn("end", F.when(F.col("end") == F.col("__l"), F.col("__high")).otherwise(F.col("end")))
    ends = segs.select("own", F.explode(F.array(F.struct(F.col("start").alias("coord"), F.lit("-").alias("strand")), F.struct(F.col("end").alias("coord"), F.lit("+").alias("strand")))).alias("p"))
    grid = ends.select(F.col("own"), "p.coord", "p.strand").distinct()
    owners = segs.select("chr", "sample", "own").distinct()
    points = owners.join(grid, "own").select("chr", "coord", "strand")
    cut = cut_segments(segs.select("sid", "chr", "start", "end"), points).withColumn("sample", part(0)).withColumn("chr", part(1))
    copies = cut.select("sample", "chr", "start", "end", "fid").join(cn.withColumnRenamed("sid", "fid"), "fid")
    new = lambda df: df.withColumn("sid", segment_id())
    return new(cut.drop("fid", "sid")).select("sample", "sid", "chr", "start", "end"), new(copies).select("sample", "sid", "clone", "hap", "cn")


def spanned_extremities(segments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Segment ends that lie in any of the boundaries (chr, start, end)."""
    ends = segments.select("chr", F.explode(F.array(F.struct(F.col("start").alias("coord"), F.lit("-").alias("strand")), F.struct(F.col("end").alias("coord"), F.lit("+").alias("strand")))).alias("p")).select("chr", "p.coord", "p.strand")
    return point_join(ends.distinct(), boundaries.select(F.col("chr").alias("i_chr"), F.col("start").alias("i_start"), F.col("end").alias("i_end")), how="left_semi")


def segments_to_fragments(segments: DataFrame, fragments: DataFrame, allow_uncovered: bool = True) -> DataFrame:
    """``(sid, fid)``: the fragment that a segment lies in, named by the first and last segment in it; its own id if in none.

    A segment that lies in a fragment in part is an error.
    """
    f = fragments.select(F.col("chr").alias("i_chr"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    pairs = overlap_join(segments, f)
    whole = (F.col("start") >= F.col("i_start")) & (F.col("end") <= F.col("i_end"))
    if lost := pairs.where(~whole).first():
        raise ValueError(f"partly in a fragment: {lost['sid']}")
    w = Window.partitionBy("i_chr", "i_start", "i_end")
    named = pairs.withColumn("fid", F.concat(F.min_by("sid", "start").over(w), F.lit("-"), F.max_by("sid", "start").over(w))).select("sid", "fid")
    out = segments.select("sid").join(named, "sid", "left")
    missing = F.col("sid") if allow_uncovered else F.raise_error(F.concat(F.lit("in no fragment: "), F.col("sid")))
    return out.select("sid", F.coalesce("fid", missing).alias("fid"))


def cut_at_clusters(fragments: DataFrame, clusters: DataFrame) -> DataFrame:
    """Fragments cut at clusters (cluster, chr, coord, strand) of at most two positions, each wholly in a fragment."""
    span = clusters.groupBy("cluster", "chr").agg(F.min("coord").alias("low"), F.max("coord").alias("high"), F.count("*").alias("n"))
    if bad := span.where("n > 2").first():
        raise ValueError(f"cluster {bad['cluster']} has more than two positions")
    f = fragments.select(F.col("chr").alias("i_chr"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    held = point_join(span, f, coord="low").where("high <= i_end").select("cluster", "chr")
    if bad := span.join(held, ["cluster", "chr"], "left_anti").first():
        raise ValueError(f"no fragment holds cluster {bad['cluster']}")
    return cut_segments(fragments, clusters.select("chr", "coord", "strand"))
