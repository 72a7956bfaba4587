"""Row filters on regions, sizes, extras and copy numbers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions.model import FAR
from lociflow.operators.intervals import overlap_join, point_join


def _regions(regions: DataFrame) -> DataFrame:
    return regions.select("rid", F.lower("chr").alias("i_chr"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))


def region_hits(adjacencies: DataFrame, regions: DataFrame, spanning: bool = False) -> DataFrame:
    """``(aid, one, two, whole, rids)``: whether each end lies in a region, whether the adjacency spans one whole, and which regions."""
    r = _regions(regions)
    ends = adjacencies.select("aid", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.lower(f"chr{k}").alias("chr"), F.col(f"coord{k}").alias("coord")) for k in (1, 2)))).alias("e"))
    hits = point_join(ends.select("aid", "e.side", "e.chr", "e.coord"), r).select("aid", "side", "rid")
    if spanning:
        inner = adjacencies.where(F.lower("chr1") == F.lower("chr2")).select("aid", F.lower("chr1").alias("chr"), F.least("coord1", "coord2").alias("start"), F.greatest("coord1", "coord2").alias("end"))
        whole = overlap_join(inner, r).where((F.col("i_start") >= F.col("start")) & (F.col("i_end") <= F.col("end")))
        hits = hits.unionByName(whole.select("aid", F.lit(0).alias("side"), "rid"))
    flag = lambda k: F.bool_or(F.col("side") == k)
    return hits.groupBy("aid").agg(flag(1).alias("one"), flag(2).alias("two"), flag(0).alias("whole"), F.array_sort(F.collect_set("rid")).alias("rids"))


def filter_by_regions(
    adjacencies: DataFrame,
    include: DataFrame | None = None,
    exclude: DataFrame | None = None,
    include_both: bool = True,
    exclude_both: bool = False,
    include_spanning: bool = False,
    exclude_spanning: bool = False,
    annotate: bool = False,
) -> DataFrame:
    """Adjacencies with both ends (or either) in included regions and not both (or either) in excluded ones.

    ``spanning`` also counts a region that lies whole between the ends. Chromosomes are compared in any case.
    ``annotate`` adds ``retained_by``, the sorted ids of the included regions met.
    """
    out = adjacencies
    join = lambda both: (F.col("one") & F.col("two")) if both else (F.col("one") | F.col("two"))
    if include is not None:
        hits = region_hits(adjacencies, include, include_spanning).where(join(include_both) | F.col("whole"))
        out = out.join(hits.select("aid", F.col("rids").alias("retained_by")), "aid")
        if not annotate:
            out = out.drop("retained_by")
    elif annotate:
        out = out.withColumn("retained_by", F.array().cast("array<string>"))
    if exclude is not None:
        hits = region_hits(adjacencies, exclude, exclude_spanning).where(join(exclude_both) | F.col("whole"))
        out = out.join(hits.select("aid"), "aid", "left_anti")
    return out


def filter_by_size(adjacencies: DataFrame, size: Column, low: int = 0, high: int = 10**9, inter: bool = True, intra: bool = True, self_loops: bool = True) -> DataFrame:
    """Bounds are inclusive and hold within chromosomes only; across them just ``inter`` decides."""
    across = F.col("chr1") != F.col("chr2")
    loop = ~across & (F.col("coord1") == F.col("coord2")) & (F.col("strand1") == F.col("strand2"))
    within = F.lit(intra) & (size >= low) & (size <= high) & (F.lit(self_loops) | ~loop)
    return adjacencies.where(F.when(across, F.lit(inter)).otherwise(within))


def filter_by_extra(rows: DataFrame, keep: dict[str, list[str]] | None = None, remove: dict[str, list[str]] | None = None, missing_keep: str = "remove", missing_remove: str = "keep", extra: str = "extra", type_col: str | None = None) -> DataFrame:
    """Regular expressions, searched for, on values of the extra map. A row is kept if any of ``keep`` matches, and none of
    ``remove``. A field ``at`` is matched with ``type_col``. What lacks a field is kept or removed as told."""

    def value(field: str) -> Column:
        return F.col(type_col) if type_col and field == "at" else F.try_element_at(F.col(extra), F.lit(field))

    def any_match(rules: dict[str, list[str]]) -> Column:
        return reduce(or_, (F.coalesce(value(f).rlike(r), F.lit(False)) for f, rs in rules.items() for r in rs))

    def lacks(rules: dict[str, list[str]]) -> Column:
        return reduce(or_, (value(f).isNull() for f in rules))

    if keep:
        rows = rows.where(any_match(keep) | (lacks(keep) if missing_keep == "keep" else F.lit(False)))
    if remove:
        rows = rows.where(~any_match(remove) & (~lacks(remove) if missing_remove == "remove" else F.lit(True)))
    return rows


def filter_segments_by_regions(segments: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, include_full: bool = True, exclude_full: bool = False) -> DataFrame:
    """Segments whole in (or touching) an included region, and not whole in (or touching) an excluded one."""

    def hits(regions: DataFrame, full: bool) -> DataFrame:
        own = segments.select("sid", F.lower("chr").alias("chr"), "start", "end")
        pairs = overlap_join(own, _regions(regions))
        if full:
            pairs = pairs.where((F.col("start") >= F.col("i_start")) & (F.col("end") <= F.col("i_end")))
        return pairs.select("sid").distinct()

    out = segments
    if include is not None:
        out = out.join(hits(include, include_full), "sid", "left_semi")
    if exclude is not None:
        out = out.join(hits(exclude, exclude_full), "sid", "left_anti")
    return out


def filter_segments_by_size(segments: DataFrame, low: int = 0, high: int = 10**9) -> DataFrame:
    """By end - start, inclusive."""
    return segments.where((F.col("end") - F.col("start")).between(low, high))


def drop_short(adjacencies: DataFrame, least: int) -> DataFrame:
    """Those across chromosomes stay."""
    return adjacencies.where((F.col("chr1") != F.col("chr2")) | (F.abs(F.col("coord1") - F.col("coord2")) >= least))


def of_type(adjacencies: DataFrame, at: str) -> DataFrame:
    return adjacencies.where(F.col("at") == at)


def drop_zero_copies(edges: DataFrame, kinds: tuple[str, ...] = ("S", "R", "N")) -> DataFrame:
    """Edges (u, v, kind, cn) without those of the kinds that have no copies; nodes without edges vanish with them."""
    return edges.where(~F.col("kind").isin(*kinds) | (F.coalesce("cn", F.lit(0)) != 0))


def spans(low: Column, high: Column, start: Column, end: Column, partial: bool = False) -> Column:
    """Whether [low, high] holds [start, end] whole, or meets it."""
    return ((low <= end) & (high >= start)) if partial else ((low <= start) & (high >= end))


def in_samples(rows: DataFrame, counts: str, samples: list[str], any_: bool = True, only: bool = False, least: int = 1) -> DataFrame:
    """On a map sample -> count: present in any (or all) of the samples, and with ``only`` in no other."""
    held = lambda s: F.coalesce(F.try_element_at(F.col(counts), F.lit(s)), F.lit(0)) >= least
    test = reduce(or_, map(held, samples)) if any_ else ~reduce(or_, (~held(s) for s in samples))
    rows = rows.where(test)
    if only:
        rows = rows.where(F.size(F.map_filter(counts, lambda k, v: ~k.isin(*samples) & (v >= least))) == 0)
    return rows


def whole_chromosome() -> tuple[int, int]:
    return 0, FAR
