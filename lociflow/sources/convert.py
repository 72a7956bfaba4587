"""Conversion of any caller's adjacencies, and any tool's copy numbers, to the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.operators.filters import filter_by_extra, filter_by_regions
from lociflow.sources import copy_number as CN
from lociflow.sources import tabular as TB
from lociflow.sources import vcf as V
from lociflow.sources.sinks import adjacency_rows, segment_rows, write_table

TABLES = {"naibr": TB.naibr, "gundem2015": TB.gundem2015, "remixt": TB.remixt, "breakdancer": TB.breakdancer}
FORMATS = (*V.CALLERS, *TABLES)
COPY_NUMBERS = {"battenberg": CN.battenberg, "hatchet": CN.hatchet, "remixt": CN.remixt, "titan": CN.titan, "ginkgo": CN.ginkgo}


def adjacencies_from(
    spark: SparkSession, path: str, form: str, include: DataFrame | None = None, exclude: DataFrame | None = None, include_both: bool = True,
    exclude_both: bool = False, keep: dict[str, list[str]] | None = None, remove: dict[str, list[str]] | None = None, extras: list[str] | None = None, **options,
) -> DataFrame:
    """Adjacencies of a file in one of FORMATS, with the reader's ``options``; then only those in (or not in) regions, and with (or without) extras
    that match. ``extras`` names the keys that are kept of the extra map, all if None."""
    if form in V.CALLERS:
        rows = V.read(spark, path, form, **options)
    elif form in TABLES:
        rows = TABLES[form](spark, path, **options)
    else:
        raise ValueError(f"unknown format {form}; known are {', '.join(FORMATS)}")
    if include is not None or exclude is not None:
        rows = filter_by_regions(rows, include, exclude, include_both=include_both, exclude_both=exclude_both)
    if keep or remove:
        rows = filter_by_extra(rows, keep, remove, type_col="at")
    if extras is not None:
        rows = rows.withColumn("extra", F.map_filter("extra", lambda k, v: k.isin(*extras)))
    return rows


def copy_numbers_from(spark: SparkSession, path: str, form: str, **options) -> tuple[DataFrame, DataFrame]:
    """``(segments, scnt)`` of a file in one of COPY_NUMBERS, with the reader's ``options``."""
    if form not in COPY_NUMBERS:
        raise ValueError(f"unknown format {form}; known are {', '.join(COPY_NUMBERS)}")
    return COPY_NUMBERS[form](spark, path, **options)


def convert_adjacencies(spark: SparkSession, path: str, form: str, target: str, **options) -> None:
    """``adjacencies_from`` written as a canonical table."""
    write_table(adjacency_rows(adjacencies_from(spark, path, form, **options)), target)


def convert_copy_numbers(spark: SparkSession, path: str, form: str, target: str, **options) -> None:
    """``copy_numbers_from`` written as a canonical table."""
    write_table(segment_rows(*copy_numbers_from(spark, path, form, **options)), target)
