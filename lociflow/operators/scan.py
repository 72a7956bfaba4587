"""Ordered scans along chromosomes in two levels.

Rows lie in bins of their coordinate. A bin is scanned by itself and gives one row that says what it begins and ends with
and how much it adds; only these rows are scanned along the whole chromosome, and what they carry over is
joined back by bin. No window holds more rows than a bin does, or than a chromosome has bins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.shared import cut

BIN = 1 << 16


def _binned(rows: DataFrame, at: str, width: int) -> DataFrame:
    return rows.withColumn("__bin", F.floor(F.col(at) / width).cast("long"))


def beside(rows: DataFrame, by: Sequence[str], at: str, order: Sequence[Column | str], state: Column, width: int = BIN) -> DataFrame:
    """Adds ``before`` and ``after``: the struct ``state`` of the row before and after in ``order`` among rows equal in ``by``; null at the ends.

    ``order`` begins with the column ``at`` and is ascending.
    """
    own, key = [*by, "__bin"], F.struct(*order)
    binned = _binned(rows, at, width).withColumn("__s", state)
    bins = binned.groupBy(*own).agg(F.min_by("__s", key).alias("__first"), F.max_by("__s", key).alias("__last"))
    along = Window.partitionBy(*by).orderBy("__bin")
    bins = bins.select(*own, F.lag("__last").over(along).alias("__b"), F.lead("__first").over(along).alias("__a"))
    within = Window.partitionBy(*own).orderBy(*order)
    out = binned.withColumns({"before": F.lag("__s").over(within), "after": F.lead("__s").over(within)})
    out = out.join(bins, own, "left").withColumns({"before": F.coalesce("before", "__b"), "after": F.coalesce("after", "__a")})
    return out.select(*rows.columns, "before", "after")


def runs(
    rows: DataFrame, by: Sequence[str], at: str, order: Sequence[Column | str], state: Column, breaks: Callable[[Column, Column], Column], width: int = BIN
) -> DataFrame:
    """Adds ``run``: numbers, from 1, of the runs of rows equal in ``by``, in ``order``; and ``place``, from 0, within the run.

    A run ends where ``breaks`` of the structs ``state`` of a row and the next one is true. ``order`` begins with the
    column ``at`` and is ascending.
    """
    own, key = [*by, "__bin"], F.struct(*order)
    within, along = Window.partitionBy(*own).orderBy(*order), Window.partitionBy(*by).orderBy("__bin")
    parts = lambda p, s: F.when(p.isNull(), F.lit(0)).when(breaks(p, s), 1).otherwise(0)
    binned = _binned(rows, at, width).withColumn("__s", state)
    inner = binned.withColumn("__p", F.lag("__s").over(within)).withColumn("__n", parts(F.col("__p"), F.col("__s"))).withColumn("__r", F.sum("__n").over(within))
    inner = inner.withColumn("__k", F.row_number().over(Window.partitionBy(*own, "__r").orderBy(*order)) - 1)

    ends = F.max_by(F.struct("__s", "__r", "__k"), key)
    bins = inner.groupBy(*own).agg(F.min_by("__s", key).alias("__first"), ends.alias("__last"), F.sum("__n").alias("__n"))
    bins = bins.withColumn("__b", F.lag("__last").over(along))
    bins = bins.withColumn("__flag", F.when(F.col("__b").isNull() | breaks(F.col("__b.__s"), F.col("__first")), 1).otherwise(0))
    bins = bins.withColumn("__off", F.sum(F.col("__flag") + F.col("__n")).over(along) - F.col("__n"))
    # Rows of the run that is open at a bin's end: those in the bin, and before it those of bins back to the last break.
    bins = bins.withColumn("__part", F.sum(F.when((F.col("__n") > 0) | (F.col("__flag") == 1), 1).otherwise(0)).over(along))
    bins = bins.withColumn("__open", F.sum(F.col("__last.__k") + 1).over(Window.partitionBy(*by, "__part").orderBy("__bin")))
    bins = bins.withColumn("__in", F.when(F.col("__flag") == 1, 0).otherwise(F.lag("__open").over(along)))
    out = inner.join(bins.select(*own, "__off", "__in"), own)
    place = F.col("__k") + F.when(F.col("__r") == 0, F.col("__in")).otherwise(0)
    return out.select(*rows.columns, (F.col("__off") + F.col("__r")).cast("long").alias("run"), place.cast("long").alias("place"))


def running(rows: DataFrame, by: Sequence[str], at: str, order: Sequence[Column | str], sums: dict[str, Column], width: int = BIN) -> DataFrame:
    """Adds the sums of ``sums`` over the rows up to each row, itself included, in ``order`` among rows equal in ``by``."""
    own = [*by, "__bin"]
    binned = _binned(rows, at, width).withColumns({f"__v_{k}": x for k, x in sums.items()})
    along = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*own).agg(*(F.sum(f"__v_{k}").alias(f"__v_{k}") for k in sums))
    bins = bins.select(*own, *(F.coalesce(F.sum(f"__v_{k}").over(along), F.lit(0)).alias(f"__o_{k}") for k in sums))
    within = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = binned.withColumns({f"__r_{k}": F.sum(f"__v_{k}").over(within) for k in sums}).join(bins, own)
    return out.select(*rows.columns, *((F.col(f"__r_{k}") + F.col(f"__o_{k}")).alias(k) for k in sums))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... in ``order`` over all rows, which it tells apart. Ranges of rows are counted by themselves and shifted by those before."""
    parts = cut(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = parts.groupBy("__p").agg(F.count("*").alias("__c")).select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
    own = parts.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return own.join(shift, "__p").select(*rows.columns, (F.col("__k") + F.col("__s")).alias(name))
