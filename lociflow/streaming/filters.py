"""Stateless filters on streams, and event-time forms of the windowed operators.

Filters and projections of the library that neither sort nor aggregate run on ``readStream`` unchanged; those here wrap
what needs a watermark or state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(stream: DataFrame, *conditions: Column) -> DataFrame:
    for c in conditions:
        stream = stream.where(c)
    return stream


def unique(stream: DataFrame, id_col: str, time: str, late: str) -> DataFrame:
    """The first row of an id within the watermark: state is dropped with it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([id_col])


def tumbling_counts(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def sessions(stream: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    """Runs of rows less than ``gap`` apart, the time form of breakend clusters."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")
