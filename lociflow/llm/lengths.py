"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.encoding import encoder, portions
from lociflow.llm.pfor import default_tokenizer
from lociflow.shared import cut, ensure_importable

#: Lengths that share a block of the suffix sums.
SPAN = 1024
#: Context limits that the query answers beside every length that occurs.
CONTEXTS = tuple(1 << k for k in range(7, 21))


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text", end_ids: int = 0) -> DataFrame:
    """``(length, n_docs)``: how many rows encode to each length.

    A null or empty text has ``end_ids`` ids; repeated rows and texts of equal length count each time; no rows, no lengths. Other columns don't count. Each task
    sends one row for each length it met.
    """
    ensure_importable(docs.sparkSession)

    def run(batches):
        lengths, met = encoder(tokenizer).lengths, Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for b, e in portions(texts):
                met.update(dict(zip(*(x.tolist() for x in np.unique(lengths(texts[b:e]) + end_ids, return_counts=True)))))
        if met:
            yield pa.record_batch([pa.array([*met], pa.int64()), pa.array([*met.values()], pa.int64())], ["length", "n_docs"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "length long, n_docs long")
    return found.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds to each length L of ``(length, n_docs)``:

    ``docs_ge``, ``tokens_ge``: documents of at least L and their tokens; ``truncated_total``: the tokens
    left when each document is cut to L; ``share_le``: the share of documents of at most L, so the
    q-quantile is the smallest length with ``share_le >= q`` (null without documents); ``tokens_total``: those of all
    documents. Sums run in blocks of lengths, then, in one task, over the blocks, of which there is at most one
    for each SPAN of the longest length. An empty histogram gives an empty table.
    """
    rows = histogram.withColumn("block", F.floor(F.col("length") / SPAN).cast("long")).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), zero).alias("later_d"), F.coalesce(F.sum("t").over(later), zero).alias("later_t"))
    total = rows.agg(F.sum("n_docs").alias("all_d"), F.sum("tokens").alias("all_t"))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(blocks, "block").crossJoin(F.broadcast(total))  # one row
    docs_ge = F.sum("n_docs").over(within) + F.col("later_d")
    tokens_ge = F.sum("tokens").over(within) + F.col("later_t")
    out = out.withColumn("docs_ge", docs_ge).withColumn("tokens_ge", tokens_ge)
    return out.select(
        "length",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("all_t") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_total"),
        ((F.col("all_d") - F.col("docs_ge") + F.col("n_docs")) / F.when(F.col("all_d") > 0, F.col("all_d"))).alias("share_le"),
        F.col("all_t").alias("tokens_total"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``(context, docs_over, tokens_total, tokens_kept)`` for each context limit, whether or not a document has that length,
    from the suffix sums. Limits that are repeated count once; without documents all is 0."""
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context long")
    sums = suffix_sums(with_limits(histogram, limits)).join(F.broadcast(asked), F.col("length") == F.col("context"))
    # A limit is at most the length of the documents counted from it on; those of just that length aren't over it.
    return sums.select("context", (F.col("docs_ge") - F.col("n_docs")).alias("docs_over"), "tokens_total", F.col("truncated_total").alias("tokens_kept"))


def with_limits(histogram: DataFrame, limits) -> DataFrame:
    """The histogram with each limit among its lengths, counting 0 documents where none has it."""
    spark = histogram.sparkSession
    none = spark.createDataFrame([(int(x), 0) for x in limits], "length long, n_docs long")
    return histogram.unionByName(none).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, length)``: the smallest length that at least that share of documents doesn't exceed; null without any."""
    least = sums.where("n_docs > 0").agg(*(F.min(F.when(F.col("share_le") >= float(x), F.col("length"))).alias(f"q{k}") for k, x in enumerate(shares)))
    pairs = F.array(*(F.struct(F.lit(float(x)).alias("share"), F.col(f"q{k}").alias("length")) for k, x in enumerate(shares)))
    return least.select(F.inline(pairs))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_sums(cut(with_limits(length_histogram(docs, default_tokenizer()), CONTEXTS), "lengths"))
