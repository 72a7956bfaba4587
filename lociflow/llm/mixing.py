"""Mixing sources to target weights by Poisson replication, in DataFrame expressions alone.

A source whose target is ``w`` of the mixture and whose mass is ``m`` of the total ``M`` is repeated
``w * M / m`` times on average. Each document takes its count from the Poisson distribution with that mean:
a uniform number is hashed from the seed and the id, and the distribution function is inverted at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.shared import cut

#: A mean above this is the sum of equal parts of at most this, each inverted with a number of its own.
PART = 8.0
#: Counts beyond this have probability under 1e-18 for a mean of PART, less than a step of the uniform numbers.
TERMS = 48
#: Sources up to which the table of sources is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def uniform(*parts: Column) -> Column:
    """In [0, 1), from 52 bits of the MD5 of the parts joined by colons; a null part counts as ``null``."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str, mass: Column, weights: dict[str, float] | None) -> DataFrame:
    """``(mix_source, rate, parts, cdf)``: the mean repetition of each source and the distribution function of a part.

    Without weights each source is to weigh as the whole part of the square root of its mass. The weights'
    total is summed in decimals: it doesn't depend on the order of the rows.
    """
    own = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum(mass).alias("m"), F.count("*").alias("n"))
    own = own.withColumn("m", F.coalesce("m", F.lit(0)).cast("double"))
    if weights is None:
        weighed = own.withColumn("w", F.floor(F.sqrt("m")).cast("double"))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        weighed = own.withColumn("w", F.coalesce(given[F.col("mix_source")], F.lit(0.0)) if weights else F.lit(0.0))
    total = weighed.agg(F.sum("m").alias("all_m"), F.sum(F.col("w").cast("decimal(38,9)")).cast("double").alias("all_w"))
    rate = F.when((F.col("m") > 0) & (F.col("all_w") > 0), F.col("w") / F.col("all_w") * F.col("all_m") / F.col("m")).otherwise(F.lit(0.0))
    part = F.col("rate") / F.col("parts")
    # The terms p(k) = p(k-1) * mean / k are summed from the left, always in this order.
    step = lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), (acc["c"] + acc["p"] * F.col("mean") / k).alias("c"), F.concat(acc["a"], F.array(acc["c"] + acc["p"] * F.col("mean") / k)).alias("a"))
    zero = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"), F.array(F.exp(-F.col("mean"))).alias("a"))
    return (
        weighed.crossJoin(F.broadcast(total))  # one row
        .withColumn("rate", rate)
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
        .withColumn("mean", part)
        .withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda acc: acc["a"]))
        .select("mix_source", "rate", "parts", "cdf")
    )


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", mass: Column | None = None, weights: dict[str, float] | None = None, seed: int = 17, shuffle: bool = True) -> DataFrame:
    """The rows of ``docs``, each as often as its count says, in a hashed global order.

    Adds ``mix_rate`` (the source's mean), ``mix_copy`` (from 0) and ``mix_order`` (sort key in [0, 1)); a
    column of ``docs`` by one of these names, in any case, is replaced. ``mass`` is what the weights share
    out (default: 1 for each row); a null mass counts 0, a source without mass or weight is not repeated
    at all. Rows with a null source are a source of their own. Rows that repeat an id have equal counts. An
    empty table gives an empty one.

    Rows are read once for the sources' masses (a combined aggregate), joined with the small table of
    sources and dealt out by range of the hashed key; no source, however large, is gathered anywhere.
    """
    added = {"mix_rate", "mix_copy", "mix_order"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    table = rates(docs, source_col, F.lit(1) if mass is None else mass, weights)
    table = table.select(F.col("mix_source").alias("__source"), F.col("rate").alias("__rate"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    table = cut(table, "mix-rates")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = docs.join(table, docs[source_col].eqNullSafe(F.col("__source")))
    # The count is how many values of the distribution function are at most u.
    one = lambda i: F.size(F.filter("__cdf", lambda c: c <= uniform(F.lit(seed), F.col(id_col), i)))
    u = uniform(F.lit(seed), F.col(id_col), F.lit(1))
    single = F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))
    several = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda acc, i: acc + one(i))
    counted = joined.withColumn("__u", u).withColumn("__n", F.when(F.col("__parts") == 1, single).otherwise(several))
    # In two steps, so that no array of a row grows with the rate beyond its square root.
    side = F.ceil(F.sqrt("__n")).cast("int")
    blocks = counted.where("__n > 0").select(*docs.columns, F.col("__rate").alias("mix_rate"), "__n", F.explode(F.sequence(F.lit(0), F.col("__n") - 1, side)).alias("__first"))
    last = F.least(F.col("__n"), F.col("__first") + side) - 1
    copies = blocks.select(*docs.columns, "mix_rate", F.explode(F.sequence("__first", last)).alias("mix_copy"))
    out = copies.withColumn("mix_order", uniform(F.lit(seed + 1), F.col(id_col), F.col("mix_copy")))
    return out.orderBy("mix_order", id_col, "mix_copy") if shuffle else out


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs.select("doc_id", "source", "n_chars"), mass=F.col("n_chars"))
    return mixed.select("doc_id", "source", "mix_rate", F.col("mix_copy").cast("long").alias("mix_copy"), "mix_order")
