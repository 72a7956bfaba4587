"""Difference of two snapshots of a table whose rows may have been given new keys.

Keys become bitmaps: one word for 64 keys, words in containers by the keys' high bits, only words that are not
zero kept. The intersection of the containers of both snapshots gives the keys that pair, the differences those
that don't. Rows are then fetched by key as digests of their columns; texts are never moved. What key didn't pair
is paired by content: in each group of equal rows the i-th smallest old key with the i-th smallest new one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.text import remainder
from lociflow.shared import cut, ensure_importable

#: Bits of a key within a word, and of a word within a container: a container spans 1024 keys.
WORD_BITS, PLACE_BITS = 6, 4
#: Keys, or containers, that are ranked in one window.
RANK_BITS = 10


def _digest(value: Column) -> Column:
    """SHA-256 as 32 bytes; null for null."""
    return F.unhex(F.sha2(value, 256))


def narrow(rows: DataFrame, key: str, columns: Sequence[str], text_of_row: bool) -> DataFrame:
    """``(key, content, h, row, copies)``: one row for each key and content, with how often it occurs.

    ``h``: a digest of each column, null for null; ``content``: one of them all, in which null is like nothing else;
    ``row``: one of the columns joined by line feeds, null as ``~`` (only if ``text_of_row``).
    """
    own = [F.col(c).cast("string") for c in columns]
    some = rows.select(
        F.col(key).cast("long").alias("key"),
        F.struct(*(_digest(c).alias(f"h{i}") for i, c in enumerate(own))).alias("h"),
        (_digest(F.concat_ws("\n", *(F.coalesce(c, F.lit("~")) for c in own))) if text_of_row else F.lit(None).cast("binary")).alias("row"),
    )
    parts = [F.coalesce(F.hex(f"h.h{i}"), F.lit("null")) for i in range(len(own))]
    some = some.withColumn("content", _digest(F.concat_ws(",", *parts)))
    return some.groupBy("key", "content", "h", "row").agg(F.count("*").alias("copies"))


def containers(old_keys: DataFrame, new_keys: DataFrame) -> DataFrame:
    """``(high, words, repeats)`` of the bitmaps of both columns of keys, null keys left out.

    ``words`` maps a word's place in the container to ``both`` (the intersection), ``gone`` and ``come`` (the
    differences); words without keys aren't stored. ``repeats``: whether a key of the container occurs twice in one snapshot.
    """
    keys = old_keys.select(F.col("key"), F.lit(0).alias("side")).unionAll(new_keys.select(F.col("key"), F.lit(1).alias("side"))).where("key is not null")
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    own = lambda side: F.when(F.col("side") == side, bit)
    words = keys.groupBy(F.shiftright("key", WORD_BITS).alias("word")).agg(
        F.coalesce(F.bit_or(own(0)), F.lit(0)).cast("long").alias("old"),
        F.coalesce(F.bit_or(own(1)), F.lit(0)).cast("long").alias("new"),
        F.count("*").alias("n"),
    )
    words = words.select(
        F.shiftright("word", PLACE_BITS).alias("high"),
        F.col("word").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place"),
        F.struct(F.expr("old & new").alias("both"), F.expr("old & ~new").alias("gone"), F.expr("new & ~old").alias("come")).alias("bits"),
        (F.col("n") > F.bit_count("old") + F.bit_count("new")).alias("more"),
    )
    # At most 16 words meet in a container.
    return words.groupBy("high").agg(F.map_from_entries(F.collect_list(F.struct("place", "bits"))).alias("words"), F.bool_or("more").alias("repeats"))


def fetched(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``paired``, whether their key is in the intersection, and ``repeats`` of their container. A null key isn't paired."""
    high = F.shiftright("key", WORD_BITS + PLACE_BITS)
    word = F.expr(f"words[cast(shiftright(key, {WORD_BITS}) & {(1 << PLACE_BITS) - 1} as int)].both")
    joined = rows.withColumn("high", high).join(found.hint("merge"), "high", "left").withColumn("_word", word)
    return joined.withColumn("paired", F.coalesce(F.expr("shiftright(_word, cast(key & 63 as int)) & 1L") == 1, F.lit(False))).select(
        "key", "content", "h", "row", "copies", "paired", F.coalesce("repeats", F.lit(False)).alias("repeats")
    )


def content_ranks(rows: DataFrame, least: int, most: int) -> DataFrame:
    """Adds ``rank``, from 0, of ``k`` among the rows of equal ``content`` and ``side``, ``k`` lying between ``least`` and ``most``; a null ``key`` is the last of an equal ``k``.

    Keys are ranked within containers of 1024. What comes before a container is counted by containers of
    containers, so that no window is longer than 1024 rows, however many rows have one content.
    """
    group = ["content", "side"]
    level, counts = 0, rows
    steps = []
    while True:
        level += 1
        counts = counts.withColumn("c", F.shiftright("k" if level == 1 else "c", RANK_BITS))
        counts = counts.groupBy(*group, "c").agg((F.count("*") if level == 1 else F.sum("n")).alias("n"))
        steps.append(counts)
        if (most >> RANK_BITS * level) - (least >> RANK_BITS * level) < 1 << RANK_BITS:
            break
    before = None
    for counts in reversed(steps):
        above = [] if before is None else ["up"]
        if above:
            counts = counts.withColumn("up", F.shiftright("c", RANK_BITS))
        w = Window.partitionBy(*group, *above).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(w), F.lit(0)))
        if above:
            counts = counts.join(before.withColumnsRenamed({"c": "up", "ahead": "ahead_of_up"}).hint("merge"), [*group, "up"]).withColumn("ahead", F.expr("ahead + ahead_of_up"))
        before = counts.select(*group, "c", "ahead")
    w = Window.partitionBy(*group, "c").orderBy("k", F.col("key").isNull())
    ranked = rows.withColumn("c", F.shiftright("k", RANK_BITS)).join(before.hint("merge"), [*group, "c"])
    return ranked.withColumn("rank", F.col("ahead") + F.row_number().over(w) - 1).drop("c", "ahead")


def difference(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(key, old_key, op, changed, row_sha256, old_copies, new_copies)``: a row for each pair of rows and each row without a partner.

    ``key``: the new one, else the old one; ``old_key``: null for an insert. ``op``: ``same`` or ``update`` where keys are
    equal, ``rekey`` where only the contents are, ``insert`` and ``delete``. ``changed``: the columns that differ,
    joined by commas. ``row_sha256``: of the new row's columns joined by line feeds, null as ``~``; null for a delete.

    Nulls equal nulls only. A null key pairs with no key; by content it comes after all other keys. Rows that are
    wholly equal within a snapshot are one row with so many ``old_copies`` or ``new_copies`` (0 where there is none).
    Of different rows with one key in a snapshot that of the least digest pairs by key, the others by content. Further columns
    don't count, whatever their names. Empty snapshots give only inserts, only deletes or no row.
    """
    ensure_importable(old.sparkSession)
    keys = lambda rows: rows.select(F.col(key).cast("long").alias("key"))
    found = cut(containers(keys(old), keys(new)), "containers")
    sides = [cut(fetched(narrow(rows, key, columns, side == 1), found), "rows") for side, rows in enumerate((old, new))]

    least = [rows.where("paired").groupBy("key").agg(F.min_by(F.struct("content", "h", "row", "copies"), "content").alias(name)) for rows, name in zip(sides, ("o", "n"))]
    differ = [F.when(~F.col(f"o.h.h{i}").eqNullSafe(F.col(f"n.h.h{i}")), F.lit(c)) for i, c in enumerate(columns)]
    by_key = least[0].join(least[1].hint("merge"), "key").withColumn("changed", F.concat_ws(",", *differ))
    by_key = by_key.select(
        "key",
        F.col("key").alias("old_key"),
        F.when(F.col("changed") == "", "same").otherwise("update").alias("op"),
        "changed",
        F.col("n.row").alias("row"),
        F.col("o.copies").alias("old_copies"),
        F.col("n.copies").alias("new_copies"),
    )

    ends = found.agg(F.min("high").alias("a"), F.max("high").alias("b")).first()
    span = WORD_BITS + PLACE_BITS
    first, last = (ends["a"] or 0) << span, min(((ends["b"] or 0) + 1) << span, (1 << 63) - 1)  # null keys are ranked as the last one
    rest = None
    for side, rows in enumerate(sides):
        alone = rows.where("not paired")
        kept = rows.where("paired and repeats").groupBy("key").agg(F.min("content").alias("least"))
        more = rows.where("paired and repeats").join(kept.hint("merge"), "key").where("content <> least").select(*rows.columns)
        own = alone.unionAll(more).select("content", F.lit(side).alias("side"), "key", "row", "copies", F.coalesce("key", F.lit(last).cast("long")).alias("k"))
        rest = own if rest is None else rest.unionAll(own)
    ranked = content_ranks(rest, first, last)
    of = lambda side, x: F.max(F.when(F.col("side") == side, F.col(x)))
    by_content = ranked.groupBy("content", "rank").agg(
        of(0, "key").alias("old_key"), of(1, "key").alias("new_key"), of(1, "row").alias("row"),
        F.coalesce(of(0, "copies"), F.lit(0)).alias("old_copies"), F.coalesce(of(1, "copies"), F.lit(0)).alias("new_copies"),
    )
    op = F.when(F.col("old_copies") == 0, "insert").when(F.col("new_copies") == 0, "delete").otherwise("rekey")
    by_content = by_content.select(
        F.when(F.col("new_copies") > 0, F.col("new_key")).otherwise(F.col("old_key")).alias("key"), "old_key", op.alias("op"), F.lit("").alias("changed"), "row", "old_copies", "new_copies"
    )
    return by_key.unionAll(by_content).withColumn("row_sha256", F.lower(F.hex("row"))).select("key", "old_key", "op", "changed", "row_sha256", "old_copies", "new_copies")


def later_snapshot(docs: DataFrame) -> DataFrame:
    """``documents`` as they are later; what happens to a row follows from crc32(doc_id as text) mod 10."""
    r = remainder(F.col("doc_id"), 10)
    other = F.lit(-1).cast("long") - F.col("doc_id")
    rows = docs.select("doc_id", "text", "lang", "source", r.alias("r")).where("r is null or r <> 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("r") == 5, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    swap = F.col("r") == 2
    return rows.select(
        F.when(F.col("r").isin(3, 4) | F.col("copy"), other).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("r") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(swap, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(swap, F.col("lang")).when(F.col("r") == 4, F.lit(None)).otherwise(F.col("source")).alias("source"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return difference(docs, later_snapshot(docs), "doc_id", ("text", "lang", "source"))
