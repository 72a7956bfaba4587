"""Audit of how the sources of a language differ in their terms.

Texts become counts of terms, dealt by language and term over shards. In each shard DuckDB sums the counts with vectorized
SQL and drops rare terms; in a second round it gives each shard's part of every pair's divergence, over the terms that
both sources have, and its highest terms. Spark merges the sums and the rankings. What a source adds for terms that it has and the other
lacks depends only on how often it has them, so it comes from a histogram of its counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.shared import cut, ensure_importable

#: A term is kept in the languages where this many documents have it; so many terms are ranked for a source.
LEAST_DOCS, TOP = 3, 200
#: Characters of text, and rows of kept terms, for each shard.
SHARD_CHARS, SHARD_ROWS = 32 << 20, 400_000
#: Terms that a task counts before it sends them on; rows that DuckDB holds before it sums them up; bytes of a text split at a time.
HELD_TERMS, HELD_ROWS, SLICE = 500_000, 2_000_000, 1 << 20
#: Ranks are merged in so many parts of a source first.
PARTS = 16

_LETTERS = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

COUNTS = "lang string, term string, source string, n long, docs long"
KEPT = "lang string, term string, source string, n long, total long, leads int"
PAIRS = "lang string, source string, item string, value decimal(38,0), shown int"


def term_slices(text: str | None) -> Iterator[list[bytes]]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z lower-cased, as UTF-8, in slices of about SLICE bytes."""
    data = (text or "").encode("utf-8", "replace").translate(_LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _database():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``(lang, term, source, n, docs)``: partial counts, and a row with the empty term for each language and source met."""

    def rows(held):
        for (of_lang, of_source), (counts, having) in held.items():
            counts[b""], having[b""] = 0, 0
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            numbers = [pa.array(list(counts.values()), pa.int64()), pa.array(list(map(having.__getitem__, counts)), pa.int64())]
            yield pa.record_batch([pa.repeat(pa.scalar(of_lang), len(terms)), terms, pa.repeat(pa.scalar(of_source), len(terms)), *numbers], ["lang", "term", "source", "n", "docs"])

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for of_lang, of_source, whole in zip(*(c.to_pylist() for c in batch.columns)):
                counts, having = held.setdefault((of_lang, of_source), (Counter(), Counter()))
                size -= len(counts)
                own: set[bytes] = set()
                for terms in term_slices(whole):
                    counts.update(terms)
                    own.update(terms)
                having.update(own)
                size += len(counts)
                if size > HELD_TERMS:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(name(lang).alias("lang"), name(source).alias("source"), F.col(text).cast("string").alias("text")).mapInArrow(run, COUNTS)


def kept_terms(counts: DataFrame, shards: int, least_docs: int) -> DataFrame:
    """``(lang, term, source, n, total, leads)`` of terms in at least ``least_docs`` documents of their language: the count in the source, that in the
    language, and 1 in one row of each language and term. Rows with the empty term stay as they are, for the groups."""

    def run(batches):
        con = _database()
        con.execute("CREATE TABLE held (lang VARCHAR, term VARCHAR, source VARCHAR, n BIGINT, docs BIGINT)")
        rows, limit = 0, HELD_ROWS
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            con.execute("INSERT INTO held SELECT lang, term, source, n, docs FROM batch")
            con.unregister("batch")
            rows += batch.num_rows
            if rows > limit:
                con.execute("CREATE OR REPLACE TABLE held AS SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL")
                rows = con.execute("SELECT count(*) FROM held").fetchall()[0][0]
                limit = max(HELD_ROWS, 2 * rows)
        found = con.sql(f"""
            SELECT lang, term, source, n::BIGINT AS n, (sum(n) OVER w)::BIGINT AS total, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AND term <> '')::INTEGER AS leads
            FROM (SELECT lang, term, source, sum(n) AS n, sum(docs) AS docs FROM held GROUP BY ALL)
            WINDOW w AS (PARTITION BY lang, term)
            QUALIFY term = '' OR sum(docs) OVER w >= {least_docs}""")
        yield from found.to_arrow_reader(100_000)
        con.close()

    return counts.repartition(shards, "lang", "term").mapInArrow(run, KEPT)


def _p(count: Column | str, total: Column | str) -> Column:
    """1 + floor(10^9 (count + 1) / total), exact."""
    return F.expr(f"1 + ((cast(1000000000 as decimal(38,0)) * ({count} + 1)) div cast(greatest({total}, 1) as decimal(20,0)))")


def _f(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def shard_parts(rows: DataFrame, shards: int, top: int) -> DataFrame:
    """For ``(lang, term, source, n, p, p0, q)``: ``shown`` 0: what the terms that both sources have add to a pair beyond what each
    adds alone; 1: the ``top`` terms of a source in the shard."""

    def run(batches):
        if not (held := list(batches)):
            return
        con = _database()
        con.register("x", pa.Table.from_batches(held))
        f = lambda p, q: f"(({p} - {q}) * ({p} - {q})) // {q}"
        pairs = con.sql(f"""
            SELECT a.lang, a.source, b.source AS item,
                   sum({f("a.p", "b.p")} - {f("a.p", "b.p0")} - {f("a.p0", "b.p")} + {f("a.p0", "b.p0")})::DECIMAL(38, 0) AS value, 0 AS shown
            FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL""")
        yield from pairs.to_arrow_reader(100_000)
        terms = con.sql(f"""
            SELECT lang, source, term AS item, ({f("p", "q")})::DECIMAL(38, 0) AS value, 1 AS shown FROM x WHERE p > q AND n > 0
            QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {f("p", "q")} DESC, term) <= {top}""")
        yield from terms.to_arrow_reader(100_000)
        con.close()

    return rows.repartition(shards, "lang", "term").mapInArrow(run, PAIRS)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each source of a language its divergence from each other source (part ``pair``, all ranks),
    and the terms that it has more often than the language (part ``term``, to rank ``top``).

    With p = 1 + floor(10^9 (count + 1) / (N + V)) of a kept term in a source or language, N its kept terms, V those of the language, the value of
    a term is floor((p - q)^2 / q); of a pair the sum of it over all kept terms. Ties go to the item first in UTF-8.
    Nulls in the three columns are empty strings. Sources without terms have pairs; a language without kept terms has pairs of value 0;
    one with a single source has no pair. Repeated rows are documents of their own. Other columns don't count. No rows, no result.
    """
    ensure_importable(docs.sparkSession)
    chars = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    kept = cut(kept_terms(term_counts(docs, text, lang, source), max(8, -(-chars // SHARD_CHARS)), least_docs), "terms")
    langs = kept.groupBy("lang").agg(F.sum("leads").alias("v"), F.sum("n").alias("lang_n"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n")).join(langs, "lang")
    groups = cut(groups.withColumn("p0", _p("0", "own_n + v")), "groups", 1)

    rows = kept.where("term <> ''").join(groups, ["lang", "source"])
    shards = max(8, -(-kept.count() // SHARD_ROWS))
    parts = cut(shard_parts(rows.select("lang", "term", "source", "n", _p("n", "own_n + v").alias("p"), "p0", _p("total", "lang_n + v").alias("q")), shards, top), "parts")

    # What a source adds alone, by how often it has a term: as the first of a pair and as the second.
    times = kept.where("n > 0").groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"])
    times = times.select("lang", "source", "terms", _p("n", "own_n + v").alias("p"), "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "v")
    exact = lambda e: F.sum(F.expr(f"cast({e} as decimal(38,0))"))
    alone = times.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(
        exact(f"terms * ({_f('p', 'q0')} - {_f('p0', 'q0')})").alias("first"), exact(f"terms * ({_f('q0', 'p')} - {_f('q0', 'p0')})").alias("second")
    )
    none = groups.select("lang", "source", "p0").join(other, "lang").where("source <> item")
    sums = parts.where("shown = 0").select("lang", "source", "item", "value")
    sums = sums.unionAll(alone.select("lang", "source", "item", F.col("first")))
    sums = sums.unionAll(alone.select("lang", F.col("item"), F.col("source"), F.col("second")))
    sums = sums.unionAll(none.select("lang", "source", "item", F.expr(f"cast(v * {_f('p0', 'q0')} as decimal(38,0))")))
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    terms = parts.where("shown = 1").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    best = lambda *more: F.row_number().over(Window.partitionBy("lang", "source", *more).orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS))).withColumn("rank", best("part")).where(F.col("rank") <= top)
    terms = terms.withColumn("rank", best()).where(F.col("rank") <= top)
    shown = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return shown(pairs.withColumn("rank", best()), "pair").unionAll(shown(terms, "term"))


def op12(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
