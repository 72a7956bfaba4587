"""Exact top-k by inner product: columnar branch-and-bound.

Candidates are packed in blocks with one row for each dimension. Scores are summed up a block of
dimensions at a time; what the remaining dimensions can add is at most the product of the two remaining
norms (Cauchy-Schwarz), and candidates that cannot reach the k-th best so far are dropped by compaction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.shared import cut, ensure_importable

#: Vectors in a block of candidates, and in a block of queries.
CANDIDATES, QUERIES = 4096, 512
#: Dimensions summed up between two rounds of compaction.
STEP = 16
#: Scores count as the nearest numbers below this size, which a long holds.
MOST = 1 << 63


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(id, v)``: the rows that take part, as doubles; those whose scaled components no double holds are left out too."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("e")).where(F.col("id").isNotNull() & F.col("e").isNotNull())
    rows = rows.where(F.forall("e", lambda v: F.coalesce(fine(v), F.lit(False))))
    return rows.select("id", F.col("e").cast("array<double>").alias("v"))


def packed(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """``(dim, wide, ids, block)``: scaled and floored vectors of equal length, dimension by dimension (little-endian 32-bit
    integers; ``wide``: doubles, which hold any floored double)."""

    def emit(dim, ids, parts):
        block = np.floor(np.stack(parts) * scale) if dim else np.empty((len(ids), 0))
        wide = bool((np.abs(block) >= 1 << 31).any())
        block = block.T.astype("<f8" if wide else "<i4").tobytes()
        return pa.record_batch([pa.array([dim], pa.int32()), pa.array([wide]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([block], pa.binary())], ["dim", "wide", "ids", "block"])

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            col = batch.column(1)
            offsets, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
            for k, i in enumerate(batch.column(0).to_pylist()):
                v = values[offsets[k] : offsets[k + 1]]
                ids, parts = held.setdefault(len(v), ([], []))
                ids.append(i)
                parts.append(v)
                if len(ids) == size:
                    yield emit(len(v), ids, parts)
                    del held[len(v)]
        for dim, (ids, parts) in held.items():
            yield emit(dim, ids, parts)

    return rows.mapInArrow(run, "dim int, wide boolean, ids binary, block binary")


class Search:
    """The k best of all candidate blocks shown so far, for one block of queries."""

    def __init__(self, ids: np.ndarray, block: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, block, k  # block: dimension x query
        self.left = self._norms(block)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]  # scores, ids

    @staticmethod
    def _norms(block: np.ndarray) -> np.ndarray:
        """Norm of what is left from each step on; a little more than exact, so a bound stays one."""
        with np.errstate(over="ignore"):  # an infinite norm bounds too; blocks that have one are searched without bounds
            squares = block.astype(np.float64) ** 2
        tails = [np.sqrt(squares[d:].sum(0)) * (1 + 1e-9) for d in range(0, max(len(block), 1), STEP)]
        return np.stack([*tails, np.zeros(block.shape[1])])

    def show(self, ids: np.ndarray, block: np.ndarray) -> None:
        size = float(np.abs(block).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * max(len(block), 1)
        if not size < 2**62:
            return self._show_large(ids, block)
        kind = np.float64 if size < 2**53 else np.int64  # exact either way
        c, q, left = block.astype(kind), self.q.astype(kind), self._norms(block)
        first = q[:STEP].T @ c[:STEP]
        for n in range(len(self.ids)):
            alive = np.flatnonzero(ids != self.ids[n])
            score = first[n, alive]
            scores, names = self.best[n]
            least = scores.min() if len(scores) >= self.k else None
            for step, d in enumerate(range(STEP, len(block), STEP), 1):
                if least is not None:
                    bound = score + self.left[step, n] * left[step, alive]
                    keep = bound + 1e-6 + 1e-12 * np.abs(bound) >= least
                    alive, score = alive[keep], score[keep]
                if not len(alive):
                    break
                score = score + q[d : d + STEP, n] @ c[d : d + STEP, alive]
            if len(alive):
                self.best[n] = self._cut(np.concatenate([scores, score.astype(np.int64)]), np.concatenate([names, ids[alive]]))

    def _show_large(self, ids: np.ndarray, block: np.ndarray) -> None:
        """For components whose products 64 bits may not hold: whole numbers of any size, without bounds."""
        whole = np.vectorize(int, otypes=[object])
        found = np.vectorize(lambda x: max(-MOST, min(MOST - 1, x)), otypes=[np.int64])(whole(self.q).T @ whole(block))
        for n, own in enumerate(self.ids):
            alive = np.flatnonzero(ids != own)
            scores, names = self.best[n]
            self.best[n] = self._cut(np.concatenate([scores, found[n, alive]]), np.concatenate([names, ids[alive]]))

    def _cut(self, scores: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(scores) > self.k:
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = scores >= kth
            scores, names = scores[near], names[near]
        top = np.lexsort((names, ~scores))[: self.k]
        return scores[top], names[top]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` picks, the ``k`` other rows with the highest
    inner product of ``floor(scale * x)``; fewer where there are fewer. Ties go to the smaller id.

    Null ids, null vectors and vectors with a null or non-finite component take no part. Rows that repeat an id are
    candidates each by themselves, and none is a candidate of its own id; the best of all rows of a query's id are
    ranked together. Scores are summed exactly; one that no long holds counts as the long nearest to it.
    Only vectors of equal length are compared; empty vectors score 0 among themselves. No queries, no rows. Further
    columns play no part.

    Both sides are packed and written; the blocks of queries meet the blocks of candidates, so no side needs
    to fit in memory, and each pair of blocks sends on ``k`` rows a query.
    """
    ensure_importable(vectors.sparkSession)
    queries = usable(vectors.where(is_query), id_col, vec_col, scale)
    asked = cut(packed(queries, QUERIES, scale), "queries").select(*(F.col(c).alias(f"q_{c}") for c in ("dim", "wide", "ids", "block")))
    there = cut(packed(usable(vectors, id_col, vec_col, scale), CANDIDATES, scale), "candidates")
    # A grid: blocks of candidates in rows, of queries in columns; each cell is a join key of its own.
    down, across = (-(-x.count() // n) or 1 for x, n in ((there, 16), (asked, 2)))
    deal = lambda ids, n: F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = there.withColumn("r", deal("ids", down)).withColumn("c", every(across))
    asked = asked.withColumn("q_c", deal("q_ids", across)).withColumn("q_r", every(down))
    pairs = there.join(asked, (F.col("dim") == F.col("q_dim")) & (F.col("r") == F.col("q_r")) & (F.col("c") == F.col("q_c")))

    def run(batches):
        searches: dict[tuple, Search] = {}

        def told():
            for s in searches.values():
                n = [len(x[0]) for x in s.best]
                yield pa.record_batch(
                    [pa.array(np.repeat(s.ids, n)), pa.array(np.concatenate([x[1] for x in s.best])), pa.array(np.concatenate([x[0] for x in s.best]))],
                    ["query_id", "vec_id", "score"],
                )
            searches.clear()

        for batch in batches:
            for row in batch.to_pylist():
                ids, own = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                block_of = lambda name, ids: np.frombuffer(row[f"{name}block"], "<f8" if row[f"{name}wide"] else "<i4").reshape(row["dim"], len(ids))
                key = row["q_ids"], row["q_block"]
                if key not in searches:
                    if len(searches) == 32:
                        yield from told()
                    searches[key] = Search(own, block_of("q_", own), k)
                searches[key].show(ids, block_of("", ids))
        yield from told()

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 50 == 0)
