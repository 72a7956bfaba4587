"""Quality scores of documents from statistics of their texts.

Random Fourier features of the standardised statistics approximate a Gaussian kernel; each task sums its rows' normal
equations, which are added up by fold in the cluster, and ridge scores follow from their sum. Without one fold they
are the sum less that fold, so every labelled row has a score of a model that has not seen it; the ridge is chosen
by, and an isotonic curve fitted to, those.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.text import remainder
from lociflow.shared import cut, ensure_importable

#: Random features, folds, the values tried for the ridge (times the rows), and bins of raw scores that the isotonic curve is fitted to.
FEATURES, FOLDS, RIDGES, BINS = 256, 4, (1e-5, 1e-4, 1e-3, 1e-2, 1e-1), 2048
#: The model learns from at most about so many labelled rows, chosen by a hash of their id, in so many tasks.
SAMPLE, TASKS = 2_000_000, 48
#: Standardised statistics are cut off here; raw scores lie in this range.
CLIP, RAW = 6.0, (-1.0, 2.0)
THRESHOLD = 0.3
#: Bytes of a text looked at together.
SLICE = 1 << 20

NAMES = (
    "bytes words word_length longest_word distinct_words repeated_words lines line_length distinct_lines lower upper digits spaces beyond_ascii "
    "stops marks symbols entropy top_byte begin_upper end_stop end_mark end_symbol single"
).split()

_CODES = np.arange(256)
_OF = lambda chars: np.isin(_CODES, np.frombuffer(chars, np.uint8))
_LOWER, _UPPER, _DIGIT = (_CODES >= 97) & (_CODES <= 122), (_CODES >= 65) & (_CODES <= 90), (_CODES >= 48) & (_CODES <= 57)
_SPACE, _BEYOND, _STOP, _MARK = _OF(b" \t\n\v\f\r"), _CODES > 127, _OF(b".,;:"), _OF(b"!?\"'()-")
_SYMBOL = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _BEYOND | _STOP | _MARK)


def slices(data: bytes) -> Iterator[bytes]:
    """The text in parts that end before white space, where there is some."""
    at = 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def statistics_of(text: str | None) -> np.ndarray:
    """The statistics NAMES of a whole text; all 0 for a null or empty one."""
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(len(NAMES))
    if not data:
        return out
    held, first, last = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)
    words = repeated = longest = single = 0
    distinct, before = set(), None
    for part in slices(data):
        codes = np.frombuffer(part, np.uint8)
        held += np.bincount(codes, minlength=256)
        gap = np.concatenate([[True], _SPACE[codes], [True]])
        first += np.bincount(codes[gap[:-2] & ~gap[1:-1]], minlength=256)
        last += np.bincount(codes[gap[2:] & ~gap[1:-1]], minlength=256)
        own = part.split()
        if own:
            words += len(own)
            repeated += sum(map(operator.eq, own, own[1:])) + (own[0] == before)
            distinct.update(own)
            before = own[-1]
    if distinct:
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        longest, single = int(sizes.max()), int((sizes == 1).sum())
    lines = data.split(b"\n")
    size, n, w = len(data), len(lines), max(words, 1)
    share = held / size
    some = share[share > 0]
    ends = last / w
    inked = size - int(held[_SPACE].sum())
    out[:] = (
        np.log1p(size), np.log1p(words), inked / w, np.log1p(longest), len(distinct) / np.sqrt(w), repeated / w, np.log1p(n), np.log1p(size / n), len(set(lines)) / n,
        *(share[k].sum() for k in (_LOWER, _UPPER, _DIGIT, _SPACE, _BEYOND, _STOP, _MARK, _SYMBOL)),
        -(some * np.log(some)).sum(), some.max(), first[_UPPER].sum() / w, *(ends[k].sum() for k in (_STOP, _MARK, _SYMBOL)), single / w,
    )
    return out


def with_statistics(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``statistics`` in the text's place."""
    ensure_importable(rows.sparkSession)
    names = [c for c in rows.columns if c != text_col]

    def run(batches):
        for batch in batches:
            flat = np.concatenate([statistics_of(t) for t in batch.column(0).to_pylist()] or [np.empty(0)])
            starts = pa.array(np.arange(0, len(flat) + 1, len(NAMES)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(starts, pa.array(flat))], names=[*names, "statistics"])

    shape = rows.select(*names, F.array(F.lit(0.0)).alias("statistics")).schema
    return rows.select(F.col(text_col).cast("string"), *names).mapInArrow(run, shape)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, len(NAMES))


@dataclass
class Fourier:
    """Standardised statistics, and cosines of random projections of them."""

    mean: np.ndarray
    scale: np.ndarray
    features: int = FEATURES
    seed: int = 11

    def __post_init__(self):
        draw = np.random.Generator(np.random.PCG64(self.seed))
        d = len(self.mean)
        self.project = draw.standard_normal((d, self.features)) / np.sqrt(d)
        self.shift = draw.uniform(0, 2 * np.pi, self.features)

    def of(self, x: np.ndarray) -> np.ndarray:
        """A column of ones, then the features."""
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / self.features) * np.cos(z @ self.project + self.shift)])


def normal_equations(rows: DataFrame, fourier: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """For each fold the sums of zz' with those of zy as the last column, and of 1, y and yy. Rows: ``(statistics, y, fold)``, in TASKS tasks."""
    d = fourier.features + 1

    def run(batches):
        own = {}
        for batch in batches:
            z, y, fold = fourier.of(_matrix(batch.column(0))), np.asarray(batch.column(1), np.float64), np.asarray(batch.column(2))
            for k in np.unique(fold).tolist():
                a, b = z[fold == k], y[fold == k]
                extra = np.zeros((1, d + 1))
                extra[0, :3] = len(b), b.sum(), b @ b
                own[k] = own.get(k, 0) + np.vstack([a.T @ np.column_stack([a, b]), extra])
        for k, m in own.items():
            yield pa.record_batch([pa.array([k] * (d + 1), pa.int32()), pa.array(range(d + 1), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["fold", "i", "v"])

    def add(table):
        total = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, d + 1).sum(0)
        return pa.table([table.column("fold").slice(0, 1), table.column("i").slice(0, 1), pa.array([total.tolist()], pa.list_(pa.float64()))], ["fold", "i", "v"])

    shape = "fold int, i int, v array<double>"
    # A row of a matrix comes from at most TASKS tasks.
    found = rows.select("statistics", "y", "fold").mapInArrow(run, shape).groupBy("fold", "i").applyInArrow(add, shape)
    sums = np.zeros((FOLDS, d + 1, d + 1))
    for r in found.collect():
        sums[r["fold"], r["i"]] = r["v"]
    return sums[:, :d], sums[:, d, :3]


def _ridge(a: np.ndarray, n: float, ridge: float) -> np.ndarray:
    penalty = np.full(len(a), ridge * max(n, 1.0))
    penalty[0] = 1e-9 * max(n, 1.0)
    return np.linalg.solve(a[:, :-1] + np.diag(penalty), a[:, -1])


def ridge_scores(sums: np.ndarray, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from all rows, weights without each fold, and the ridge: that of the least squared error on the folds left out."""
    best = None
    for ridge in RIDGES:
        without = np.array([_ridge(sums.sum(0) - s, moments[:, 0].sum() - m[0], ridge) for s, m in zip(sums, moments)])
        error = sum(m[2] - 2 * w @ s[:, -1] + w @ s[:, :-1] @ w for w, s, m in zip(without, sums, moments))
        if best is None or error < best[0]:
            best = error, ridge, without
    return _ridge(sums.sum(0), moments[:, 0].sum(), best[1]), best[2], best[1]


def isotonic(x: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve of least squares through means ``total / n`` at ascending ``x``: pooled neighbours, each at its mean place."""
    pools: list[list[float]] = []
    for place, count, y in zip(x.tolist(), n.tolist(), total.tolist()):
        pools.append([place * count, count, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


@dataclass
class Model:
    fourier: Fourier
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    slope: float = 1e-6

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip(self.fourier.of(x) @ self.weights, *RAW)
        # Where the curve is level a trace of the raw score keeps the order.
        return np.clip(np.interp(raw, self.knots, self.levels) * (1 - self.slope) + self.slope * (raw - RAW[0]) / (RAW[1] - RAW[0]), 0.0, 1.0)


def fitted(rows: DataFrame) -> Model | None:
    """From ``(doc_id, statistics, y)``, y between 0 and 1; None without rows."""
    n = rows.count()
    if n == 0:
        return None
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / n) * (1 << 30))))
    some = some.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int"))
    some = cut(some.select("statistics", "y", "fold").repartition(min(TASKS, max(1, n // 1000 + 1))), "labelled")
    at = lambda i: F.col("statistics")[i]
    moments = some.agg(F.count("*").alias("n"), *(f(at(i)).alias(f"{k}{i}") for i in range(len(NAMES)) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not moments["n"]:
        return None
    mean, scale = (np.array([moments[f"{k}{i}"] for i in range(len(NAMES))]) for k in "ms")
    fourier = Fourier(mean, np.where(scale > 1e-9, scale, 1.0))
    weights, without, _ = ridge_scores(*normal_equations(some, fourier))

    def run(batches):
        held = np.zeros((BINS, 2))
        for batch in batches:
            z, y, fold = fourier.of(_matrix(batch.column(0))), np.asarray(batch.column(1), np.float64), np.asarray(batch.column(2))
            raw = np.clip((z * without[fold]).sum(1), *RAW)
            which = np.minimum(((raw - RAW[0]) / (RAW[1] - RAW[0]) * BINS).astype(int), BINS - 1)
            held += np.column_stack([np.bincount(which, minlength=BINS), np.bincount(which, y, BINS)])
        full = np.flatnonzero(held[:, 0])
        yield pa.record_batch([pa.array(full, pa.int64()), pa.array(held[full, 0]), pa.array(held[full, 1])], ["bin", "n", "total"])

    bins = some.select("statistics", "y", "fold").mapInArrow(run, "bin long, n double, total double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = np.array(sorted((r["bin"], r["n"], r["total"]) for r in bins.collect()), np.float64)  # at most BINS
    return Model(fourier, weights, *isotonic(RAW[0] + (found[:, 0] + 0.5) * (RAW[1] - RAW[0]) / BINS, found[:, 1], found[:, 2]))


def learned(rows: DataFrame, labels: DataFrame, label_col: str) -> Model | None:
    """From ``(doc_id, statistics)`` and the labels of these ids; null labels don't count, several of one id count by their mean."""
    own = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    return fitted(rows.select("doc_id", "statistics").join(own, "doc_id"))


def scored(rows: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``rows`` with ``score`` and ``predicted`` in place of ``statistics``; 0.5 and 1 for all rows without a model."""
    names = [c for c in rows.columns if c != "statistics"]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(0))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    shape = rows.select(*names, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return rows.select("statistics", *names).mapInArrow(run, shape)


def quality_scores(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", modulus: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Learns from labelled rows whose crc32(doc_id as text) mod ``modulus`` isn't ``held``. Null and empty texts have the statistics 0 and the
    score that the model gives these; a null id is never held out and never labelled; repeated rows are scored alike. Where no row is labelled
    every score is 0.5. No other column is read, whatever its name.
    """
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    rows = cut(with_statistics(docs.select(F.col(text_col), "doc_id", out.alias("held_out")), text_col), "statistics")
    return scored(rows, learned(rows.where("not held_out"), labels, label_col), threshold)


def op11(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
