"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rotated) by its place from the end; a text's vector bundles (adds) those
of its n-grams, and a language's prototype those of its documents. A document has the language of the
prototype with the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.encoding import portions
from lociflow.llm.text import remainder
from lociflow.shared import cut, ensure_importable

DIMENSIONS, GRAM = 1024, 3
#: Prototypes are broadcast up to this many languages; more raise an error, for nothing bounds their size.
MOST_LANGUAGES = 2048
#: Vectors of n-grams, and of letters, remembered by a worker; with more met, it begins anew.
KEEP = 24_000
#: Distinct n-grams whose counts and vectors are multiplied at a time.
SLICE = 12_000
#: Between words; no letter has this number.
GAP = 0


class Profiles:
    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = 7):
        self.d, self.gram, self.seed = dimensions, gram, seed
        self.letter: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0, bool)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.table = np.empty((1024, self.d), np.int8)

    def _of_letter(self, code: int) -> np.ndarray:
        if code not in self.letter:
            if len(self.letter) >= KEEP:
                self.letter = {}
            draw = np.random.Generator(np.random.PCG64([self.seed, code]))
            self.letter[code] = (2 * draw.integers(0, 2, self.d, dtype=np.int8) - 1).astype(np.int8)
        return self.letter[code]

    def _of_grams(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams given as numbers of 21 bits a letter."""
        new = [g for g in grams.tolist() if g not in self.place]
        if len(self.place) + len(new) > KEEP and self.place:
            self._forget()
            new = grams.tolist()
        while len(self.place) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        for g in new:
            v = np.ones(self.d, np.int8)
            for k in range(self.gram):
                v = v * np.roll(self._of_letter(g >> (21 * k) & 0x1FFFFF), k)
            self.table[len(self.place)] = v
            self.place[g] = len(self.place)
        return self.table[np.fromiter(map(self.place.__getitem__, grams.tolist()), np.int64, len(grams))]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(owner, gram, names)``: for each n-gram of each text the text and the n-gram's number among the distinct ones, and these.

        Texts are lower-cased; what is no letter parts words, and each word is taken with a gap at either end. An
        n-gram lies within a word and its gaps.
        """
        codes, owner = [], []
        for i, t in enumerate(texts):
            # Two gaps between texts: no n-gram that holds a letter spans them.
            c = np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
            codes.append(c)
            owner.append(np.full(len(c), i))
        code, own = np.concatenate(codes), np.concatenate(owner)
        if code.max(initial=0) >= len(self.is_letter):
            self.is_letter = np.array([chr(i).isalpha() for i in range(int(code.max()) + 1)])
        letter = self.is_letter[code]
        code = np.where(letter, code, GAP)
        keep = letter | np.concatenate([[True], letter[:-1] | (own[1:] != own[:-1])])  # one gap for a run, and one before each text
        code, own, letter = code[keep], own[keep], letter[keep]
        n = len(code) - self.gram + 1
        if n <= 0:
            return (np.empty(0, np.int64),) * 3
        gram = np.zeros(n, np.int64)
        fine = (own[:n] == own[self.gram - 1 :]) & (letter[:n] | letter[1 : n + 1])
        for k in range(self.gram):
            gram = gram << 21 | code[k : k + n]
            if 0 < k < self.gram - 1:
                fine &= letter[k : k + n]
        names, which = np.unique(gram[fine], return_inverse=True)
        return own[:n][fine], which, names

    def bundles(self, texts: list[str | None], owner: np.ndarray | None = None, n: int | None = None) -> np.ndarray:
        """One vector for each text, or for each of ``n`` owners of the texts; whole numbers."""
        of, which, names = self.counts(texts)
        n = len(texts) if n is None else n
        of = of if owner is None else owner[of]
        out = np.zeros((n, self.d), np.float32)
        if len(names) > SLICE:
            order = np.argsort(which, kind="stable")
            of, which = of[order], which[order]
        for b in range(0, len(names), SLICE):
            i, j = np.searchsorted(which, [b, b + SLICE]) if len(names) > SLICE else (0, len(which))
            vectors = self._of_grams(names[b : b + SLICE])
            held = np.bincount(of[i:j] * len(vectors) + which[i:j] - b, minlength=n * len(vectors)).reshape(n, -1)
            out += held.astype(np.float32) @ vectors.astype(np.float32)
        return out


def small_portions(texts):
    """Portions whose counts make a table of bounded size."""
    for b, e in portions(texts, 1 << 20):
        for k in range(b, e, 256):
            yield k, min(k + 256, e)


def prototypes(learn: DataFrame, text_col: str, lang_col: str, dimensions: int = DIMENSIONS, gram: int = GRAM) -> tuple[list[str], np.ndarray]:
    """Languages in order and the sum of their documents' vectors, over all rows with a language and a letter.

    Null languages and null, empty or letterless texts add nothing; repeated rows add each time; no such row, no language. Other columns don't count."""

    def run(batches):
        profiles, held = Profiles(dimensions, gram), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for b, e in small_portions(texts):
                names = sorted(set(langs[b:e]))
                at = np.array([names.index(x) for x in langs[b:e]])
                for name, v in zip(names, profiles.bundles(texts[b:e], at, len(names))):
                    held[name] = held.get(name, 0) + v.astype(np.float64)
        for name, v in held.items():
            if v.any():
                yield pa.record_batch([pa.array([name]), pa.array([v.tolist()], pa.list_(pa.float64()))], ["lang", "v"])

    rows = learn.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    sums = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    whole = cut(sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v")), "prototypes")
    if (n := whole.count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} languages; at most {MOST_LANGUAGES} prototypes are broadcast")
    found = sorted((r["lang"], r["v"]) for r in whole.collect())
    return [x for x, _ in found], np.array([v for _, v in found], np.float64).reshape(len(found), dimensions)


def identify(docs: DataFrame, langs: list[str], protos: np.ndarray, text_col: str = "text", dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score``, the cosine (0 if it is negative).

    ``und`` and 0 where the text is null or has no letter, or no language was learned. Equal cosines go to the
    first language in order. Columns of ``docs`` with these two names, in any case, are replaced.
    """
    ensure_importable(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    unit = (protos / np.linalg.norm(protos, axis=1, keepdims=True)).T.astype(np.float32) if langs else np.zeros((dimensions, 0), np.float32)
    at = docs.columns.index(text_col)

    def run(batches):
        profiles = Profiles(dimensions, gram)
        for batch in batches:
            texts, names, scores = batch.column(at).to_pylist(), [], []
            for b, e in small_portions(texts):
                v = profiles.bundles(texts[b:e])
                norm = np.linalg.norm(v, axis=1)
                cos = v @ unit / np.maximum(norm, 1e-30)[:, None] if langs else np.zeros((e - b, 0))
                some = [any(ch.isalpha() for ch in t or "") and bool(langs) for t in texts[b:e]]
                best = cos.argmax(1) if langs else np.zeros(e - b, int)
                names += [langs[k] if ok else "und" for k, ok in zip(best, some)]
                scores += [min(1.0, max(0.0, float(c[k]))) if ok else 0.0 for c, k, ok in zip(cos, best, some)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    added = docs.select(*docs.columns, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.mapInArrow(run, added.schema)


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """From documents with a language whose crc32(doc_id) mod 4 isn't 2."""
    ensure_importable(docs.sparkSession)
    return prototypes(docs.where(remainder(F.col("doc_id"), 4) != 2), "text", "lang")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, protos = learned(docs)
    held = docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    return identify(held, langs, protos).select("doc_id", "held_out", "lang_pred", "score")
