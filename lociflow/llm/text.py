"""Words, shingles and stable splits shared by the operators on texts."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8 bytes.

    ``bytes.lower`` and ``bytes.split`` touch just A-Z and just those six separators. Lone surrogates,
    which UTF-8 has no bytes for, become question marks, as in Spark's own strings.
    """
    return [] if not text else text.encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``k`` words joined by spaces, repeats included; of all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def remainder_of(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus
