"""From documents to token ids: languages, near-duplicates, benchmark passages, mixture, blocks of ids.

Each stage takes ``(spark, docs, sf_dir)`` and is written as Parquet before the next one reads it. All but the
last return the columns of ``documents``. As a stage's result has been written when the next one is called, that
removes what earlier stages kept in the shared folder, but for what its ``docs`` read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.decontam import decontaminate
from lociflow.llm.language_id import identify, learned
from lociflow.llm.mixing import mix
from lociflow.llm.near_dup import near_duplicates
from lociflow.llm.pfor import digest_of
from lociflow.shared import cut, discard, recorded

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text of LETTERS letters or more whose best cosine is below LEAST is in no language that was learned.
LETTERS, LEAST = 100, 0.1


#: Paths that stages have written, by the stage's number.
_SCRATCH: dict[int, list[str]] = {}


def _stage(number: int) -> Callable:
    def register(make):
        @wraps(make)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if any(k < number for k in _SCRATCH):
                reads = docs.inputFiles()
                for k in [k for k in _SCRATCH if k < number]:
                    paths = _SCRATCH.pop(k)
                    used = [p for p in paths if any(p.rsplit("/", 1)[1] in f for f in reads)]
                    discard(spark, *(p for p in paths if p not in used))
                    if used:
                        _SCRATCH[k] = used
            with recorded() as paths:
                out = make(spark, docs, sf_dir)
            _SCRATCH.setdefault(number, []).extend(paths)
            return out

        return run

    return register


@_stage(0)
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and longer ones that are like no language learned.

    A null or empty text has no letter and goes. Rows with a null language or text teach nothing, a null id is never held out; without any
    language to learn from all go. Ties go to the language first by name, and repeated rows are decided alike. Columns other
    than COLUMNS are dropped; no rows give no rows."""
    langs, protos = learned(docs)
    found = identify(docs, langs, protos)
    letters = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", ""))
    kept = (F.col("lang_pred") != "und") & ((letters < LETTERS) | (F.col("score") >= LEAST))
    return found.where(kept).select(*COLUMNS)


@_stage(1)
def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    A null id counts as the largest; of repeated rows one stays. Null and empty texts and those without words are one group.
    Columns other than COLUMNS are dropped; no rows give no rows."""
    return near_duplicates(docs).select(*COLUMNS)


@_stage(2)
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none and stay; items with a null id or text are left out; repeated rows are decided alike.
    Columns other than COLUMNS are dropped; no rows give no rows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).where(F.size("item_ids") == 0).select(*COLUMNS)


@_stage(3)
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, in a shuffled order.

    A null ``n_chars`` counts 0, and a source without any is not repeated at all; null is a source of its own. Rows that repeat an
    id, or have none, have equal counts; ties of the order go by id. Columns other than COLUMNS are dropped; no rows give no rows."""
    return mix(docs, mass=F.col("n_chars")).select(*COLUMNS)


@_stage(4)
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written in blocks of token ids; what is read back from the files.

    Null ids come first, rows that repeat an id stand in order of their text's hash; a null or empty text has just the end id. No
    rows give no files and no rows."""
    return digest_of(docs)


STAGES = [("language", language), ("near_duplicates", near_dups), ("benchmark", benchmark), ("mixture", mixture), ("token_ids", token_ids)]

#: The stages hash with XXH64, learn vectors and encode with a tokenizer: not for SQL. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
