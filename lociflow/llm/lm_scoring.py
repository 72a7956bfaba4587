"""Log-likelihood of whole documents under a gated recurrent model that is learned from the corpus.

1. Texts become chunks: a chunk's documents hold numbers into the chunk's own list of words, and that list
   is counted once a chunk, so the words that are shuffled are the distinct words of chunks, not all words.
2. The words' counts over all training documents are summed and joined back to the chunks.
3. Each document is rewritten as words of the model's vocabulary, with the sums that words outside it need.
4. The model is learned from all training documents: replicas learn from their share of a round's documents,
   start together, and are averaged after each round. Each document is in one round.
5. Every document is scored, its state carried from window to window.

A word outside the vocabulary has the model's probability for any such word, times its share of them:
(c + 1) / (sum of c + 1 over them, + 1 for all words not met in training).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.gru import END, OTHER, Learner, Model, Shape
from lociflow.llm.packing import pack, unpack
from lociflow.llm.text import remainder
from lociflow.shared import cut, ensure_importable

#: Words of a chunk; a longer document is a chunk of its own.
CHUNK = 2_000_000
#: Words that a replica lays out in lanes at a time.
LAID_OUT = 12_000_000
#: No word is empty: the end's name in the lists of words.
END_WORD = b""
#: Of the equal parts of the training documents, those of each round.
PARTS = 16
ROUNDS = ((0,), (1, 2, 3), tuple(range(4, 16)))
#: The vocabulary has at least LEAST_CLASSES classes, and GROWTH as a power of the distinct words if that is more.
LEAST_CLASSES, GROWTH, PER_CLASS = 15, 0.22, 32
#: Words of documents that are packed together.
PACKED = 200_000
_CHUNK_SCHEMA = "chunk string, docs binary, lid int, word binary, c long"


def part_of(doc_id: int | None) -> int:
    """Which of PARTS equal parts of the documents it is in."""
    return zlib.crc32(f"part {doc_id}".encode()) % PARTS


def chunks(rows: DataFrame) -> DataFrame:
    """Rows of two kinds: packed documents (ids, null flags, parts, learn flags, sizes, words) and words (``lid``, ``word``, ``c`` in training)."""
    from pyspark import TaskContext

    names = ["chunk", "docs", "lid", "word", "c"]
    types = [pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]

    def told(number: int, waiting: list[tuple]):
        name = f"{TaskContext.get().partitionId()}-{number}"
        doc_ids, null, learn, sizes = (np.concatenate([x[k] for x in waiting]) for k in range(4))
        coded = pa.concat_arrays([x[4] for x in waiting]).dictionary_encode()
        listed = pa.concat_arrays([coded.dictionary, pa.array([END_WORD], pa.binary())])
        ids = np.insert(coded.indices.to_numpy(), np.cumsum(sizes), len(listed) - 1).astype("<u4")
        sizes = sizes + 1
        counts = np.bincount(ids[np.repeat(learn, sizes)], minlength=len(listed))
        parts = np.array([part_of(None if no else x) for x, no in zip(doc_ids.tolist(), null.tolist())], np.uint8)
        upto, begin = np.append(0, np.cumsum(sizes)), 0
        while begin < len(sizes):
            end = min(len(sizes), int(np.searchsorted(upto, upto[begin] + PACKED)))
            own = slice(begin, end)
            packed = pack(doc_ids[own].astype("<i8"), null[own], parts[own], learn[own], sizes[own].astype("<i8"), ids[upto[begin] : upto[end]])
            yield pa.record_batch([pa.array([name]), pa.array([packed]), *(pa.nulls(1, t) for t in types[2:])], names)
            begin = end
        for b in range(0, len(listed), 1 << 16):
            part = listed[b : b + (1 << 16)]
            n = len(part)
            yield pa.record_batch([pa.array([name] * n), pa.nulls(n, pa.binary()), pa.array(np.arange(b, b + n), pa.int32()), part, pa.array(counts[b : b + n])], names)

    def run(batches):
        number, held, waiting = 0, 0, []
        for batch in batches:
            doc_ids, learn, texts = (batch.column(k) for k in range(3))
            null, doc_ids = pc.is_null(doc_ids).to_numpy(zero_copy_only=False), pc.fill_null(doc_ids, 0).to_numpy()
            learn = learn.to_numpy(zero_copy_only=False).astype(bool)
            # As text.ascii_words, but that empty words come before and after white space at a text's ends.
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
            words = pc.cast(lists.values, pa.binary())
            some = pc.greater(pc.binary_length(words), 0)
            upto = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[np.asarray(lists.offsets)]
            words, sizes, begin = words.filter(some), np.diff(upto), 0
            total = np.append(0, np.cumsum(sizes + 1))
            while begin < len(sizes):
                end = min(len(sizes), int(np.searchsorted(total, total[begin] + CHUNK - held)))
                waiting.append((doc_ids[begin:end], null[begin:end], learn[begin:end], sizes[begin:end], words[upto[begin] : upto[end]]))
                held += int(total[end] - total[begin])
                if held >= CHUNK:
                    yield from told(number, waiting)
                    number, held, waiting = number + 1, 0, []
                begin = end
        if waiting:
            yield from told(number, waiting)

    return rows.mapInArrow(run, _CHUNK_SCHEMA)


def encoded(chunked: DataFrame, counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(doc_id, learn, part, n_tokens, n_known, logs, other_logs, ids)`` for each document; ``ids`` are 16-bit numbers of
    the model's words, ``logs`` sums log10(c + 1) over its words and ``other_logs`` over those outside the vocabulary."""
    words = chunked.where("word is not null").select("chunk", "lid", "word")
    known = words.join(counts, "word", "left").join(F.broadcast(vocabulary), "word", "left")  # a bounded list
    known = known.select(F.col("chunk").alias("of_chunk"), "lid", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("mid", F.lit(OTHER)).alias("mid"))
    docs = chunked.where("docs is not null").select("chunk", "docs")
    names = ["doc_id", "learn", "part", "n_tokens", "n_known", "logs", "other_logs", "ids"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lid = right.column("lid").to_numpy()
        c, mid = np.zeros(len(lid), np.int64), np.zeros(len(lid), np.uint16)
        c[lid], mid[lid] = right.column("c").to_numpy(), right.column("mid").to_numpy()
        logs, other = np.log10(c + 1.0), mid == OTHER
        cols: list[list] = [[] for _ in names]
        for x in left.column("docs"):
            ids, null, of, learns, sizes, words = unpack(x.as_py(), "<i8", "?", "u1", "?", "<i8", "<u4")
            for doc_id, is_null, part, learn, w in zip(ids.tolist(), null.tolist(), of.tolist(), learns.tolist(), np.split(words, np.cumsum(sizes)[:-1])):
                own = logs[w]
                row = (None if is_null else doc_id, learn, part, len(w), int((c[w] > 0).sum()), float(own.sum()), float(own[other[w]].sum()), mid[w].astype("<u2").tobytes())
                for col, y in zip(cols, row):
                    col.append(y)
        types = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(cols, types)], names)

    return (
        docs.groupBy("chunk")
        .cogroup(known.groupBy("of_chunk"))
        .applyInArrow(run, "doc_id long, learn boolean, part int, n_tokens long, n_known long, logs double, other_logs double, ids binary")
    )


def learn_round(docs: DataFrame, shape: Shape, flat: np.ndarray, rate: float) -> np.ndarray:
    """Parameters after replicas have learned from ``docs``, averaged by their words."""
    sent = docs.sparkSession.sparkContext.broadcast(flat)

    def run(batches):
        learner = None
        waiting: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for x in batch.column(0):
                waiting.append(np.frombuffer(x.as_py(), "<u2"))
                held += len(waiting[-1])
                if held >= LAID_OUT:
                    learner = learner or Learner(Model(shape, sent.value.copy()), rate)
                    learner.learn(waiting)
                    waiting, held = [], 0
        if waiting:
            learner = learner or Learner(Model(shape, sent.value.copy()), rate)
            learner.learn(waiting)
        if learner:
            v = learner.model.flat.astype(np.float64) * learner.words
            yield pa.record_batch([pa.array(np.arange(len(v)), pa.int32()), pa.array(np.full(len(v), learner.words)), pa.array(v)], ["place", "n", "v"])

    # Sums that are combined before and while they are shuffled, however many replicas there are.
    found = docs.select("ids").mapInArrow(run, "place int, n long, v double").groupBy("place").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    rows = found.select("place", F.col("v") / F.col("n")).toPandas()  # one model, of a size known beforehand
    if not len(rows):
        return flat
    out = np.empty(shape.size, np.float32)
    out[rows.iloc[:, 0]] = rows.iloc[:, 1]
    return out


def words_for(distinct: int) -> int:
    """Words of the model's vocabulary, by how many are met in training; 16 bits number them."""
    return PER_CLASS * max(LEAST_CLASSES, min(2000, int(distinct**GROWTH)))


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, hidden: int = 12, rate: float = 0.01) -> DataFrame:
    """``(id_col, learn, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    The model learns from rows where ``learn`` is true (null: false) and scores every row; scores are log10
    probabilities. A null text is empty: just an end. A null id is kept as it is, repeated rows each count
    and each score. The vocabulary (default: ``words_for``) grows with the words met in training. A document's round goes
    by its id; a replica learns from the documents of a task, so scores depend a little on how the rows are dealt out.
    With no row to learn from, counts are 0 and the model stays at its start. An empty table
    gives an empty one. Further columns play no part.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("string").alias("text"))
    chunked = cut(chunks(rows), "chunks")
    counts = cut(chunked.where("word is not null and c > 0").groupBy("word").agg(F.sum("c").alias("c")), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = words_for(v) if words is None else words
    top = [(bytes(r["word"]), r["c"]) for r in counts.where(F.octet_length("word") > 0).orderBy(F.desc("c"), "word").limit(words).collect()]
    end = counts.where(F.octet_length("word") == 0).first()
    ends = end["c"] if end else 0
    listed = [(END_WORD, END), *((w, i + 2) for i, (w, _) in enumerate(top))]
    vocabulary = spark.createDataFrame([(bytearray(w), i) for w, i in listed], "word binary, mid int")
    data = cut(encoded(chunked, counts, vocabulary), "encoded")

    shape = Shape(words, hidden, PER_CLASS)
    inside = ends + sum(c for _, c in top)
    flat = shape.start(np.array([n - inside, ends, *(c for _, c in top)], np.float64))
    for parts in ROUNDS:
        flat = learn_round(data.where(F.col("learn") & F.col("part").isin(*parts)), shape, flat, rate)
    base = float(np.log10(n + v + 1))
    others = float(np.log10((n - inside) + (v - len(top) - (ends > 0)) + 1))
    sent = spark.sparkContext.broadcast(flat)

    def run(batches):
        model, waiting, held = Model(shape, sent.value), [], 0

        def told():
            docs = [np.frombuffer(x.pop("ids"), "<u2") for x in waiting]
            logs = model.score(docs) / np.log(10)
            out = {k: [x[k] for x in waiting] for k in ("doc_id", "learn", "n_tokens", "n_known")}
            out["base_score"] = [x["logs"] - x["n_tokens"] * base for x in waiting]
            out["score"] = [float(a) + x["other_logs"] - int((d == OTHER).sum()) * others for a, x, d in zip(logs, waiting, docs)]
            return pa.record_batch([pa.array(out["doc_id"], pa.int64()), pa.array(out["learn"], pa.bool_()), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()), pa.array(out["base_score"], pa.float64()), pa.array(out["score"], pa.float64())], [*out])

        for batch in batches:
            for x in batch.to_pylist():
                waiting.append(x)
                held += x["n_tokens"]
                if held >= LAID_OUT // 2:
                    yield told()
                    waiting, held = [], 0
        if waiting:
            yield told()

    scored = data.select("doc_id", "learn", "n_tokens", "n_known", "logs", "other_logs", "ids").mapInArrow(run, "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc_id").alias(id_col), "learn", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # A row with a null id has no remainder; it is neither learned from nor held out.
    kept = score_documents(docs, remainder(F.col("doc_id"), 7) != 2)
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    return kept.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
