"""Token ids, their files and lengths, the language model, languages, benchmark passages."""

import zlib

import numpy as np
import pytest

from lociflow.llm import decontam as D
from lociflow.llm import language_id as G
from lociflow.llm import lengths as L
from lociflow.llm import pfor as P
from lociflow.llm.encoding import Encoder
from lociflow.llm.gru import Learner, Model, Shape
from lociflow.llm.language_id import identify, prototypes
from lociflow.llm.lm_scoring import score_documents
from lociflow.llm.text import remainder, remainder_of
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def ids_of():
    e = Encoder(P.default_tokenizer())
    return lambda t: e.whole.encode(t or "", add_special_tokens=False).ids


def test_word_by_word_ids_are_those_of_whole_texts(odd, some, ids_of):
    texts = [r["text"] for r in odd.select("text").union(some.select("text")).limit(80).collect()] + ["a\x1cb \x85 c\xa0d", "Σας ΣΑΣ µ ª İ", "x<|startoftext|>y", "é ́"]
    flat, size = Encoder(P.default_tokenizer(), keep=50, keep_pieces=50).encode(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("top", [1, 2, 300, 65_536, 2**32 - 1])
def test_blocks_round_trip(top):
    draw = np.random.default_rng(top % 97)
    for n in (1, 2, 255, 256, 257, 3000):
        ids = np.where(draw.random(n) < 0.05, draw.integers(0, top, n, dtype=np.uint64), draw.integers(0, min(top, 40) or 1, n)).astype(np.uint32)
        blocks = P.pack(ids)
        starts = np.cumsum([0, *map(len, blocks)])[:-1]
        assert np.array_equal(P.unpack(np.frombuffer(b"".join(blocks), np.uint8), starts), ids)


def test_files_hold_all_documents_in_order(spark, odd, empty, ids_of):
    rows = [tuple(r) for r in P.digest_of(odd).collect()]
    want = {}
    for r in odd.collect():
        ids = [*ids_of(r["text"]), 2]
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for i, own in want.items():
        assert sorted((n, c) for d, _, n, c in rows if d == i) == sorted(own)
    order = sorted(rows, key=lambda r: r[1])
    assert [r[0] for r in order] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    assert [r[1] for r in order] == [0, *np.cumsum([r[2] for r in order])[:-1].tolist()]
    assert P.digest_of(empty).count() == 0


def test_ids_are_read_back(spark, odd, empty, ids_of, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "FILE_IDS", 40)  # several files in a range
    files = P.write_ids(odd, P.default_tokenizer(), f"file://{tmp_path}/a", end_id=None)
    got = P.read_ids(f"file://{tmp_path}/a", files).collect()
    assert files.count() > 3 and sum(f["ids"] for f in files.collect()) == sum(r["n_tokens"] for r in got)
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got) == sorted((repr(r["doc_id"]), ids_of(r["text"])) for r in odd.collect())
    order = sorted(got, key=lambda r: (r["start"], r["n_tokens"]))
    assert [r["start"] for r in order] == [0, *np.cumsum([r["n_tokens"] for r in order])[:-1].tolist()]
    assert P.read_ids(f"file://{tmp_path}/b", P.write_ids(empty, P.default_tokenizer(), f"file://{tmp_path}/b")).count() == 0


def test_length_sums(spark, odd, empty, ids_of):
    hist = L.length_histogram(odd, P.default_tokenizer())
    n = [len(ids_of(r["text"])) for r in odd.collect()]
    for r in L.suffix_sums(hist).collect():
        x = r["length"]
        assert (r["docs_ge"], r["tokens_ge"], r["truncated_total"]) == (sum(k >= x for k in n), sum(k for k in n if k >= x), sum(min(k, x) for k in n))
        assert r["n_docs"] == n.count(x) and abs(r["share_le"] - sum(k <= x for k in n) / len(n)) < 1e-12
    limits = {r["context"]: (r["docs_over"], r["tokens_total"], r["tokens_kept"]) for r in L.truncated_totals(hist, [5, 10**9]).collect()}
    assert limits == {5: (sum(k > 5 for k in n), sum(n), sum(min(k, 5) for k in n)), 10**9: (0, sum(n), sum(n))}
    assert L.quantiles(L.suffix_sums(hist), [0.5]).first()["length"] == sorted(n)[-(-len(n) // 2) - 1]
    none = L.length_histogram(empty, P.default_tokenizer())
    assert L.suffix_sums(none).count() == 0
    assert [tuple(r) for r in L.quantiles(L.suffix_sums(none), [0.5]).collect()] == [(0.5, None)]
    assert [tuple(r) for r in L.truncated_totals(none, [5]).collect()] == [(5, 0, 0, 0)]


def test_gradient_and_total_probability():
    shape = Shape(6, 5, 3)
    model = Model(shape, shape.start(np.array([5, 3, 4, 3, 2, 2, 1, 1], float)).astype(np.float32))
    words = np.array([[2, 3], [4, 0], [1, 5], [6, 1]])
    mask = np.ones_like(words, bool)
    h = np.zeros((2, 5), np.float32)
    g, _, _ = model.gradient(words, mask, h)
    draw = np.random.default_rng(0)
    for k in draw.choice(shape.size, 60, replace=False):
        keep, eps, out = model.flat[k], 1e-2, []
        for s in (1, -1):
            model.flat[k] = keep + s * eps
            out.append(-model.gradient(words, mask, h)[1] / mask.sum())
        model.flat[k] = keep
        assert abs((out[0] - out[1]) / (2 * eps) - g[k]) < 5e-3
    one = [np.array([w]) for w in range(8)]  # every word of the vocabulary, from the first state
    assert abs(np.exp(model.score(one)).sum() - 1) < 1e-4
    text = np.array([2, 3, 4, 5, 0, 6, 1])
    assert abs(model.score([text], window=2)[0] - model.score([text, text[::-1].copy()], window=5)[0]) < 1e-4


def test_learning_lowers_the_loss():
    shape, draw = Shape(8, 8, 4), np.random.default_rng(0)
    docs = [np.array([*([2, 3] * 10 if draw.random() < 0.5 else [4, 5] * 10), 1]) for _ in range(200)]
    model = Model(shape, shape.start(np.bincount(np.concatenate(docs), minlength=10)))
    before = model.score(docs).sum()
    learner = Learner(model, 0.02, full=128)
    for _ in range(5):
        learner.learn(docs, lanes=16, window=8)
    assert model.score(docs).sum() > 0.6 * before


def test_words_of_a_chunk_are_counted_at_once(monkeypatch):
    """Once for all documents, not once for each over the chunk's whole list of words."""
    import pyarrow as pa

    from lociflow.llm import lm_scoring

    calls, counted = [], np.bincount

    class Rows:
        def mapInArrow(self, run, schema):
            return list(run([pa.record_batch([pa.array([1, 2, 3]), pa.array([True, False, True]), pa.array(["a b a", "b c", "A d"])], ["doc_id", "learn", "text"])]))

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    monkeypatch.setattr(lm_scoring.np, "bincount", lambda *x, **y: calls.append(1) or counted(*x, **y))
    out = lm_scoring.chunks(Rows())
    words = {w: c for b in out if b.column("word").null_count == 0 for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist())}
    assert words == {b"a": 3, b"b": 1, b"": 2, b"c": 0, b"d": 1}
    assert len(calls) == 1


def test_scores(spark, some, odd, empty):
    import math
    from collections import Counter

    docs = some.unionByName(odd, allowMissingColumns=True)
    out = score_documents(docs, remainder(F.col("doc_id"), 7) != 2)
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    count = Counter()
    for r in docs.collect():
        if r["doc_id"] is not None and remainder_of(r["doc_id"], 7) != 2:
            count.update(words(r["text"]))
    n, v = sum(count.values()), len(count)
    want = sorted((repr(r["doc_id"]), len(words(r["text"])), sum(count[w] > 0 for w in words(r["text"])), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(r["text"])), 4)) for r in docs.collect())
    rows = out.collect()
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in rows) == want
    assert {r["train_tokens"] for r in rows} == {n} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    held = [r for r in rows if not r["learn"] and r["n_tokens"] > 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert score_documents(empty, F.lit(True)).count() == 0


def test_languages(spark, some, odd, empty, monkeypatch):
    learn = some.where(remainder(F.col("doc_id"), 4) != 2)
    langs, protos = prototypes(learn, "text", "lang")
    assert langs == ["de", "en", "es", "fr"]
    # A bundle is the sum of its n-grams' bound vectors, whatever the slices, and prototypes are sums of bundles.
    letter = lambda ch: 2 * np.random.Generator(np.random.PCG64([7, ord(ch)])).integers(0, 2, 1024, dtype=np.int8).astype(int) - 1
    gap = 2 * np.random.Generator(np.random.PCG64([7, 0])).integers(0, 2, 1024, dtype=np.int8).astype(int) - 1

    def brute(text):
        total = np.zeros(1024, int)
        for word in "".join(ch if ch.isalpha() else " " for ch in (text or "").lower()).split():
            vs = [gap, *map(letter, word), gap]
            for k in range(len(vs) - 2):
                total += np.roll(vs[k], 2) * np.roll(vs[k + 1], 1) * vs[k + 2]
        return total

    texts = [r["text"] for r in some.where("length(text) < 3000").limit(12).collect()] + [None, "", "a", "ab  12 c"]
    for size in (4096, 50):
        monkeypatch.setattr(G, "SLICE", size)
        assert np.array_equal(G.Profiles().bundles(texts), np.array([brute(t) for t in texts], np.float32))
    sums = {x: sum(brute(r["text"]) for r in learn.where(F.col("lang") == x).collect()) for x in ("de", "fr")}
    assert all(np.array_equal(protos[langs.index(x)], v) for x, v in sums.items())
    held = identify(some.where(remainder(F.col("doc_id"), 4) == 2), langs, protos).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in held)
    out = {r["doc_id"]: r for r in identify(odd, langs, protos).collect()}
    assert [out[k]["lang_pred"] for k in (3, 4, 5, 11)] == ["und"] * 4 and out[1]["lang_pred"] in langs
    assert identify(empty, langs, protos).count() == 0
    many = " ".join(chr(0x4E00 + k % 20000) + chr(0x4E00 + k // 5 % 20000) for k in range(200_000))
    assert identify(spark.createDataFrame([(1, many)], "doc_id long, text string"), langs, protos).first()["lang_pred"] in langs
    none = prototypes(empty, "text", "lang")
    assert {r["lang_pred"] for r in identify(odd, *none).collect()} == {"und"}


def brute_held(text, item):
    d, i = D.words_of(text), D.words_of(item)
    for shift in range(-len(i), len(d)):
        eq = [0 <= shift + k < len(d) and d[shift + k] == i[k] for k in range(len(i))]
        inside = [0 <= shift + k < len(d) for k in range(len(i))]
        need = min(D.STRETCH, len(i))
        for b in range(len(i)):
            for e in range(b + need, len(i) + 1):
                if all(inside[b:e]) and sum(eq[b:e]) >= D.SIMILARITY * (e - b) - 1e-9 and eq[b] and eq[e - 1]:
                    return True
    return False


@pytest.mark.parametrize("shuffle", [False, True])
def test_passages(spark, odd, empty, monkeypatch, shuffle):
    if shuffle:
        monkeypatch.setattr(D, "BROADCAST_BYTES", -1)
    item = [f"q{k}" for k in range(20)]
    worn = item.copy()
    worn[3], worn[11], worn[16] = "x", "y", "z"
    texts = [" ".join(item), "aa bb " + " ".join(worn) + " cc", " ".join(item[:14]), " ".join(item[:9]), "Q1 " * 30, "short one here", "a short ONE here, yes", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "Short one here"), (9, None), (None, "aa bb"), (10, "")], "item_id long, text string")
    out = {r["doc_id"]: r for r in D.decontaminate(docs, items).collect()}
    for i, t in enumerate(texts):
        assert out[i]["item_ids"] == [k for k, x in ((7, " ".join(item)), (8, "Short one here")) if t and brute_held(t, x)], i
    assert out[0]["covered_words"] == 20 and out[1]["covered_words"] == 20 and out[6]["covered_words"] == 3
    assert D.decontaminate(empty, items).count() == 0
    assert D.decontaminate(docs, items.where("item_id = 0")).where(F.size("item_ids") > 0).count() == 0


def test_masks_find_two_replacements_in_thirteen_words():
    from itertools import combinations

    for gone in combinations(range(D.STRETCH), 2):
        assert any(all(p + o not in gone for o in D.mask_offsets(m)) for m in D.MASKS for p in range(D.STRETCH - len(m) + 1))


@pytest.mark.parametrize("n", range(1, 21))
def test_no_placement_of_replaced_words_is_missed(n):
    from itertools import combinations

    item = D.Hasher()([f"w{k}" for k in range(n)])
    index, wrong = D.Index({0: item}), n - -(-4 * n // 5)
    others = D.Hasher()([f"x{k}" for k in range(n + 5)])
    for gone in combinations(range(1, n - 1), min(wrong, 3)):
        text = np.concatenate([others[:3], item, others[:2]])
        text[[3 + g for g in gone]] = others[list(gone)]
        held = any(D.overlap(text, item, shift) for _, shift in index.candidates(text))
        assert held == bool(D.overlap(text, item, 3)), gone
    if n < D.STRETCH:
        for gone in combinations(range(1, n - 1), wrong):
            text = item.copy()
            text[list(gone)] = others[list(gone)]
            assert any(D.overlap(text, item, shift) for _, shift in index.candidates(text)), gone
