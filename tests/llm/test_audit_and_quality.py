import hashlib
import zlib
from collections import Counter, defaultdict
from math import sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import divergence as dv
from lociflow.llm import quality as ql
from lociflow.llm import snapshot_diff as sd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tuples(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- snapshot difference


def brute_difference(old, new):
    """Rows ``(key, text, lang, source)``; keys without repeats, null keys only once for a content."""
    old, new = Counter(old), Counter(new)
    content = lambda r: r[1:]

    def least(rows):
        by = defaultdict(list)
        for r in rows:
            if r[0] is not None:
                by[r[0]].append(r)
        return {k: min(v, key=lambda r: digest(r)) for k, v in by.items()}

    def digest(r):
        h = [hashlib.sha256(x.encode()).hexdigest().upper() if x is not None else "null" for x in content(r)]
        return hashlib.sha256(",".join(h).encode()).digest()

    sha = lambda r: hashlib.sha256("\n".join("~" if x is None else x for x in content(r)).encode()).hexdigest()
    out, a, b = [], least(old), least(new)
    both = a.keys() & b.keys()
    for k in both:
        changed = ",".join(n for n, x, y in zip(("text", "lang", "source"), content(a[k]), content(b[k])) if x != y)
        out.append((k, k, "update" if changed else "same", changed, sha(b[k]), old[a[k]], new[b[k]]))
    rest = [defaultdict(list), defaultdict(list)]
    for side, (rows, own) in enumerate(((old, a), (new, b))):
        for r in rows:
            if r[0] not in both or own[r[0]] != r:
                rest[side][content(r)].append(r)
    for c in rest[0].keys() | rest[1].keys():
        x, y = (sorted(s[c], key=lambda r: (r[0] is None, r[0] or 0)) for s in rest)
        for i in range(max(len(x), len(y))):
            if i < len(x) and i < len(y):
                out.append((y[i][0], x[i][0], "rekey", "", sha(y[i]), old[x[i]], new[y[i]]))
            elif i < len(y):
                out.append((y[i][0], None, "insert", "", sha(y[i]), 0, new[y[i]]))
            else:
                out.append((x[i][0], x[i][0], "delete", "", None, old[x[i]], 0))
    return sorted(out, key=repr)


RESULT = ("key", "old_key", "op", "changed", "row_sha256", "old_copies", "new_copies")


def compare(spark, old, new):
    shape = "doc_id long, text string, lang string, source string, op string, Key long, words string, rank int"
    df = lambda rows: spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], shape)
    found = sd.difference(df(old), df(new), "doc_id", ("text", "lang", "source"))
    assert tuples(found, *RESULT) == brute_difference(old, new)


def test_difference_of_odd_rows(spark):
    old = [
        (1, "a", "en", "s"), (2, "a", "en", "s"), (3, "a", "en", "s"), (4, None, None, None), (5, "", "en", None), (6, "~", "~", "~"),
        (None, "n", "en", "s"), (None, "n", "en", "s"), (7, "x", "en", "s"), (7, "y", "en", "s"), (8, "long " * 100_000, "de", "s"), (2**62, "big", "en", "s"), (9, "r", "r", "r"), (9, "r", "r", "r"),
        (2**63 - 1, "end", "en", "s"), (None, "end", "en", "s"), (-(2**63), "end", "en", "s"),
    ]
    new = [
        (-2, "a", "en", "s"), (-3, "a", "en", "s"), (1, "a", "s", "en"), (4, None, None, "~"), (-5, "", "en", None), (-6, None, "~", "~"),
        (70, "n", "en", "s"), (7, "y", "en", "s"), (-8, "long " * 100_000, "de", "s"), (-(2**63), "big", "en", "s"), (9, "r", "r", "r"), (11, "r", "r", "r"), (None, "r", "r", "r"),
        (-7, "end", "en", "s"), (-6, "end", "en", "s"), (2**63 - 2, "end", "en", "s"),
    ]
    compare(spark, old, new)


def test_difference_of_empty_snapshots(spark):
    rows = [(1, "a", None, "s"), (None, "b", "en", "s")]
    compare(spark, rows, [])
    compare(spark, [], rows)
    compare(spark, [], [])


def test_difference_ranks_over_levels_of_containers(spark, monkeypatch):
    monkeypatch.setattr(sd, "RANK_BITS", 2)
    rng = np.random.default_rng(3)
    draw = lambda sign: [(sign * int(k), "same" if rng.random() < 0.7 else f"t{rng.integers(5)}", "en", None) for k in np.unique(rng.integers(1, 700, 220))]
    compare(spark, draw(1), draw(-1))


def test_op13_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    old = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    new = []
    for key, text, lang, source in old:
        r = zlib.crc32(str(key).encode()) % 10
        if r == 1:
            text = (text or "") + "+"
        if r == 2:
            lang, source = source, lang
        if r == 4:
            source = None
        if r:
            new.append((-1 - key if r in (3, 4) else key, text, lang, source))
        if r == 5:
            new.append((-1 - key, text, lang, source))
    assert tuples(sd.op13(spark, sf), *RESULT) == brute_difference(old, new)


def test_no_python_and_no_wide_text_in_the_difference(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bitmaps = sd.containers(docs.select(F.col("doc_id").alias("key")), docs.select(F.col("doc_id").alias("key")))
    assert bitmaps.agg(F.max(F.size("words"))).first()[0] <= 16
    assert "text" not in bitmaps._jdf.queryExecution().executedPlan().toString()


# ---- divergence


def brute_divergence(rows, least=3, top=200):
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    letter = lambda ch: ch.isascii() and ch.isalpha() or ord(ch) > 127
    terms_of = lambda t: "".join((ch.lower() if ch.isascii() else ch) if letter(ch) else " " for ch in t).split(" ")
    counts, having, groups = defaultdict(Counter), defaultdict(Counter), {(g, s) for _, g, s in rows}
    for t, g, s in rows:
        own = [w for w in terms_of(t) if w]
        counts[g, s].update(own)
        having[g].update(set(own))
    out = []
    for g in {g for g, _ in groups}:
        kept = [w for w, n in having[g].items() if n >= least]
        sources = sorted(s for x, s in groups if x == g)
        p = {}
        for s in [*sources, None]:
            c = counts[g, s] if s is not None else sum((counts[g, x] for x in sources), Counter())
            total = sum(c[w] for w in kept) + len(kept)
            p[s] = {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            found = [(-sum(f(p[s][w], p[x][w]) for w in kept), x.encode(), x) for x in sources if x != s]
            out += [(g, s, "pair", x, -v, i) for i, (v, _, x) in enumerate(sorted(found), 1)]
            found = [(-f(p[s][w], p[None][w]), w.encode(), w) for w in kept if counts[g, s][w] and p[s][w] > p[None][w]]
            out += [(g, s, "term", w, -v, i) for i, (v, _, w) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def test_divergence_of_odd_documents(spark, odd, empty):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    clash = odd.withColumn("term", F.lit("x")).withColumn("n", F.lit(1)).withColumn("value", F.lit(2)).withColumn("p0", F.lit(3))
    assert tuples(dv.divergence(clash), *COLUMNS) == brute_divergence(rows)
    assert tuples(dv.divergence(clash, least_docs=1, top=3), *COLUMNS) == brute_divergence(rows, 1, 3)
    assert dv.divergence(empty).collect() == []


def test_divergence_keeps_exact_with_small_portions(spark, monkeypatch):
    for name, value in (("HELD_TERMS", 3), ("HELD_ROWS", 4), ("SLICE", 5), ("SHARD_CHARS", 40), ("SHARD_ROWS", 2)):
        monkeypatch.setattr(dv, name, value)
    words = ["Éa", "b", "CC", "é", "ÉA", "the", "日本"]
    rng = np.random.default_rng(1)
    rows = [(" ".join(rng.choice(words, rng.integers(0, 9))) + "\x00x7y", str(rng.choice(["en", "de"])), f"s{rng.integers(4)}") for _ in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert tuples(dv.divergence(docs), *COLUMNS) == brute_divergence(rows)


def test_slices_of_a_text_are_its_terms(monkeypatch):
    text = "Ab c9déÉ \U0001f600x, " * 500
    whole = [w for part in dv.term_slices(text) for w in part]
    monkeypatch.setattr(dv, "SLICE", 7)
    assert [w for part in dv.term_slices(text) for w in part] == whole
    assert whole[:4] == [b"ab", b"c", "déÉ".encode(), "\U0001f600x".encode()]


# ---- quality


def test_op11_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = ql.op11(spark, sf)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = rows.score[rows.quality == 1].values, rows.score[rows.quality == 0].values
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert (rows.predicted == rows.quality).mean() > 0.95
    every = found.toPandas()
    assert len(every) == spark.read.parquet(f"{sf}/documents.parquet").count() and every.score.between(0, 1).all()
    assert (every.predicted == (every.score >= 0.3)).all()
    assert (every.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in every.doc_id]).all()


def test_scores_ignore_all_but_the_text(spark, some, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    once = {r["doc_id"]: r["score"] for r in ql.quality_scores(some, labels).collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = some.withColumn("lang", F.lit("xx")).withColumn("score", F.lit(9)).withColumn("y", F.lit(7)).withColumn("statistics", F.lit("s"))
    twice = {r["doc_id"]: r["score"] for r in ql.quality_scores(changed, other).collect()}
    assert all(abs(once[k] - twice[k]) < 1e-6 for k in once)


def test_scores_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (7, 1), (7, 0), (9, None), (None, 1), (99, 1)], "doc_id long, quality int")
    rows = ql.quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (3, 4)}
    assert len(same) == 1  # null and empty
    assert {r["score"] for r in ql.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert ql.quality_scores(empty, labels).collect() == []
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in ql.quality_scores(odd, one).collect())


def test_statistics_do_not_depend_on_slices(monkeypatch):
    text = "Ab cd cd, é!! \n $$x 12 " * 300
    whole = ql.statistics_of(text)
    monkeypatch.setattr(ql, "SLICE", 11)
    assert np.allclose(ql.statistics_of(text), whole)
    assert not ql.statistics_of(None).any() and not ql.statistics_of("").any()


def test_normal_equations_give_the_ridge_of_all_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, len(ql.NAMES)))
    y = (x[:, 0] + 0.3 * rng.standard_normal(300) > 0).astype(float)
    fold = rng.integers(0, ql.FOLDS, 300)
    rows = spark.createDataFrame([(list(map(float, a)), float(b), int(k)) for a, b, k in zip(x, y, fold)], "statistics array<double>, y double, fold int").repartition(3)
    fourier = ql.Fourier(x.mean(0), x.std(0), features=40)
    sums, moments = ql.normal_equations(rows, fourier)
    weights, without, ridge = ql.ridge_scores(sums, moments)
    z = fourier.of(x)
    penalty = np.diag([1e-9 * 300] + [ridge * 300] * 40)
    assert np.allclose(weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    own = fold != 2
    penalty = penalty * own.sum() / 300
    assert np.allclose(without[2], np.linalg.solve(z[own].T @ z[own] + penalty, z[own].T @ y[own]), atol=1e-6)


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 6))
    fourier = ql.Fourier(np.zeros(6), np.ones(6), features=20_000)
    z = fourier.of(x)[:, 1:]
    near = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 6))
    assert np.abs(z @ z.T - near).max() < 4 / sqrt(20_000) * 2


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_against_all_pooled_means(seed):
    rng = np.random.default_rng(seed)
    n, y = rng.integers(1, 5, 12).astype(float), rng.random(12)
    x = np.arange(12.0)
    knots, levels = ql.isotonic(x, n, y * n)
    assert (np.diff(levels) > 0).all()
    # min-max formula of isotonic regression
    mean = lambda i, j: (y[i : j + 1] * n[i : j + 1]).sum() / n[i : j + 1].sum()
    best = [max(min(mean(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
    assert np.allclose(sorted(set(np.round(best, 12))), np.round(levels, 12))
