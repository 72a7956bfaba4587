"""The stages' decisions against plain Python on a small table."""

import corpus_pipeline as C
from lociflow.llm.decontam import words_of
from pyspark.sql import functions as F


def test_stages(spark, odd, some, sf):
    docs = some.unionByName(odd.select(*some.columns).where("doc_id = 3 or doc_id = 4").withColumn("doc_id", F.col("doc_id") + 10_000)).limit(10**6)
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "benchmark", "mixture", "token_ids"]
    kept = C.language(spark, docs, sf)
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, kept))
    assert set(before) - set(after) == {i for i, t in before.items() if not any(c.isalpha() for c in t or "")}
    one = C.near_dups(spark, kept, sf)
    texts = [r["text"] for r in one.collect()]
    assert len(set(texts)) == len(texts) and {t for t in after.values()} >= set(texts)
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
    sets = [shingles(t) for t in texts]
    for t in set(after.values()) - set(texts):  # what goes is near something that stays, or was a copy of it
        own = shingles(t)
        assert max(len(own & s) / len(own | s) for s in sets) >= 0.8
    clean = C.benchmark(spark, one, sf)
    items = [" ".join(words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {t for t in texts if any(i in " ".join(words_of(t)) for i in items)}
    assert {r["text"] for r in clean.collect()} == set(texts) - held
    mixed = C.mixture(spark, clean, sf)
    assert mixed.columns == list(C.COLUMNS) and mixed.count() > 0
    final = C.token_ids(spark, mixed, sf)
    assert final.count() == mixed.count()


def test_stages_remove_what_earlier_ones_kept(spark, some, sf, tmp_path):
    import os

    from lociflow.shared import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    kept = lambda name: [x for x in os.listdir(root) if x.startswith(name)]
    before = set(kept("prototypes"))
    docs = some
    for k, (name, stage) in enumerate(C.STAGES[:3]):
        out = stage(spark, docs, sf)
        if k:
            assert set(kept("prototypes")) <= before
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    # A stage whose docs still read an earlier one's tables leaves them.
    one = C.near_dups(spark, some, sf)
    assert C.benchmark(spark, one, sf).count() > 0


def test_run_against_its_stages_one_by_one(spark, sf):
    whole = C.run(spark, sf)
    assert whole.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf)
    order = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert order(whole) == order(docs)
