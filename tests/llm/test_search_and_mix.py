import math

import numpy as np
from pyspark.sql import functions as F

from lociflow.llm.mixing import mix, rates
from lociflow.llm.topk import top_k

VEC = "vec_id long, embedding array<float>, label int"


def test_top_k(spark):
    draw = np.random.default_rng(2)
    data = [(i, draw.normal(0, 0.2, 40).tolist(), 0) for i in range(300)]
    data += [(300, data[10][1], 0), (301, data[10][1], 0), (302, None, 0), (303, [None] * 40, 0), (304, [float("nan")] * 40, 0), (305, [0.5], 0), (310, [0.25], 0), (None, data[0][1], 0)]
    df = spark.createDataFrame(data, VEC).repartition(3)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0).collect())
    vec = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(vec):
        if q % 10 == 0:
            score = sorted((-int(vec[q] @ v), i) for i, v in vec.items() if i != q and len(v) == len(vec[q]))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(score)]
    assert got == sorted(want)
    assert top_k(df.where("vec_id < 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_keeps_large_components_and_repeated_rows(spark):
    rows = [(1, [300000.0, 0.0]), (2, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1e300, -1.0]), (4, [2.0**40, 2.0**40]), (50, [1.0, 1.0]), (100, [2.0**30, 1.0]), (150, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(2)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).collect())
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for q, a in whole:
        if q % 50 == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in whole if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_mixing(spark, odd, empty):
    out = mix(odd, mass=F.col("n_chars"))
    assert out.columns == [*odd.columns, "mix_rate", "mix_copy", "mix_order"]
    order = [r["mix_order"] for r in out.collect()]
    assert order == sorted(order)
    assert mix(empty).count() == 0
    assert mix(odd, weights={"s0": 1.0}).where("source <> 's0' or source is null").count() == 0


def test_counts_follow_the_poisson_distribution(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("source"))
    w = {"rare": 0.5, "hot": 0.5}
    rate = {r["mix_source"]: r["rate"] for r in rates(docs, "source", F.lit(1), w).collect()}
    assert abs(rate["rare"] - 50) < 1e-9 and abs(rate["hot"] - 0.5 / 0.99) < 1e-9
    n = {r["source"]: r["n"] for r in mix(docs, weights=w, shuffle=False).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["rare"] - 10_000) < 500 and abs(n["hot"] - 10_000) < 500
    counts = mix(docs, weights=w, shuffle=False).where("source = 'hot'").groupBy("doc_id").count().groupBy("count").agg(F.count("*").alias("n"))
    got = {r["count"]: r["n"] for r in counts.collect()}
    m = rate["hot"]
    for k in (1, 2, 3):
        assert abs(got[k] - 19_800 * math.exp(-m) * m**k / math.factorial(k)) < 4 * math.sqrt(19_800 * math.exp(-m) * m**k / math.factorial(k))
    again = mix(docs.repartition(7), weights=w, shuffle=False).agg(F.sum(F.xxhash64("doc_id", "mix_copy").cast("decimal(38,0)"))).first()
    assert again == mix(docs, weights=w, shuffle=False).agg(F.sum(F.xxhash64("doc_id", "mix_copy").cast("decimal(38,0)"))).first()
