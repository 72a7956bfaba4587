import random

import pytest
from pyspark.sql import functions as F

from lociflow.operators import scan


def rows_of(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), x, i) for i, x in enumerate(sorted(rng.sample(range(-40, 300), 90)))] + [("c", 5, 900)]
    return rows, spark.createDataFrame(rows, "chr string, x long, id long").repartition(3)


@pytest.mark.parametrize("width", [1, 7, 50, 1000])
def test_beside_against_neighbours(spark, width):
    rows, df = rows_of(spark, width)
    found = {r["id"]: (r["before"] and r["before"]["id"], r["after"] and r["after"]["id"]) for r in scan.beside(df, ["chr"], "x", ["x", "id"], F.struct("id"), width).collect()}
    for c in "abc":
        own = [r[2] for r in rows if r[0] == c]
        for i, k in enumerate(own):
            assert found[k] == (own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None)


@pytest.mark.parametrize("width", [1, 7, 50, 1000])
@pytest.mark.parametrize("gap", [0, 3, 8, 500])
def test_runs_against_a_loop(spark, width, gap):
    rows, df = rows_of(spark, width + gap)
    found = {r["id"]: (r["run"], r["place"]) for r in scan.runs(df, ["chr"], "x", ["x", "id"], F.struct("x"), lambda p, s: s["x"] - p["x"] > gap, width).collect()}
    for c in "abc":
        last, run, place = None, 0, 0
        for _, x, k in (r for r in rows if r[0] == c):
            if last is None or x - last > gap:
                run, place = run + 1, 0
            else:
                place += 1
            assert found[k] == (run, place)
            last = x


def test_scans_of_no_rows(spark):
    none = spark.createDataFrame([], "chr string, x long")
    assert scan.beside(none, ["chr"], "x", ["x"], F.struct("x")).collect() == []
    assert scan.runs(none, ["chr"], "x", ["x"], F.struct("x"), lambda p, s: s["x"] > p["x"]).collect() == []


def test_numbers_run_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), F.lit("a").alias("s")).repartition(5)
    assert [(r["x"], r["n"]) for r in scan.numbered(df, "n", "x").orderBy("x").collect()] == [(x, k + 1) for k, x in enumerate(sorted(i * 7919 % 1009 for i in range(1000)))]
