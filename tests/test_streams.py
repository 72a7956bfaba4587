from pyspark.sql import functions as F

from lociflow.operators import merging as M
from lociflow.plans.queries import QUERIES
from lociflow.streaming import filters as ST
from lociflow.streaming import merging as SM
from tests.test_merging import SHAPE, draw, result

SF = "/root/testdata/sf0.001"


def test_merging_stream_ends_like_one_run(spark, tmp_path):
    rows = sorted(draw(5, 90, 200), key=lambda r: (r[1], r[0]))
    source, folder, at = (str(tmp_path / x) for x in ("in", "merged", "at"))
    assert SM.merged_so_far(spark, folder)[0].collect() == []
    for part in (rows[:30], rows[30:31], rows[31:]):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(source)
        SM.merging(spark.readStream.schema(SHAPE).parquet(source), folder, 12).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    found = SM.merged_so_far(spark, folder)
    assert result(*found) == result(*M.merged(spark.createDataFrame(rows, SHAPE), 12))


def test_a_batch_run_again_replaces_what_it_wrote(spark, tmp_path):
    rows = sorted(draw(6, 40, 100), key=lambda r: (r[1], r[0]))
    folder = str(tmp_path / "merged")
    steps = []

    class Keep:
        def foreachBatch(self, f):
            steps.append(f)

    class Stream:
        writeStream = Keep()

    SM.merging(Stream(), folder, 10)
    for batch, part in ((0, rows[:20]), (0, rows[:20]), (1, rows[20:]), (1, rows[20:])):
        steps[0](spark.createDataFrame(part, SHAPE), batch)
    assert result(*SM.merged_so_far(spark, folder)) == result(*M.merged(spark.createDataFrame(rows, SHAPE), 10))


def test_late_rows_fall_out_of_closed_windows(spark, tmp_path):
    shape = "ts timestamp, kind string"
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    minute = lambda k: F.timestamp_seconds(F.lit(1_700_000_000 // 600 * 600 + 60 * k))
    one = lambda *ks: spark.range(1).select(F.explode(F.array(*(minute(k) for k in ks))).alias("ts"), F.lit("a").alias("kind"))
    for part in (one(1, 2, 3, 15), one(40), one(4, 5, 41), one(90), one(91)):
        part.coalesce(1).write.mode("append").parquet(source)
        out = ST.tumbling_counts(spark.readStream.schema(shape).parquet(source), "ts", "10 minutes", "5 minutes", "kind")
        out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "at")).option("path", sink).format("parquet").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3]  # the two late ones count nowhere


def test_stream_query_of_the_merger_is_that_of_one_run(spark):
    from lociflow.plans.queries import ENDS
    from lociflow.plans.views import Views

    rows = Views(spark, SF).adj.where("chr1 = chr2").select("aid", *ENDS, F.col("k").alias("ord"))
    clusters, members = M.merged(rows, 300)
    whole = members.join(clusters, "mid").select("aid", "mid", *ENDS, "n")
    assert sorted(map(tuple, QUERIES["q_stream_merger"](spark, SF).collect())) == sorted(map(tuple, whole.collect()))


def test_merger_query_against_brute_force(spark):
    from lociflow.plans.queries import ENDS
    from lociflow.plans.views import Views
    from tests.test_merging import brute

    rows = [tuple(r) for r in Views(spark, SF).adj.select("aid", "k", *ENDS).collect()]
    found = {}
    for r in QUERIES["q_merger"](spark, SF).collect():
        ends = (r["chr1"], r["strand1"], r["coord1"]), (r["chr2"], r["strand2"], r["coord2"])
        found.setdefault((r["mid"], min(ends), max(ends)), []).append(r["aid"])
    assert sorted((k[1], k[2], sorted(v)) for k, v in found.items()) == brute(rows, 20000)
