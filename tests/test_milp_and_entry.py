import importlib
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lociflow.operators import graph as G
from lociflow.operators import intervals as I
from lociflow.operators import milp
from lociflow.operators import tensor as T
from lociflow.plans.queries import QUERIES, SQL
from lociflow.streaming import filters as ST

SF = "/root/testdata/sf0.001"
ADJ = "aid string, chr1 string, coord1 long, strand1 string, chr2 string, coord2 long, strand2 string, at string"


def tiny(spark, cn=((1, 1), (1, 1)), high=3):
    segs = spark.createDataFrame([("1:1-10", "f1", "1", 1, 10), ("1:11-20", "f2", "1", 11, 20)], "sid string, fid string, chr string, start long, end long")
    scnt = spark.createDataFrame([(s, "c", h, n) for s, ab in zip(("1:1-10", "1:11-20"), cn) for h, n in zip("AB", ab)], "sid string, clone string, hap string, cn int")
    adj = I.reference_adjacencies(segs).select("aid", "chr1", "coord1", "strand1", "chr2", "coord2", "strand2", "at")
    tel = I.reference_telomeres(segs)
    return milp.Inputs(segs, scnt, T.bounds(scnt, segs, "uniform-min-max", high=high), adj, tel)


def test_counts_of_variables_and_rows(spark):
    i = tiny(spark)
    m = milp.model(i)
    s, c, r, a, f = 2, 1, 1, 1, 2
    assert m.variables.count() == f + c * (2 * s + 4 * r + 4 * a + 2 * s + 4 * a) + 4 * a
    assert m.variables.select("name").distinct().count() == m.variables.count()
    by = {x["k"]: x["n"] for x in m.constraints.groupBy(F.regexp_extract("row", "^[a-z]+", 0).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert by["low"] + by["high"] == 4 * c * s and by["over"] + by["under"] == 4 * c * s and by["big"] == 16 * c * a and by["node"] == 2 * c * 4 and by["ref"] == 2 * c * r


def test_lines_are_written_in_order_and_a_solution_is_read(spark, tmp_path):
    m = milp.model(tiny(spark))
    milp.write_lp(m, str(tmp_path / "lp"))
    files = sorted((tmp_path / "lp").glob("part-*"))
    lines = [x for f in files for x in f.read_text().splitlines()]
    assert lines == [r["value"] for r in milp.lp_lines(m).orderBy("section", "k", "n").collect()]
    heads = [lines.index(x) for x in ("Minimize", " obj:", "Subject To", "Bounds", "Generals", "End")]
    assert heads == sorted(heads) and lines[-1] == "End" and len([x for x in lines if x.startswith("\\ x")]) == m.variables.count()
    (tmp_path / "sol").write_text("# a comment\nx2 3\nx1 1.0\n x4  2.5\n")
    names = spark.createDataFrame([(k, f"v{k}") for k in range(1, 5)], "x long, name string")
    assert {r["name"]: r["value"] for r in milp.solution(spark, str(tmp_path / "sol"), names).collect()} == {"v1": 1.0, "v2": 3.0, "v3": 0.0, "v4": 2.5}


def small_model(spark, variables, rows):
    v = spark.createDataFrame(variables, "name string, kind string, lb double, ub double")
    c = spark.createDataFrame([(n, s, float(r)) for n, s, r, _ in rows], "row string, sense string, rhs double")
    e = spark.createDataFrame([(n, x, float(k)) for n, _, _, t in rows for x, k in t.items()], "row string, name string, coef double")
    return milp.Model(v, c, e, e.select("name", "coef").limit(0))


def test_rows_at_fault_are_found_through_the_bounds_they_set(spark):
    chain = [("a", ">=", 4, {"x": 1}), ("b", ">=", 0, {"y": 1, "x": -1}), ("c", ">=", 0, {"z": 1, "y": -1}), ("d", "<=", 3, {"z": 1}), ("e", "<=", 9, {"w": 1, "x": 1}), ("f", "=", 1, {"w": 1})]
    free = [(n, "I", 0.0, None) for n in "xyzw"]
    found = lambda rows, variables=free: sorted(r["row"] for r in milp.infeasible_rows(small_model(spark, variables, rows)).collect())
    assert found(chain) == ["a", "b", "c", "d"]
    assert found([r for r in chain if r[0] != "d"]) == []
    half = [("p", ">=", 1, {"x": 2}), ("q", "<=", 1, {"x": 2})]
    assert found(half) == ["p", "q"]  # 1/2 for a number that isn't whole
    assert found(half, [("x", "C", 0.0, None)]) == []
    assert found([("n", ">=", 2, {})], free) == ["n"]
    assert found(chain[:2], [("x", "I", 0.0, 3.0), *free[1:]]) == ["a"]


def test_a_variable_that_no_row_has_hides_no_conflict(spark):
    half = [("p", ">=", 1, {"x": 2}), ("q", "<=", 1, {"x": 2})]
    variables = [("x", "I", 0.0, None), ("u", "I", 3.0, 1.0)]
    assert sorted(r["row"] for r in milp.infeasible_rows(small_model(spark, variables, half)).collect()) == ["p", "q"]


def test_chromosomes_are_solved_apart_and_started_from_together(spark):
    i = tiny(spark, cn=((1, 1), (1, 1)), high=1)
    m = milp.presolved(i)
    found = milp.solve_tiny(m)
    values = spark.createDataFrame(list(found.items()), "name string, value double")
    whole = {r["name"]: r["value"] for r in milp.start_vector(milp.model(i), values.where("name <> 'flip|f1'")).collect()}
    assert whole.pop("flip|f1") == 0.0 and all(whole[k] == v for k, v in found.items() if k in whole)
    assert milp.by_chromosome(i.adjacencies).select("part").distinct().count() == 1 and milp.presolve_fp(0.1, 0.3) == 0.0


def test_a_small_model_is_solved_and_checked(spark):
    i = tiny(spark, cn=((1, 1), (1, 1)), high=1)
    m = milp.model(i)
    found = milp.solve_tiny(m)
    assert found is not None and sum(v for k, v in found.items() if k.startswith("delta")) == 0
    values = spark.createDataFrame(list(found.items()), "name string, value double")
    assert milp.violations(m, values).isEmpty()
    cn, acn = milp.solution_tensors(values)
    assert {r["cn"] for r in cn.collect()} == {1} and acn.agg(F.sum("cn")).first()[0] == 2
    broken = values.withColumn("value", F.when(F.col("name") == "cn|c|1:1-10|A", 3.0).otherwise(F.col("value")))
    assert not milp.violations(m, broken).isEmpty()
    edges = G.segment_edges(i.segments.join(cn, "sid"), "clone", "cn").unionByName(G.adjacency_edges(i.adjacencies.join(acn, "aid"), "clone", "cn"))
    assert G.balance_violations(edges.groupBy("u", "v", "kind", "clone").agg(F.sum("cn").alias("cn"))).isEmpty()


def test_streams_give_what_batches_give(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "value")
    path = str(tmp_path / "in")
    events.repartition(3).write.parquet(path)
    stream = ST.filtered(spark.readStream.schema(events.schema).parquet(path), F.col("value") > 50)
    q = stream.writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("kept").count() == events.where("value > 50").count()


NAMES = ("q_adj_canonical", "q_filter_region_both", "q_cut_scnt", "q_refine_fill", "q_reciprocal_merge", "q_cn_distance_inter", "q_align_two_samples", "q_node_imbalance", "q_components", "q_project_groups", "q_cna_fractions")


@pytest.mark.parametrize("name", NAMES)
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted((tuple(r) for r in cur.fetchall()), key=repr) == sorted((tuple(r) for r in out.select(*names).collect()), key=repr)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_optional_parts(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("lociflow.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("lociflow.llm", "corpus_pipeline"):
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    fresh = importlib.reload(entry)
    assert set(fresh.queries()) == set(QUERIES) and set(fresh.oracle_sql()) == set(SQL)
    monkeypatch.undo()
    importlib.reload(entry)


def _small(spark, groups=False):
    seg = spark.createDataFrame([(f"s{k}", "f", "1", 10 * k + 1, 10 * k + 10) for k in range(4)], "sid string, fid string, chr string, start long, end long")
    scnt = spark.createDataFrame([(f"s{k}", c, h, 1) for k in range(4) for c in ("c1", "c2") for h in "AB"], "sid string, clone string, hap string, cn long")
    ends = "aid string, chr1 string, coord1 long, strand1 string, chr2 string, coord2 long, strand2 string, at string"
    adj = spark.createDataFrame([("r1", "1", 10, "+", "1", 11, "-", "R"), ("a", "1", 10, "+", "1", 31, "-", "N"), ("b", "1", 11, "-", "1", 40, "+", "N"), ("d", "1", 10, "+", "1", 11, "-", "N")], ends)
    bounds = scnt.selectExpr("sid", "clone", "hap", "cn AS l", "cn + 1 AS u")
    held = spark.createDataFrame([("g", "M", 0.5, ["a", "b"], [0, 1]), ("h", "N", 0.5, ["a"], [0])], "gid string, agt string, fp double, aids array<string>, agl array<int>")
    return milp.Inputs(seg, scnt, bounds, adj, seg.selectExpr("chr", "start AS coord", "'-' AS strand").limit(1), held if groups else None)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clones_are_sent_to_the_adjacencies_and_found_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        i = _small(spark)
        plan = _plan(milp.variables(i))
        assert "CartesianProduct" not in plan and "BuildLeft" not in plan
        assert milp._clones(i).count() == 2 and i.clones is not None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_pairs_are_not_moved_once_made(spark):
    i = _small(spark)
    rows = {(r["row"], tuple(r["names"])) for r in milp.reciprocal_names(i).collect()}
    own = [("a", "b", 0, 0), ("a", "d", 0, 1), ("d", "b", 0, 0), ("d", "d", 0, 1)]
    names = lambda x, side, hap: {f"overall|{x}|{p}" for p in ("AA", "AB", "BA", "BB") if p[side] == hap}
    expected = {(f"side{k}|1:+10|1:-11|{x}|{y}|{s}|{t}", tuple(sorted(names(x, s, h) | names(y, t, o)))) for x, y, s, t in own for k, (h, o) in enumerate(("AB", "BA"))}
    assert rows == expected
    c, e = milp.reciprocal_rows(i)[0]
    assert c.count() == len(rows) and e.count() == sum(len(n) for _, n in rows)
    # Aggregates stand before the joins of the ends, none on the pairs.
    plan = _plan(c)
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_constraints_of_their_own_need_no_distinct(spark):
    i = _small(spark, groups=True)
    low = milp.labeling_rows(i)[1]
    assert "Aggregate" not in _plan(low[0]) and low[0].count() == 3 * 2 * 4
    assert all("Aggregate" not in _plan(milp.group_rows(i)[k][0]) for k in (0, 2))
    for parts in (milp.product_rows(i), milp.labeling_rows(i), milp.group_rows(i), milp.bound_rows(i), milp.delta_rows(i)):
        for c, _ in parts:
            assert c.count() == c.distinct().count() == c.select("row").distinct().count()


def test_listed_rows_are_moved_once(spark):
    from lociflow.plans import model_queries
    from lociflow.plans.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    plan = _plan(model_queries._listed(v, milp.labeling_rows(_small(spark))))
    assert plan.count("Exchange hashpartitioning(row") == 1


def test_product_rows_stay_where_they_are_made(spark):
    """An adjacency is moved once; its 32 rows are not."""
    from lociflow.plans.queries import QUERIES

    store = spark._jsc.sc().statusStore()

    def sent():
        executors = store.executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    start = sent()
    found = QUERIES["q_milp_product_rows"](spark, "/root/testdata/sf0.001").where("rows is not null").count()
    assert found > 30_000 and sent() - start < 64 * found
