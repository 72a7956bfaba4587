"""Segments, adjacencies, copy numbers and groups derived from the test tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: In order: a view may use those before it. Braces stand for tables and views.
VIEWS = {
    "adj_raw": """SELECT 'o' || CAST(o_orderkey AS STRING) AS aid, CAST(o_orderkey AS BIGINT) AS k,
        1 + o_custkey % 22 AS c1, CASE WHEN o_orderkey % 6 = 0 THEN 1 + (o_custkey * 7 + 3) % 22 ELSE 1 + o_custkey % 22 END AS c2,
        1 + (CAST(o_orderkey AS BIGINT) * 7919 + CAST(o_custkey AS BIGINT) * 104729) % 1000000 AS x1,
        1 + (CAST(o_orderkey AS BIGINT) * 15485 + CAST(o_custkey AS BIGINT) * 32452) % 1000000 AS x2,
        CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS s1, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS s2
        FROM {orders}""",
    "adj_ends": """SELECT *, c1 < c2 OR (c1 = c2 AND (x1 < x2 OR (x1 = x2 AND s1 <= s2))) AS fine FROM {adj_raw}""",
    "adj": """SELECT aid, k, CAST(CASE WHEN fine THEN c1 ELSE c2 END AS STRING) AS chr1, CASE WHEN fine THEN x1 ELSE x2 END AS coord1,
        CASE WHEN (CASE WHEN fine THEN s1 ELSE s2 END) = 1 THEN '+' ELSE '-' END AS strand1,
        CAST(CASE WHEN fine THEN c2 ELSE c1 END AS STRING) AS chr2, CASE WHEN fine THEN x2 ELSE x1 END AS coord2,
        CASE WHEN (CASE WHEN fine THEN s2 ELSE s1 END) = 1 THEN '+' ELSE '-' END AS strand2, 'N' AS at,
        CASE k % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'b' WHEN 2 THEN 'a,c' ELSE 'c' END AS sources
        FROM {adj_ends}""",
    "breakend": """SELECT aid, 0 AS side, chr1 AS chr, coord1 AS coord, strand1 AS strand FROM {adj}
        UNION ALL SELECT aid, 1, chr2, coord2, strand2 FROM {adj}""",
    "seg_n": """SELECT n1.n_nationkey + 1 AS c, n2.n_nationkey * 5 + r.r_regionkey AS i, (n1.n_nationkey + n2.n_nationkey + r.r_regionkey) % 7 AS g
        FROM {nation} n1 CROSS JOIN {nation} n2 CROSS JOIN {region} r WHERE n1.n_nationkey < 22""",
    "seg_k": """SELECT c, i, CAST(c AS STRING) AS chr, CAST(i * 8000 + 1 AS BIGINT) AS start, CAST(i * 8000 + 8000 - CASE WHEN g = 0 THEN 500 ELSE 0 END AS BIGINT) AS "end"
        FROM {seg_n}""",
    "seg": """SELECT chr || ':' || CAST(start AS STRING) || '-' || CAST("end" AS STRING) AS sid, chr, start, "end", c, i FROM {seg_k}""",
    "scnt": """SELECT sid, 'c1' AS clone, 'A' AS hap, CAST((c + CAST(floor(i / 3.0) AS BIGINT)) % 4 AS BIGINT) AS cn FROM {seg}
        UNION ALL SELECT sid, 'c2', 'A', CAST((c + CAST(floor(i / 3.0) AS BIGINT)) % 4 AS BIGINT) FROM {seg}
        UNION ALL SELECT sid, 'c1', 'B', CAST((c * 2 + CAST(floor(i / 4.0) AS BIGINT) + 1) % 3 AS BIGINT) FROM {seg}
        UNION ALL SELECT sid, 'c2', 'B', CAST((c * 2 + CAST(floor(i / 4.0) AS BIGINT) + 2) % 3 AS BIGINT) FROM {seg}""",
    "scnt2": """SELECT sid, clone, hap, CASE WHEN clone = 'c1' THEN (cn + 1) % 4 ELSE cn END AS cn FROM {scnt}""",
    "ph": """SELECT 0 AS ix, 'AA' AS phasing UNION ALL SELECT 1, 'AB' UNION ALL SELECT 2, 'BA' UNION ALL SELECT 3, 'BB'""",
    "cl": """SELECT 1 AS kk, 'c1' AS clone UNION ALL SELECT 2, 'c2'""",
    "acnt": """SELECT a.aid, cl.clone, p.phasing, CASE WHEN p.ix = a.k % 4 THEN (a.k + cl.kk) % 3 ELSE 0 END AS cn
        FROM {adj} a CROSS JOIN {cl} cl CROSS JOIN {ph} p""",
    "support": """SELECT DISTINCT 'r' || CAST(l_partkey AS STRING) AS read, 'o' || CAST(o_orderkey AS STRING) AS aid, l_partkey, o_orderkey
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "member": """SELECT 'g' || CAST(l_partkey AS STRING) AS gid, CASE l_partkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'N' ELSE 'L' END AS agt,
        (l_partkey % 5) / 10.0 AS fp, aid, CAST(o_orderkey % 2 AS INT) AS side,
        row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderkey) - 1 AS pos FROM {support}""",
    "regions": """SELECT 'g' || CAST(n_nationkey AS STRING) AS rid, CAST(n_nationkey + 1 AS STRING) AS chr, CAST(100001 + n_regionkey * 50000 AS BIGINT) AS start,
        CAST(300000 + n_regionkey * 50000 AS BIGINT) AS "end" FROM {nation} WHERE n_nationkey < 22""",
    "seg2_k": """SELECT CAST(n1.n_nationkey + 1 AS STRING) AS chr, n2.n_nationkey * 4 + r.r_regionkey AS i, n1.n_nationkey AS nk
        FROM {nation} n1 CROSS JOIN {nation} n2 CROSS JOIN {region} r WHERE n1.n_nationkey < 22 AND r.r_regionkey < 4""",
    "seg2": """SELECT chr || ':' || CAST(i * 10000 + 1 AS STRING) || '-' || CAST(i * 10000 + 10000 AS STRING) AS sid, chr,
        CAST(i * 10000 + 1 AS BIGINT) AS start, CAST(i * 10000 + 10000 AS BIGINT) AS "end", i, nk FROM {seg2_k}""",
    "scnt2b": """SELECT sid, 'c1' AS clone, 'A' AS hap, CAST((i + nk) % 3 AS BIGINT) AS cn FROM {seg2}
        UNION ALL SELECT sid, 'c1', 'B', CAST((i + 2 * nk) % 2 AS BIGINT) FROM {seg2}""",
}


def sql(query: str) -> str:
    """The query for DuckDB, with the views it may name before it."""
    names = {x: x for x in (*VIEWS, *TABLES)}
    views = ",\n".join(f"{k} AS ({v.format(**names)})" for k, v in VIEWS.items())
    return f"WITH RECURSIVE {views}\n{query.strip()}" if not query.strip().upper().startswith("WITH ") else f"WITH RECURSIVE {views},\n{query.strip()[5:].removeprefix('RECURSIVE ').lstrip()}"


class Views:
    """The views as DataFrames, each made when asked for. A ``_rows`` group table has arrays."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                text = VIEWS[name].replace('"end"', "`end`")
                used = [x for x in (*VIEWS, *TABLES) if "{" + x + "}" in text]
                self.made[name] = self.spark.sql(text, **{x: getattr(self, x) for x in used})
            elif name in TABLES:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self.made[name]

    def groups(self) -> DataFrame:
        from pyspark.sql import functions as F

        rows = self.member.groupBy("gid", "agt", "fp").agg(F.array_sort(F.collect_list(F.struct("pos", "aid", "side"))).alias("m"))
        return rows.select("gid", "agt", F.col("fp").cast("double").alias("fp"), F.transform("m", lambda x: x["aid"]).alias("aids"), F.transform("m", lambda x: x["side"]).alias("agl"))
