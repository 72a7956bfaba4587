"""The scalar functions of the data model, and the windows of a segment, as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, type of the result, expression.
FUNCTIONS = (
    ("strip_chr", "name STRING", "STRING", "regexp_replace(name, '^chr', '')"),
    ("sid", "chr STRING, begin BIGINT, last BIGINT", "STRING", "concat(chr, ':', begin, '-', last)"),
    ("pid", "chr STRING, coord BIGINT, strand STRING", "STRING", "concat(chr, ':', strand, coord)"),
    ("reciprocal", "coord BIGINT, strand STRING", "BIGINT", "CASE WHEN strand = '+' THEN coord + 1 ELSE coord - 1 END"),
    ("flipped_strand", "strand STRING", "STRING", "CASE WHEN strand = '+' THEN '-' ELSE '+' END"),
    ("phasing_flip", "phasing STRING", "STRING", "reverse(phasing)"),
    ("adjacency_distance", "chr1 STRING, coord1 BIGINT, chr2 STRING, coord2 BIGINT", "BIGINT", "CASE WHEN chr1 = chr2 THEN abs(coord1 - coord2) ELSE -1 END"),
    ("chr_rank", "name STRING", "STRUCT<n: INT, chr: STRING>", "named_struct('n', length(name), 'chr', name)"),
)
TABLES = (
    ("segment_windows", "chr STRING, begin BIGINT, last BIGINT, width BIGINT", "chr STRING, n BIGINT, begin BIGINT, last BIGINT",
     "SELECT chr, k, greatest(begin, k * width + 1), least(last, (k + 1) * width) FROM (SELECT explode(sequence((begin - 1) div width, (last - 1) div width)) AS k)"),
)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, as temporary ones; again is no error."""
    for name, given, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {body}")
    for name, given, result, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE ({result}) RETURN {body}")
