"""The run-analytics star schema, read from the order tables.

Each view exists twice: as a DataFrame and as SQL for the oracle (to be put after WITH).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.registry import table


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of a run: result_id, run_id, nct_id, status, elapsed, ts."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("result_id"), F.concat(F.lit("run"), F.year("o_orderdate").cast("string")).alias("run_id"), (F.col("o_custkey") % 400).alias("nct_id"),
        F.when(F.col("o_orderstatus") == "P", "error").otherwise("pass").alias("status"), F.col("o_totalprice").alias("elapsed"), F.col("o_orderdate").alias("ts"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per header and candidate section: result_id, title, code, boosted, similarity, tier, auto_mapped, pos."""
    item = table(spark, sf_dir, "lineitem")
    boosted = (100 - F.round(F.col("l_discount") * 600).cast("long")) / 100.0
    return item.select(
        F.col("l_orderkey").alias("result_id"), F.concat(F.lit("T"), (F.col("l_partkey") % 40).cast("string")).alias("title"), F.concat(F.lit("B."), (F.col("l_suppkey") % 16 + 1).cast("string")).alias("code"),
        boosted.alias("boosted"), F.col("l_quantity").alias("span"), (F.col("l_returnflag") == "A").alias("auto_mapped"), F.col("l_partkey").alias("pos"), F.col("l_suppkey").alias("candidate"), F.col("l_linenumber").alias("line"),
    )


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per answered query: result_id, query_id, code, confidence, method, content."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.col("l_orderkey").alias("result_id"), (F.col("l_partkey") % 63).alias("query_id"), F.concat(F.lit("B."), (F.col("l_suppkey") % 16 + 1).cast("string")).alias("code"),
        ((100 - F.round(F.col("l_tax") * 700).cast("long")) / 100.0).alias("confidence"), F.col("l_returnflag").alias("method"), F.concat(F.lit("answer "), (F.col("l_partkey") % 50).cast("string")).alias("content"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original and extracted text of a section: result_id, code, confidence (some null), quality, original, extracted."""
    item = table(spark, sf_dir, "lineitem")
    quality = F.element_at(F.array(*map(F.lit, ("good", "partial", "poor", "gap", "missing"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return item.select(
        F.col("l_orderkey").alias("result_id"), F.concat(F.lit("B."), (F.col("l_suppkey") % 16 + 1).cast("string")).alias("code"), F.when(F.col("l_partkey") % 7 != 0, (100 - F.round(F.col("l_discount") * 600).cast("long")) / 100.0).alias("confidence"),
        quality.alias("quality"), F.col("l_linenumber").alias("line"), F.when(F.col("l_partkey") % 5 == 3, "").otherwise(F.concat(F.lit("text "), F.col("l_partkey").cast("string"))).alias("extracted"), F.col("l_partkey").alias("pos"),
    )


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per result: result_id, total, populated, average, answered, queries."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("result_id"), F.when(F.col("o_orderkey") % 50 == 0, 0).otherwise(16).alias("total"), (F.col("o_orderkey") % 17).alias("populated"), ((F.col("o_custkey") % 101) / 100.0).alias("average"), (F.col("o_custkey") % 64).alias("answered"), F.lit(63).alias("queries"))


RESULTS = "pr AS (SELECT o_orderkey AS result_id, 'run' || CAST(year(o_orderdate) AS VARCHAR) AS run_id, o_custkey % 400 AS nct_id, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'pass' END AS status, o_totalprice AS elapsed, o_orderdate AS ts FROM orders)"
MATCHES = "sm AS (SELECT l_orderkey AS result_id, 'T' || CAST(l_partkey % 40 AS VARCHAR) AS title, 'B.' || CAST(l_suppkey % 16 + 1 AS VARCHAR) AS code, (100 - CAST(round(l_discount * 600) AS BIGINT)) / 100.0 AS boosted, l_quantity AS span, l_returnflag = 'A' AS auto_mapped, l_partkey AS pos, l_suppkey AS candidate, l_linenumber AS line FROM lineitem)"
EXTRACTIONS = "qe AS (SELECT l_orderkey AS result_id, l_partkey % 63 AS query_id, 'B.' || CAST(l_suppkey % 16 + 1 AS VARCHAR) AS code, (100 - CAST(round(l_tax * 700) AS BIGINT)) / 100.0 AS confidence, l_returnflag AS method, 'answer ' || CAST(l_partkey % 50 AS VARCHAR) AS content FROM lineitem)"
PAIRS = "cp AS (SELECT l_orderkey AS result_id, 'B.' || CAST(l_suppkey % 16 + 1 AS VARCHAR) AS code, CASE WHEN l_partkey % 7 <> 0 THEN (100 - CAST(round(l_discount * 600) AS BIGINT)) / 100.0 END AS confidence, (['good', 'partial', 'poor', 'gap', 'missing'])[l_partkey % 5 + 1] AS quality, l_linenumber AS line, CASE WHEN l_partkey % 5 = 3 THEN '' ELSE 'text ' || CAST(l_partkey AS VARCHAR) END AS extracted, l_partkey AS pos FROM lineitem)"
COVERAGE = "cr AS (SELECT o_orderkey AS result_id, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 16 END AS total, o_orderkey % 17 AS populated, (o_custkey % 101) / 100.0 AS average, o_custkey % 64 AS answered, 63 AS queries FROM orders)"


def with_(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "
