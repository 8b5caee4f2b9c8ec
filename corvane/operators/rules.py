"""Validation rules over tabulation datasets and visit schedules. Findings are rows; an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch_rules(visits: DataFrame, study: str, kind: str, day: str, most_days: int) -> DataFrame:
    """Per study: screening after treatment, follow-up before its end, and a span beyond `most_days`. Null where an epoch is absent."""
    at = lambda f, k: f(F.when(F.col(kind) == k, F.col(day)))
    return visits.groupBy(study).agg(
        (at(F.max, "screening") >= at(F.min, "treatment")).alias("screening_late"), (at(F.min, "followup") <= at(F.max, "treatment")).alias("followup_early"), ((F.max(day) - F.min(day)) > most_days).alias("too_long")
    )


def counted(rows: DataFrame, domain: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """One pass over a domain: for each rule (severity, bad rows) the number of bad rows, where there are any."""
    one = rows.agg(*(F.count(F.when(bad, 1)).alias(r) for r, (_, bad) in rules.items()))
    parts = ", ".join(f"'{r}', '{s}', `{r}`" for r, (s, _) in rules.items())
    return one.select(F.lit(domain).alias("domain"), F.expr(f"stack({len(rules)}, {parts}) AS (rule, severity, n)")).where("n > 0")


def standard_rules(domain: str, required: list[str], lengths: dict[str, int]) -> dict[str, tuple[str, Column]]:
    """Rules that every domain has: required values, its own name, and the greatest lengths."""
    out = {f"{domain}-002-{v}": ("Error", F.col(v).isNull() | (F.trim(F.col(v).cast("string")) == "")) for v in required}
    out[f"{domain}-003"] = ("Error", F.col("DOMAIN") != domain)
    out[f"{domain}-004"] = ("Error", F.length("DOMAIN") > 2)
    out[f"{domain}-005"] = ("Error", F.length("STUDYID") > 20)
    return out | {f"{domain}-006-{v}": ("Warning", F.length(v) > n) for v, n in lengths.items()}


def duplicates(rows: DataFrame, domain: str, rule: str, key: list[str]) -> DataFrame:
    """A finding for keys that occur more than once."""
    again = rows.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1")
    return again.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(domain).alias("domain"), F.lit(rule).alias("rule"), F.lit("Error").alias("severity"), "n")


def all_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def severity_order(findings: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "Error", 0).when(F.col("severity") == "Warning", 1).otherwise(2)
    return findings.orderBy(rank, "domain", "rule")


def completeness(present: DataFrame, name: str, required: list[str]) -> DataFrame:
    """Each required parameter and whether the table has it (upper-case, trimmed)."""
    spark = present.sparkSession
    dim = spark.createDataFrame([(r,) for r in required], "parameter string")
    have = present.select(F.upper(F.trim(name)).alias("parameter")).distinct().withColumn("present", F.lit(True))
    # the required list is fixed and short
    return F.broadcast(dim).join(have, "parameter", "left").select("parameter", F.coalesce("present", F.lit(False)).alias("present"))


def summary(findings: DataFrame) -> DataFrame:
    """Findings by severity, and whether the whole is feasible (no error)."""
    return findings.groupBy("severity").agg(F.count("*").alias("rules"), F.sum("n").alias("n")).withColumn("feasible", F.max((F.col("severity") == "Error").cast("int")).over(Window.partitionBy()) == 0)


# Levels in order of preference, and what each needs.
EXTRACTION_LEVELS = [("E1", ["layout", "vision"]), ("E2", ["layout"]), ("E3", [])]
CLASSIFICATION_LEVELS = [("C1", ["model", "index", "language"]), ("C2", ["model", "language"]), ("C3", ["language"]), ("C4", ["model"]), ("C5", [])]


def best_level(levels: list[tuple[str, list[str]]], has: dict[str, Column], forced: Column | None = None) -> Column:
    """The forced level, or the first whose needs are all there."""
    out = F.lit(None).cast("string")
    for level, needs in reversed(levels):
        ok = F.lit(True)
        for need in needs:
            ok = ok & has[need]
        out = F.when(ok, level).otherwise(out)
    return out if forced is None else F.coalesce(forced, out)
