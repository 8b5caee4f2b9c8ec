"""Corpus analytics: statistics of matches, gaps, coverage, regressions and comparisons between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task groups at most, where hardly two of them are alike.
TASK_ROWS = 500_000


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0.0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(0.0)).otherwise(a / b)


def share(condition: Column) -> Column:
    """Rows of a group that meet a condition, as a long."""
    return F.count(F.when(condition, 1))


def section_stats(results: DataFrame, matches: DataFrame) -> DataFrame:
    """Per section: distinct documents, average, least and greatest score, automatic mappings, and their rates.

    The hit rate divides by the distinct documents that passed; the automatic rate may exceed 1.
    """
    total = results.where("status = 'pass'").agg(F.count_distinct("nct_id").alias("total"))
    rows = matches.join(results.select("result_id", "nct_id"), "result_id")
    stats = rows.groupBy("code").agg(F.count_distinct("nct_id").alias("documents"), F.avg("boosted").alias("avg_boosted"), F.min("boosted").alias("min_boosted"), F.max("boosted").alias("max_boosted"), share(F.col("auto_mapped")).alias("auto_mapped"))
    # one row, so its broadcast is of fixed size
    return stats.crossJoin(F.broadcast(total)).select("code", "documents", "avg_boosted", "min_boosted", "max_boosted", "auto_mapped", ratio(F.col("documents"), F.col("total")).alias("hit_rate"), ratio(F.col("auto_mapped"), F.col("documents")).alias("auto_rate"))


def low_confidence(results: DataFrame, matches: DataFrame, below: float = 0.6, by: tuple[str, ...] = ("code",)) -> DataFrame:
    """Groups whose average is below a threshold, worst first; rows are counted, not documents."""
    rows = matches.join(results.select("result_id", "nct_id"), "result_id")
    return rows.groupBy(*by).agg(F.avg("boosted").alias("avg_boosted"), F.count("*").alias("protocol_count")).where(F.col("avg_boosted") < below).orderBy("avg_boosted", *by)


def pattern_counts(matches: DataFrame, least: int = 2) -> DataFrame:
    """How often a header got a section, where often enough."""
    return matches.groupBy("title", "code").agg(F.count("*").alias("n"), F.avg("boosted").alias("avg_boosted")).where(F.col("n") >= least)


def confusion_matrix(matches: DataFrame) -> DataFrame:
    """Header and section counts of headers with more than one section."""
    counts = matches.groupBy("title", "code").agg(F.count("*").alias("n"))
    return counts.withColumn("codes", F.count("*").over(Window.partitionBy("title"))).where("codes > 1")


def header_vocabulary(matches: DataFrame, top: int = 3, bottom: int = 2) -> DataFrame:
    """The most frequent headers of each section, and the least frequent where there are more than `top`."""
    counts = matches.groupBy("code", "title").agg(F.count("*").alias("n"))
    of = Window.partitionBy("code")
    ranked = counts.select("*", F.row_number().over(of.orderBy(F.desc("n"), "title")).alias("up"), F.row_number().over(of.orderBy("n", F.desc("title"))).alias("down"), F.count("*").over(of).alias("size"))
    first = ranked.where(F.col("up") <= top).select("code", F.lit("top").alias("kind"), "title", "n")
    return first.unionByName(ranked.where((F.col("size") > top) & (F.col("down") <= bottom)).select("code", F.lit("bottom").alias("kind"), "title", "n"))


def confused_with(matches: DataFrame) -> DataFrame:
    """Pairs of sections that one header of one document got both of, by count."""
    a = matches.select("result_id", "title", F.col("code").alias("code_a"))
    b = matches.select("result_id", "title", F.col("code").alias("code_b"))
    return a.join(b, ["result_id", "title"]).where("code_a <> code_b").groupBy("code_a", "code_b").agg(F.count("*").alias("n"))


def deep_dive(results: DataFrame, matches: DataFrame, code: str, worst: int = 5) -> DataFrame:
    """One section's statistics, headers, weakest documents and confusions, as rows of (part, item, value)."""
    own = matches.where(F.col("code") == code).join(results.select("result_id", "nct_id"), "result_id")
    stats = own.agg(F.count_distinct("nct_id").cast("double").alias("documents"), F.avg("boosted").alias("avg"), F.min("boosted").alias("min"), F.max("boosted").alias("max"))
    stats = stats.select(F.expr("stack(4, 'documents', documents, 'avg', avg, 'min', min, 'max', max) AS (item, value)")).select(F.lit("stats").alias("part"), "item", "value")
    heads = own.groupBy("title").agg(F.count("*").cast("double").alias("value")).select(F.lit("header").alias("part"), F.col("title").alias("item"), "value")
    low = own.groupBy("nct_id").agg(F.min("boosted").alias("value")).orderBy("value", "nct_id").limit(worst).select(F.lit("worst").alias("part"), F.col("nct_id").cast("string").alias("item"), "value")
    mixed = confused_with(matches.join(own.select("result_id", "title").distinct(), ["result_id", "title"], "left_semi")).where(F.col("code_a") == code).select(F.lit("confused").alias("part"), F.col("code_b").alias("item"), F.col("n").cast("double").alias("value"))
    return stats.unionByName(heads).unionByName(low).unionByName(mixed)


def gap_summary(pairs: DataFrame) -> DataFrame:
    """Counts of gaps, missing and poor texts by section."""
    return pairs.where(F.col("quality").isin("gap", "missing", "poor")).groupBy("code", "quality").agg(F.count("*").alias("n"))


def coverage_histogram(coverage: DataFrame) -> DataFrame:
    """Documents by percentage of populated sections: [0,25), [25,50), [50,75), 75 and more."""
    pct = F.col("populated") / F.when(F.col("total") == 0, 1).otherwise(F.col("total")) * 100
    bucket = F.when(pct < 25, "0-25").when(pct < 50, "25-50").when(pct < 75, "50-75").otherwise("75-100")
    return coverage.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(pct).alias("avg_pct"), F.avg("average").alias("avg_confidence"))


def run_overview(results: DataFrame, matches: DataFrame, n: int = 3) -> DataFrame:
    """Per run: documents, pass rate, and its n worst and n best sections by average."""
    runs = results.groupBy("run_id").agg(F.count("*").alias("documents"), share(F.col("status") == "pass").alias("passed"))
    runs = runs.withColumn("pass_rate", F.col("passed") / F.greatest("documents", F.lit(1)))
    avg = matches.join(results.select("result_id", "run_id"), "result_id").groupBy("run_id", "code").agg(F.avg("boosted").alias("avg_boosted"))
    of = Window.partitionBy("run_id")
    ranked = avg.select("*", F.row_number().over(of.orderBy("avg_boosted", "code")).alias("low"), F.row_number().over(of.orderBy(F.desc("avg_boosted"), "code")).alias("high"))
    lists = ranked.groupBy("run_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("low") <= n, F.struct("low", "code")))), lambda s: s["code"]), ",").alias("worst"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("high") <= n, F.struct("high", "code")))), lambda s: s["code"]), ",").alias("best")
    )
    return runs.join(lists, "run_id", "left")


def run_deltas(results: DataFrame, matches: DataFrame, before: str, after: str, flat: float = 0.01) -> DataFrame:
    """Sections of two runs side by side; a missing side is 0. Improved or regressed beyond `flat`."""
    avg = matches.join(results.select("result_id", "run_id"), "result_id").groupBy("run_id", "code").agg(F.avg("boosted").alias("avg"), F.count("*").alias("n"))
    side = lambda run, s: avg.where(F.col("run_id") == run).select("code", F.col("avg").alias(f"avg_{s}"), F.col("n").alias(f"n_{s}"))
    both = side(before, "a").join(side(after, "b"), "code", "full_outer")
    both = both.select("code", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("avg_a", "n_a", "avg_b", "n_b"))).withColumn("delta", F.col("avg_b") - F.col("avg_a"))
    return both.withColumn("verdict", F.when(F.col("delta") > flat, "improved").when(F.col("delta") < -flat, "regressed").otherwise("unchanged"))


def regressions(deltas: DataFrame, warning: float = 0.02, critical: float = 0.10) -> DataFrame:
    """Sections that fell, worst first."""
    return deltas.where(F.col("delta") < -warning).select("code", "delta", F.when(F.col("delta") < -critical, "critical").otherwise("warning").alias("severity")).orderBy("delta", "code")


def best_match_of_pair(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Each pair with the best match of its section in its document; of equal scores the first header wins."""
    of = Window.partitionBy("result_id", "code").orderBy(F.desc("boosted"), "pos", "candidate", "line", "title")
    best = matches.withColumn("rank", F.row_number().over(of)).where("rank = 1").select("result_id", "code", F.col("boosted").alias("best_boosted"), F.col("title").alias("best_title"))
    return pairs.join(best, ["result_id", "code"], "left")


def filter_pairs(pairs: DataFrame, low: float | None = None, high: float | None = None, quality: str | None = None, code: str | None = None, populated: bool | None = None) -> DataFrame:
    """Chosen comparison pairs; an unknown confidence passes the range."""
    c = F.col("confidence")
    if low is not None:
        pairs = pairs.where(c.isNull() | (c >= low))
    if high is not None:
        pairs = pairs.where(c.isNull() | (c <= high))
    if quality is not None:
        pairs = pairs.where(F.col("quality") == quality)
    if code is not None:
        pairs = pairs.where(F.col("code") == code)
    if populated is not None:
        pairs = pairs.where((F.trim("extracted") != "") == F.lit(populated))
    return pairs


def coverage_report(sections: DataFrame, expected: DataFrame) -> DataFrame:
    """Per document: populated sections, gaps, average confidence and confidence bands. sections: result_id, code, confidence."""
    best = sections.groupBy("result_id", "code").agg(F.max("confidence").alias("confidence"))
    c = F.col("confidence")
    per = best.groupBy("result_id").agg(F.count("*").alias("populated"), F.avg(c).alias("average"), share(c >= 0.85).alias("high"), share((c >= 0.70) & (c < 0.85)).alias("medium"), share(c < 0.70).alias("low"), F.collect_set("code").alias("codes"))
    all_codes = expected.agg(F.array_sort(F.collect_set("code")).alias("expected"))
    gaps = F.array_except("expected", "codes")
    return per.crossJoin(F.broadcast(all_codes)).select("result_id", "populated", "average", "high", "medium", "low", F.size(gaps).cast("long").alias("gap_count"), F.array_join(gaps, ",").alias("gaps"))


def best_per_group(rows: DataFrame, by: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row with the greatest score of each group; ties go to the first in the given order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties))).where("rank = 1").drop("rank")


def quality_verdict(coverage: DataFrame) -> DataFrame:
    """PASS from 75 % coverage and 0.70 confidence, REVIEW from 50 %, else FAIL."""
    pct = F.col("populated") / F.when(F.col("total") == 0, 1).otherwise(F.col("total"))
    return coverage.select("result_id", pct.alias("coverage"), F.when((pct >= 0.75) & (F.col("average") >= 0.70), "PASS").when(pct >= 0.5, "REVIEW").otherwise("FAIL").alias("verdict"))


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median, least, greatest and the p95 that takes the sorted value at min(int(.95 n), n - 1)."""
    of = Window.partitionBy(by)
    ranked = rows.select(by, value, F.row_number().over(of.orderBy(value)).alias("rank"), F.count("*").over(of).alias("n"))
    at = F.least(F.floor(F.col("n") * 0.95).cast("long"), F.col("n") - 1) + 1
    return ranked.groupBy(by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(F.when(F.col("rank") == at, F.col(value))).alias("p95"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def duplicate_answers(extractions: DataFrame, least: int = 5) -> DataFrame:
    """Per document: methods used, and answers longer than `least` characters given to several queries."""
    rows = extractions.where(F.length("content") > least).select("result_id", "content", "query_id")
    # dealt by counted rows before anything is grouped: hardly a row is like another, so a task would hold all of its input as groups
    dealt = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS)), "result_id", "content")
    texts = dealt.groupBy("result_id", "content").agg(F.count_distinct("query_id").alias("queries")).where("queries > 1")
    return texts.groupBy("result_id").agg(F.count("*").alias("duplicated"), F.sum("queries").alias("queries"))


def calibration(rows: DataFrame, predicted: str, correct: str) -> DataFrame:
    """Bands of width 0.1, closed below: a prediction of 1.0 is in none. Bias is predicted minus correct."""
    band = F.floor(F.round(F.col(predicted) * 1000) / 100).cast("long")
    return rows.where(F.col(predicted) < 1).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(predicted).alias("avg_predicted"), F.avg(F.col(correct).cast("double")).alias("accuracy")).withColumn("bias", F.col("avg_predicted") - F.col("accuracy"))


def calibration_adjustment(bands: DataFrame, least: int = 5) -> DataFrame:
    """The mean bias of bands with enough rows."""
    return bands.where(F.col("n") >= least).agg(F.coalesce(F.avg("bias"), F.lit(0.0)).alias("adjustment"), F.count("*").alias("bands"))


def metric_regressions(a: DataFrame, b: DataFrame, key: str, metrics: dict[str, float]) -> DataFrame:
    """Per key in both runs and metric: the relative drop, and whether it passes the metric's threshold."""
    both = a.select(key, *(F.col(m).alias(f"{m}_a") for m in metrics)).join(b.select(key, *(F.col(m).alias(f"{m}_b") for m in metrics)), key)
    parts = ", ".join(f"'{m}', CAST({m}_a AS DOUBLE), CAST({m}_b AS DOUBLE), {t}D" for m, t in metrics.items())
    rows = both.select(key, F.expr(f"stack({len(metrics)}, {parts}) AS (metric, before, after, threshold)"))
    drop = F.when(F.col("before") == 0, 0.0).otherwise((F.col("before") - F.col("after")) / F.col("before"))
    return rows.select(key, "metric", "before", "after", drop.alias("drop"), (drop > F.col("threshold")).alias("regressed"))


def trend(rows: DataFrame, ts: str, correct: str) -> DataFrame:
    """Accuracy by month, latest first."""
    return rows.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy")).orderBy(F.desc("month"))


def mostly(rows: DataFrame, checks: dict[str, Column], threshold: float) -> DataFrame:
    """One pass over a table: the fraction of rows that meets each check (null: not counted), and whether it suffices."""
    names = list(checks)
    one = rows.agg(*(F.coalesce(F.avg(c.cast("double")), F.lit(1.0)).alias(n) for n, c in checks.items()))
    parts = ", ".join(f"'{n}', `{n}`" for n in names)
    return one.select(F.expr(f"stack({len(names)}, {parts}) AS (expectation, fraction)")).withColumn("ok", F.col("fraction") >= threshold)
