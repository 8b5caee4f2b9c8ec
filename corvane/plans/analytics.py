"""Run analytics over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import analytics as A
from corvane.plans import star
from corvane.plans.star import COVERAGE, EXTRACTIONS, MATCHES, PAIRS, RESULTS, with_
from corvane.registry import query, table


@query(with_(RESULTS, MATCHES) + """, t AS (SELECT count(DISTINCT nct_id) AS total FROM pr WHERE status = 'pass')
SELECT code, count(DISTINCT nct_id) AS documents, avg(boosted) AS avg_boosted, min(boosted) AS min_boosted, max(boosted) AS max_boosted, count(*) FILTER (auto_mapped) AS auto_mapped,
  count(DISTINCT nct_id) / (SELECT total FROM t) AS hit_rate, count(*) FILTER (auto_mapped) / count(DISTINCT nct_id) AS auto_rate FROM sm JOIN pr USING (result_id) GROUP BY code""")
def agg1_section_stats(spark, sf_dir):
    return A.section_stats(star.results(spark, sf_dir), star.matches(spark, sf_dir)).withColumn("avg_boosted", F.col("avg_boosted"))


@query(with_(RESULTS, MATCHES) + "SELECT title, code, avg(boosted) AS avg_boosted, count(*) AS protocol_count FROM sm JOIN pr USING (result_id) GROUP BY title, code HAVING avg(boosted) < 0.68")
def agg2_low_confidence(spark, sf_dir):
    return A.low_confidence(star.results(spark, sf_dir), star.matches(spark, sf_dir), 0.68, ("title", "code"))


@query(with_(MATCHES) + "SELECT title, code, count(*) AS n, avg(boosted) AS avg_boosted FROM sm GROUP BY title, code HAVING count(*) >= 60")
def agg3_misclassification_patterns(spark, sf_dir):
    return A.pattern_counts(star.matches(spark, sf_dir), 60)


@query(with_(MATCHES) + ", c AS (SELECT title, code, count(*) AS n FROM sm GROUP BY title, code), d AS (SELECT *, count(*) OVER (PARTITION BY title) AS codes FROM c) SELECT * FROM d WHERE codes > 1")
def agg4_confusion_matrix(spark, sf_dir):
    return A.confusion_matrix(star.matches(spark, sf_dir))


@query(with_(MATCHES) + """, c AS (SELECT code, title, count(*) AS n FROM sm GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, title) AS up, row_number() OVER (PARTITION BY code ORDER BY n, title DESC) AS down, count(*) OVER (PARTITION BY code) AS size FROM c)
SELECT code, 'top' AS kind, title, n FROM r WHERE up <= 3 UNION ALL SELECT code, 'bottom', title, n FROM r WHERE size > 3 AND down <= 2""")
def agg5_header_vocabulary(spark, sf_dir):
    return A.header_vocabulary(star.matches(spark, sf_dir))


@query(with_(RESULTS, MATCHES) + """, own AS (SELECT * FROM sm JOIN pr USING (result_id) WHERE code = 'B.4'),
w AS (SELECT nct_id, min(boosted) AS v FROM own GROUP BY 1 ORDER BY v, nct_id LIMIT 5)
SELECT 'stats' AS part, 'documents' AS item, CAST(count(DISTINCT nct_id) AS DOUBLE) AS value FROM own UNION ALL SELECT 'stats', 'avg', avg(boosted) FROM own UNION ALL SELECT 'stats', 'min', min(boosted) FROM own UNION ALL SELECT 'stats', 'max', max(boosted) FROM own
UNION ALL SELECT 'header', title, CAST(count(*) AS DOUBLE) FROM own GROUP BY title UNION ALL SELECT 'worst', CAST(nct_id AS VARCHAR), v FROM w
UNION ALL SELECT 'confused', b.code, CAST(count(*) AS DOUBLE) FROM sm a JOIN sm b ON a.result_id = b.result_id AND a.title = b.title AND a.code <> b.code WHERE a.code = 'B.4' GROUP BY b.code""")
def agg6_section_deep_dive(spark, sf_dir):
    return A.deep_dive(star.results(spark, sf_dir), star.matches(spark, sf_dir), "B.4")


@query(with_(PAIRS) + "SELECT code, quality, count(*) AS n FROM cp WHERE quality IN ('gap', 'missing', 'poor') GROUP BY ALL")
def agg7_gap_summary(spark, sf_dir):
    return A.gap_summary(star.pairs(spark, sf_dir))


@query(with_(COVERAGE) + """, p AS (SELECT *, populated / (CASE WHEN total = 0 THEN 1 ELSE total END) * 100 AS pct FROM cr)
SELECT CASE WHEN pct < 25 THEN '0-25' WHEN pct < 50 THEN '25-50' WHEN pct < 75 THEN '50-75' ELSE '75-100' END AS bucket, count(*) AS n, avg(pct) AS avg_pct, avg(average) AS avg_confidence FROM p GROUP BY 1""")
def agg8_coverage_histogram(spark, sf_dir):
    return A.coverage_histogram(star.coverage(spark, sf_dir))


@query(with_(RESULTS, MATCHES) + """, a AS (SELECT run_id, code, avg(boosted) AS v FROM sm JOIN pr USING (result_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY v, code) AS low, row_number() OVER (PARTITION BY run_id ORDER BY v DESC, code) AS high FROM a),
l AS (SELECT run_id, string_agg(code, ',' ORDER BY low) FILTER (low <= 3) AS worst, string_agg(code, ',' ORDER BY high) FILTER (high <= 3) AS best FROM r GROUP BY 1)
SELECT run_id, count(*) AS documents, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'pass') / count(*) AS pass_rate, any_value(worst) AS worst, any_value(best) AS best FROM pr LEFT JOIN l USING (run_id) GROUP BY run_id""")
def agg9_run_overview(spark, sf_dir):
    return A.run_overview(star.results(spark, sf_dir), star.matches(spark, sf_dir))


_DELTAS = with_(RESULTS, MATCHES) + """, a AS (SELECT run_id, code, avg(boosted) AS v, count(*) AS n FROM sm JOIN pr USING (result_id) GROUP BY ALL), y AS (SELECT min(run_id) AS lo, max(run_id) AS hi FROM pr),
d AS (SELECT code, coalesce(x.v, 0) AS avg_a, coalesce(x.n, 0) AS n_a, coalesce(z.v, 0) AS avg_b, coalesce(z.n, 0) AS n_b, coalesce(z.v, 0) - coalesce(x.v, 0) AS delta
  FROM (SELECT code, v, n FROM a WHERE run_id = 'run1995') x FULL JOIN (SELECT code, v, n FROM a WHERE run_id = 'run1996') z USING (code)) """


@query(_DELTAS + "SELECT *, CASE WHEN delta > 0.001 THEN 'improved' WHEN delta < -0.001 THEN 'regressed' ELSE 'unchanged' END AS verdict FROM d")
def jn7_run_comparison(spark, sf_dir):
    return A.run_deltas(star.results(spark, sf_dir), star.matches(spark, sf_dir), "run1995", "run1996", 0.001)


@query(_DELTAS + "SELECT code, delta, CASE WHEN delta < -0.006 THEN 'critical' ELSE 'warning' END AS severity FROM d WHERE delta < -0.001")
def agg10_regressions(spark, sf_dir):
    return A.regressions(A.run_deltas(star.results(spark, sf_dir), star.matches(spark, sf_dir), "run1995", "run1996"), 0.001, 0.006)


@query(with_(MATCHES) + "SELECT a.code AS code_a, b.code AS code_b, count(*) AS n FROM sm a JOIN sm b ON a.result_id = b.result_id AND a.title = b.title AND a.code <> b.code GROUP BY ALL")
def jn5_confused_with(spark, sf_dir):
    return A.confused_with(star.matches(spark, sf_dir))


@query(with_(PAIRS, MATCHES) + """, b AS (SELECT *, row_number() OVER (PARTITION BY result_id, code ORDER BY boosted DESC, pos, candidate, line, title) AS k FROM sm)
SELECT cp.*, b.boosted AS best_boosted, b.title AS best_title FROM cp LEFT JOIN b ON b.result_id = cp.result_id AND b.code = cp.code AND k = 1""")
def jn6_best_match_of_pair(spark, sf_dir):
    return A.best_match_of_pair(star.pairs(spark, sf_dir), star.matches(spark, sf_dir))


@query(with_(RESULTS, EXTRACTIONS) + "SELECT pr.run_id, qe.method, count(*) AS answers, avg(confidence) AS avg_confidence FROM qe JOIN pr USING (result_id) GROUP BY ALL")
def jn3_children_of_results(spark, sf_dir):
    rows = star.extractions(spark, sf_dir).join(star.results(spark, sf_dir).select("result_id", "run_id"), "result_id")
    return rows.groupBy("run_id", "method").agg(F.count("*").alias("answers"), F.avg("confidence").alias("avg_confidence"))


@query("SELECT o_orderkey AS entry_id, o_orderpriority AS priority FROM orders ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') d ON l_orderkey = o_orderkey")
def jn4_pending_reviews(spark, sf_dir):
    decided = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("entry_id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderpriority").alias("priority")).join(decided, "entry_id", "left_anti")


@query(with_(PAIRS) + "SELECT * FROM cp WHERE (confidence IS NULL OR confidence BETWEEN 0.5 AND 0.9) AND quality IN ('poor') AND trim(extracted) <> ''")
def fil4_pair_filter(spark, sf_dir):
    return A.filter_pairs(star.pairs(spark, sf_dir), 0.5, 0.9, "poor", None, True)


@query(with_(MATCHES) + "SELECT code, avg(boosted) AS avg_boosted, count(*) AS n FROM sm GROUP BY 1 HAVING avg(boosted) < 0.701")
def fil19_uncovered_sections(spark, sf_dir):
    return star.matches(spark, sf_dir).groupBy("code").agg(F.avg("boosted").alias("avg_boosted"), F.count("*").alias("n")).where("avg_boosted < 0.701")


@query(with_(EXTRACTIONS) + """, b AS (SELECT result_id, code, max(confidence) AS c FROM qe GROUP BY ALL), x AS (SELECT array_agg(DISTINCT code ORDER BY code) AS codes FROM qe)
SELECT result_id, count(*) AS populated, avg(c) AS average, count(*) FILTER (c >= 0.85) AS high, count(*) FILTER (c >= 0.70 AND c < 0.85) AS medium, count(*) FILTER (c < 0.70) AS low,
 CAST(len(list_filter(any_value(x.codes), lambda k: NOT list_contains(list(code), k))) AS BIGINT) AS gap_count, array_to_string(list_filter(any_value(x.codes), lambda k: NOT list_contains(list(code), k)), ',') AS gaps FROM b, x GROUP BY result_id""")
def agg11_coverage_report(spark, sf_dir):
    e = star.extractions(spark, sf_dir)
    return A.coverage_report(e, e.select("code").distinct())


@query(with_(EXTRACTIONS) + """, d AS (SELECT *, row_number() OVER (PARTITION BY result_id, content ORDER BY query_id, code, confidence, method) AS k FROM qe),
b AS (SELECT result_id, code, content, confidence, row_number() OVER (PARTITION BY result_id, code ORDER BY confidence DESC, content) AS r, count(*) OVER (PARTITION BY result_id, code) AS hits FROM d WHERE k = 1)
SELECT result_id, code, content AS primary_content, confidence, hits FROM b WHERE r = 1""")
def agg12_assemble_classified(spark, sf_dir):
    from pyspark.sql import Window

    e = star.extractions(spark, sf_dir)
    first = e.withColumn("k", F.row_number().over(Window.partitionBy("result_id", "content").orderBy("query_id", "code", "confidence", "method"))).where("k = 1")
    first = first.withColumn("hits", F.count("*").over(Window.partitionBy("result_id", "code")))
    return A.best_per_group(first, ["result_id", "code"], "confidence", ["content"]).select("result_id", "code", F.col("content").alias("primary_content"), "confidence", "hits")


@query(with_(EXTRACTIONS) + "SELECT result_id, code, max(confidence) AS confidence, string_agg(content, chr(10) ORDER BY confidence DESC, content, query_id) AS merged FROM qe GROUP BY ALL")
def agg13_merge_by_section(spark, sf_dir):
    rows = star.extractions(spark, sf_dir).groupBy("result_id", "code").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "content", "query_id"))).alias("s"))
    return rows.select("result_id", "code", "confidence", F.array_join(F.transform("s", lambda s: s["content"]), "\n").alias("merged"))


@query(with_(EXTRACTIONS) + "SELECT result_id, code, max(confidence) AS confidence, string_agg(content, ' ' ORDER BY query_id, content) AS text FROM qe WHERE code <> 'B.16' GROUP BY ALL")
def agg14_window_prediction_merge(spark, sf_dir):
    rows = star.extractions(spark, sf_dir).where("code <> 'B.16'").groupBy("result_id", "code").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("query_id", "content"))).alias("s"))
    return rows.select("result_id", "code", "confidence", F.array_join(F.transform("s", lambda s: s["content"]), " ").alias("text"))


@query("SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS enriched, avg(CAST(o_orderstatus = 'F' AS INT)) AS coverage FROM orders GROUP BY 1")
def agg32_registry_coverage(spark, sf_dir):
    enriched = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(A.share(enriched).alias("enriched"), F.avg(enriched.cast("int")).alias("coverage"))


@query(with_(COVERAGE) + "SELECT result_id, populated / (CASE WHEN total = 0 THEN 1 ELSE total END) AS coverage, CASE WHEN populated / (CASE WHEN total = 0 THEN 1 ELSE total END) >= 0.75 AND average >= 0.70 THEN 'PASS' WHEN populated / (CASE WHEN total = 0 THEN 1 ELSE total END) >= 0.5 THEN 'REVIEW' ELSE 'FAIL' END AS verdict FROM cr")
def mth9_quality_verdict(spark, sf_dir):
    return A.quality_verdict(star.coverage(spark, sf_dir))


@query(with_(RESULTS) + """, r AS (SELECT run_id, elapsed, row_number() OVER (PARTITION BY run_id ORDER BY elapsed) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM pr)
SELECT run_id, avg(elapsed) AS mean, quantile_cont(elapsed, 0.5) AS median, max(elapsed) FILTER (k = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1) AS p95, min(elapsed) AS least, max(elapsed) AS greatest FROM r GROUP BY 1""")
def agg18_timing_percentiles(spark, sf_dir):
    return A.percentiles(star.results(spark, sf_dir), "run_id", "elapsed")


@query(with_(EXTRACTIONS) + ", t AS (SELECT result_id, content, count(DISTINCT query_id) AS q FROM qe WHERE length(content) > 5 GROUP BY ALL HAVING count(DISTINCT query_id) > 1) SELECT result_id, count(*) AS duplicated, CAST(sum(q) AS BIGINT) AS queries FROM t GROUP BY 1")
def agg17_duplicate_answers(spark, sf_dir):
    return A.duplicate_answers(star.extractions(spark, sf_dir))


@query(with_(MATCHES) + "SELECT CAST(floor(round(boosted * 1000) / 100) AS BIGINT) AS band, count(*) AS n, avg(boosted) AS avg_predicted, avg(CAST(auto_mapped AS INT)) AS accuracy, avg(boosted) - avg(CAST(auto_mapped AS INT)) AS bias FROM sm WHERE boosted < 1 GROUP BY 1")
def agg26_calibration_bands(spark, sf_dir):
    return A.calibration(star.matches(spark, sf_dir), "boosted", "auto_mapped")


@query(with_(MATCHES) + ", b AS (SELECT CAST(floor(round(boosted * 1000) / 100) AS BIGINT) AS band, count(*) AS n, avg(boosted) - avg(CAST(auto_mapped AS INT)) AS bias FROM sm WHERE boosted < 1 GROUP BY 1) SELECT coalesce(avg(bias), 0.0) AS adjustment, count(*) AS bands FROM b WHERE n >= 5")
def agg26_calibration_adjustment(spark, sf_dir):
    return A.calibration_adjustment(A.calibration(star.matches(spark, sf_dir), "boosted", "auto_mapped"))


@query(with_(RESULTS) + "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, avg(CAST(status = 'pass' AS INT)) AS accuracy FROM pr GROUP BY 1")
def agg27_trend(spark, sf_dir):
    return A.trend(star.results(spark, sf_dir).withColumn("ok", F.col("status") == "pass"), "ts", "ok")


@query("""WITH t AS (SELECT l_partkey % 40 AS header, l_suppkey % 16 AS section, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY n DESC, section) AS k FROM t) SELECT header, section, n FROM r WHERE k = 1 AND n >= 2""")
def agg28_synonym_promotion(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy((F.col("l_partkey") % 40).alias("header"), (F.col("l_suppkey") % 16).alias("section")).agg(F.count("*").alias("n"))
    return A.best_per_group(counts, ["header"], "n", ["section"]).where("n >= 2")


@query("""WITH d AS (SELECT DISTINCT l_suppkey % 16 AS section, l_suppkey AS template FROM lineitem WHERE l_quantity < 10 AND l_suppkey % 16 <> l_partkey % 3),
u AS (SELECT count(DISTINCT template) AS n FROM d) SELECT section, n - count(*) AS missing FROM d, u GROUP BY section, n HAVING 2 * (n - count(*)) >= n""")
def agg29_consensus_missing(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_quantity < 10 AND l_suppkey % 16 <> l_partkey % 3").select((F.col("l_suppkey") % 16).alias("section"), F.col("l_suppkey").alias("template")).distinct()
    total = seen.agg(F.count_distinct("template").alias("n"))
    return seen.groupBy("section").agg(F.count("*").alias("has")).crossJoin(F.broadcast(total)).where("2 * (n - has) >= n").select("section", (F.col("n") - F.col("has")).alias("missing"))


@query("SELECT l_returnflag AS grp, sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END) / sum(l_linenumber) AS coverage FROM lineitem GROUP BY 1")
def agg30_char_coverage(spark, sf_dir):
    total = F.sum("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(A.ratio(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).otherwise(0)), total).alias("coverage"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang)")
def agg31_corpus_stats_cube(spark, sf_dir):
    return table(spark, sf_dir, "documents").cube("source", "lang").agg(F.count("*").alias("n"))


@query(with_(RESULTS, MATCHES) + "SELECT run_id, code, count(*) AS n, avg(boosted) AS avg_boosted FROM sm JOIN pr USING (result_id) GROUP BY ROLLUP (run_id, code)")
def agg40_rollup(spark, sf_dir):
    return star.matches(spark, sf_dir).join(star.results(spark, sf_dir), "result_id").rollup("run_id", "code").agg(F.count("*").alias("n"), F.avg("boosted").alias("avg_boosted"))


@query(with_(MATCHES) + "SELECT code, count(DISTINCT result_id) AS documents, true AS close FROM sm GROUP BY code")
def agg41_approximate_distinct(spark, sf_dir):
    """Sketches of a relative error of 2 % (one standard deviation), held against exact counts: within five of these, and one."""
    # apart: beside an exact count each document of a section would carry a sketch of its own
    m = star.matches(spark, sf_dir).select("code", "result_id")
    about = m.groupBy("code").agg(F.approx_count_distinct("result_id", 0.02).alias("about"))
    exact = m.distinct().groupBy("code").agg(F.count("result_id").alias("documents"))
    counts = about.join(exact.withColumnRenamed("code", "of"), F.col("code").eqNullSafe(F.col("of")))
    return counts.select("code", "documents", (F.abs(F.col("about") - F.col("documents")) <= 0.1 * F.col("documents") + 1).alias("close"))


@query("""WITH a AS (SELECT avg(CAST(l_comment_null AS INT)) AS x, avg(CASE WHEN l_returnflag IN ('A', 'N') THEN 1 ELSE 0 END) AS y, avg(CASE WHEN l_quantity BETWEEN 5 AND 45 THEN 1 ELSE 0 END) AS z FROM (SELECT *, l_tax IS NOT NULL AS l_comment_null FROM lineitem))
SELECT 'not_null' AS expectation, x AS fraction, x >= 0.7 AS ok FROM a UNION ALL SELECT 'in_set', y, y >= 0.7 FROM a UNION ALL SELECT 'between', z, z >= 0.7 FROM a""")
def agg37_expectations(spark, sf_dir):
    return A.mostly(table(spark, sf_dir, "lineitem"), {"not_null": F.col("l_tax").isNotNull(), "in_set": F.col("l_returnflag").isin("A", "N"), "between": F.col("l_quantity").between(5, 45)}, 0.7)


@query(with_(COVERAGE) + """, a AS (SELECT result_id // 2 AS k, populated, average, answered FROM cr WHERE result_id % 2 = 0), b AS (SELECT result_id // 2 AS k, populated, average, answered FROM cr WHERE result_id % 2 = 1),
j AS (SELECT a.k, UNNEST([('populated', CAST(a.populated AS DOUBLE), CAST(b.populated AS DOUBLE), 0.0), ('average', CAST(a.average AS DOUBLE), CAST(b.average AS DOUBLE), 0.05), ('answered', CAST(a.answered AS DOUBLE), CAST(b.answered AS DOUBLE), 0.0)]) AS m FROM a JOIN b USING (k)),
n AS (SELECT k, m[1] AS metric, m[2] AS before, m[3] AS after, m[4] AS threshold FROM j)
SELECT k, metric, before, after, CASE WHEN before = 0 THEN 0.0 ELSE (before - after) / before END AS drop, CASE WHEN before = 0 THEN 0.0 ELSE (before - after) / before END > threshold AS regressed FROM n""")
def jn9_baseline_regressions(spark, sf_dir):
    c = star.coverage(spark, sf_dir).withColumn("k", F.floor(F.col("result_id") / 2).cast("long"))
    side = lambda r: c.where(F.col("result_id") % 2 == r)
    return A.metric_regressions(side(0), side(1), "k", {"populated": 0.0, "average": 0.05, "answered": 0.0})


@query(with_(RESULTS) + "SELECT DISTINCT run_id, min(ts) OVER (PARTITION BY run_id) AS first_ts, max(ts) OVER (PARTITION BY run_id) AS last_ts FROM pr")
def data_op3_run_lookup(spark, sf_dir):
    return star.results(spark, sf_dir).groupBy("run_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"))


@query(with_(MATCHES) + "SELECT code, round(avg(boosted) * 100) AS pct, max(boosted) - min(boosted) AS variance, CASE WHEN avg(boosted) >= 0.75 THEN 'green' WHEN avg(boosted) >= 0.70 THEN 'amber' ELSE 'red' END AS colour FROM sm GROUP BY 1")
def data_op4_display_projection(spark, sf_dir):
    avg = F.avg("boosted")
    return star.matches(spark, sf_dir).groupBy("code").agg(F.round(avg * 100).alias("pct"), (F.max("boosted") - F.min("boosted")).alias("variance"), F.when(avg >= 0.75, "green").when(avg >= 0.70, "amber").otherwise("red").alias("colour"))


@query(with_(PAIRS) + "SELECT result_id, line, pos, code, CASE WHEN extracted = '' THEN 'gap' WHEN coalesce(confidence, 0) >= 0.80 THEN 'good' WHEN coalesce(confidence, 0) >= 0.60 THEN 'partial' ELSE 'poor' END AS match_quality FROM cp")
def data_op1_star_flatten(spark, sf_dir):
    c = F.coalesce("confidence", F.lit(0))
    return star.pairs(spark, sf_dir).select("result_id", "line", "pos", "code", F.when(F.col("extracted") == "", "gap").when(c >= 0.80, "good").when(c >= 0.60, "partial").otherwise("poor").alias("match_quality"))


@query(with_(EXTRACTIONS) + """, a AS (SELECT result_id // 2 AS k, array_agg(DISTINCT code) AS x FROM qe WHERE result_id % 2 = 0 GROUP BY 1), b AS (SELECT result_id // 2 AS k, array_agg(DISTINCT code) AS y FROM qe WHERE result_id % 2 = 1 GROUP BY 1)
SELECT k, CAST(len(list_intersect(x, y)) AS BIGINT) AS agreed, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS jaccard, len(list_intersect(x, y)) / len(x) AS accuracy FROM a JOIN b USING (k)""")
def data_op12_two_pipelines(spark, sf_dir):
    e = star.extractions(spark, sf_dir).withColumn("k", F.floor(F.col("result_id") / 2).cast("long"))
    side = lambda r, c: e.where(F.col("result_id") % 2 == r).groupBy("k").agg(F.collect_set("code").alias(c))
    both = side(0, "x").join(side(1, "y"), "k")
    agreed = F.size(F.array_intersect("x", "y"))
    return both.select("k", agreed.cast("long").alias("agreed"), (agreed / F.size(F.array_union("x", "y"))).alias("jaccard"), (agreed / F.size("x")).alias("accuracy"))


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal >= 5000 THEN 1 WHEN c_acctbal >= 0 THEN 2 ELSE 3 END AS tier FROM customer WHERE contains(lower(c_name), '00001') OR contains(lower(c_mktsegment), 'build')")
def fil20_catalogue_search(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    hit = lambda q: F.contains(F.lower("c_name"), F.lit(q)) | F.contains(F.lower("c_mktsegment"), F.lit(q))
    return c.where(hit("00001") | hit("build")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 5000, 1).when(F.col("c_acctbal") >= 0, 2).otherwise(3).alias("tier"))


@query(with_(RESULTS, MATCHES) + "SELECT nct_id, min(boosted) AS lowest FROM sm JOIN pr USING (result_id) GROUP BY 1 ORDER BY lowest, nct_id LIMIT 10")
def srt6_lowest_documents(spark, sf_dir):
    rows = star.matches(spark, sf_dir).join(star.results(spark, sf_dir), "result_id").groupBy("nct_id").agg(F.min("boosted").alias("lowest"))
    return rows.orderBy("lowest", "nct_id").limit(10)


@query("SELECT s_suppkey AS id FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'A'")
def set3_required_minus_present(spark, sf_dir):
    present = table(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_returnflag = 'A'").select(F.col("l_suppkey").alias("id"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).distinct().join(present, "id", "left_anti")


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set4_intersect(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    side = lambda f: item.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("id"))
    return side("A").intersect(side("R"))


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def set2_union_of_codes(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    side = lambda f: item.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("id"))
    return side("A").unionByName(side("R")).distinct()


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS k FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey FROM r WHERE k = 1")
def set6_first_per_key(spark, sf_dir):
    from corvane.operators.sets import first_per_key

    return first_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey FROM orders ANTI JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1) l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def set9_skip_existing(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey").join(done, "o_orderkey", "left_anti")
