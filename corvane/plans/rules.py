"""Validation rules over tabulation datasets made of customers, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import rules as R
from corvane.plans.studies import trial_summary
from corvane.plans.windows import VISITS, visits
from corvane.registry import query, table

_TS = """t AS (SELECT c_custkey, UNNEST(list_filter([('TITLE', c_name), ('INDIC', CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END), ('SSTYP', CASE WHEN c_acctbal > 0 THEN 'EFFICACY' END), ('PLANSUB', CAST(c_nationkey AS VARCHAR))], lambda x: x[2] IS NOT NULL)) AS p FROM customer), ts AS (SELECT CAST(c_custkey AS VARCHAR) AS s, p[1] AS code, p[2] AS val FROM t)"""


@query("WITH " + _TS + """, r AS (SELECT 'TS-006-TSVAL' AS rule, 'Warning' AS severity, count(*) FILTER (length(val) > 10) AS n FROM ts UNION ALL SELECT 'TS-006-TSPARMCD', 'Warning', count(*) FILTER (length(code) > 5) FROM ts UNION ALL SELECT 'TS-011', 'Error', count(*) FILTER (NOT regexp_full_match(code, '[A-Za-z]{1,5}')) FROM ts) SELECT 'TS' AS domain, rule, severity, n FROM r WHERE n > 0""")
def val1_domain_rules(spark, sf_dir):
    ts = trial_summary(spark, sf_dir)
    rules = R.standard_rules("TS", ["STUDYID", "TSPARMCD"], {"TSVAL": 10, "TSPARMCD": 5}) | {"TS-011": ("Error", ~F.col("TSPARMCD").rlike("^[A-Za-z]{1,5}$"))}
    return R.severity_order(R.counted(ts, "TS", rules))


@query("WITH d AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL HAVING count(*) > 1), e AS (SELECT l_partkey, l_suppkey, count(*) AS c FROM lineitem GROUP BY ALL HAVING count(*) > 1) SELECT 'TA' AS domain, 'TA-011' AS rule, 'Error' AS severity, count(*) AS n FROM d HAVING count(*) > 0 UNION ALL SELECT 'TE', 'TE-010', 'Error', count(*) FROM e HAVING count(*) > 0")
def val3_duplicate_keys(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    return R.all_findings([R.duplicates(item, "TA", "TA-011", ["l_orderkey", "l_linenumber"]), R.duplicates(item, "TE", "TE-010", ["l_partkey", "l_suppkey"])])


@query("WITH r AS (SELECT 'TV-010' AS rule, 'Error' AS severity, count(*) FILTER (l_linenumber <= 1) AS n FROM lineitem UNION ALL SELECT 'TI-010', 'Error', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem UNION ALL SELECT 'TV-020', 'Warning', count(*) FILTER (l_quantity > 100) FROM lineitem) SELECT 'TV' AS domain, rule, severity, n FROM r WHERE n > 0")
def val4_visit_and_criteria_rules(spark, sf_dir):
    rules = {"TV-010": ("Error", F.col("l_linenumber") <= 1), "TI-010": ("Error", ~F.col("l_returnflag").isin("A", "N")), "TV-020": ("Warning", F.col("l_quantity") > 100)}
    return R.counted(table(spark, sf_dir, "lineitem"), "TV", rules)


@query("WITH " + VISITS + ", e AS (SELECT study, kind FROM (SELECT DISTINCT study FROM v), (VALUES ('screening'), ('treatment'), ('followup')) k(kind)) SELECT study, kind FROM e ANTI JOIN v USING (study, kind)")
def val6_epochs_without_visits(spark, sf_dir):
    v = visits(spark, sf_dir).select("study", "kind")
    expected = v.select("study").distinct().select("study", F.explode(F.array(*map(F.lit, ("screening", "treatment", "followup")))).alias("kind"))
    return expected.join(v, ["study", "kind"], "left_anti")


@query("""WITH f AS (SELECT 'VS-001' AS rule, 'Error' AS severity, count(*) FILTER (l_quantity > 49) AS n FROM lineitem UNION ALL SELECT 'VS-002', 'Warning', count(*) FILTER (l_discount > 0.09) FROM lineitem UNION ALL SELECT 'VS-003', 'Warning', count(*) FILTER (l_tax > 0.07) FROM lineitem)
SELECT severity, count(*) AS rules, CAST(sum(n) AS BIGINT) AS n, false AS feasible FROM f WHERE n > 0 GROUP BY severity""")
def val7_feasibility(spark, sf_dir):
    rules = {"VS-001": ("Error", F.col("l_quantity") > 49), "VS-002": ("Warning", F.col("l_discount") > 0.09), "VS-003": ("Warning", F.col("l_tax") > 0.07)}
    return R.summary(R.counted(table(spark, sf_dir, "lineitem"), "VS", rules))


@query("SELECT parameter, parameter IN (SELECT upper(trim(c_mktsegment)) FROM customer) AS present FROM (VALUES ('BUILDING'), ('MACHINERY'), ('SPACECRAFT'), ('FURNITURE')) v(parameter)")
def val8_completeness(spark, sf_dir):
    return R.completeness(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY", "SPACECRAFT", "FURNITURE"])


@query("""SELECT o_custkey AS section, bool_or(o_orderstatus = 'F') AS has_text, bool_or(o_orderstatus = 'O') AS has_table, bool_or(o_orderstatus = 'P') AS has_diagram, count(DISTINCT o_orderpriority) AS pages, max(o_totalprice) AS confidence FROM orders GROUP BY 1""")
def val12_provenance(spark, sf_dir):
    has = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("section")).agg(has("F").alias("has_text"), has("O").alias("has_table"), has("P").alias("has_diagram"), F.count_distinct("o_orderpriority").alias("pages"), F.max("o_totalprice").alias("confidence"))


@query("""WITH a AS (SELECT o_custkey AS k, min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS p, max(o_totalprice) AS e FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS p, max(o_totalprice) AS e FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL OR a.p < b.p OR (a.p = b.p AND a.e >= b.e) THEN 'first' ELSE 'second' END AS side, least(a.p, b.p) AS priority FROM a FULL JOIN b ON a.k = b.k""")
def val15_stage_status_merge(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    o = table(spark, sf_dir, "orders")
    side = lambda r, s: o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k")).agg(F.min(rank).alias(f"p{s}"), F.max("o_totalprice").alias(f"e{s}"))
    both = side(0, "a").join(side(1, "b"), "k", "full_outer")
    first = F.col("pb").isNull() | (F.col("pa") < F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("ea") >= F.col("eb")))
    return both.select("k", F.when(first, "first").otherwise("second").alias("side"), F.least("pa", "pb").alias("priority"))


@query("SELECT concat_ws(' AND ', c_mktsegment, 'nation ' || c_nationkey, CASE WHEN c_acctbal < 0 THEN 'overdrawn' END) AS search, count(*) AS n FROM customer GROUP BY 1")
def val17_search_strings(spark, sf_dir):
    text = F.concat_ws(" AND ", "c_mktsegment", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")), F.when(F.col("c_acctbal") < 0, "overdrawn"))
    return table(spark, sf_dir, "customer").groupBy(text.alias("search")).agg(F.count("*").alias("n"))
