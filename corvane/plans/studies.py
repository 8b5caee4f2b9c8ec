"""Study-design operators over line items, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import joins as J
from corvane.operators import studies as S
from corvane.plans.windows import VISITS, visits
from corvane.registry import query, table, typed


@query("""WITH v AS (SELECT l_partkey AS activity, l_linenumber AS col, count(*) FILTER (l_returnflag = 'A') AS yes, count(*) AS methods FROM lineitem GROUP BY ALL)
SELECT activity, col, yes > methods - yes AS scheduled, greatest(yes, methods - yes) / methods AS confidence, yes > 0 AND methods - yes > 0 AS disputed FROM v""")
def agg19_cell_votes(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("activity"), F.col("l_linenumber").alias("col"), (F.col("l_returnflag") == "A").alias("mark"))
    return S.cell_votes(cells, ["activity", "col"], "mark")


@query("""WITH p AS (SELECT l_partkey AS name, l_suppkey AS visit, CAST(0.7 AS DOUBLE) AS c, 'narrative' AS source FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, l_suppkey, 0.8, 'table' FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT name, visit, max(c) AS best, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS k FROM p GROUP BY ALL)
SELECT name, visit, round(CASE WHEN n = 1 THEN best ELSE least(0.95, best + 0.1 * (n - 1)) END, 4) AS confidence, sources, k > 1 AS multi_source FROM g""")
def agg20_stream_union(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    part = lambda f, c: item.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("visit"), F.lit(c).alias("confidence"))
    return S.merged_pairs({"narrative": part("A", 0.7), "table": part("R", 0.8)}, ["name", "visit"])


@query("WITH r AS (SELECT l_orderkey AS page, l_partkey AS tab, CAST(l_quantity AS BIGINT) AS cells, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey) AS k FROM lineitem) SELECT page, tab, cells FROM r WHERE k = 1")
def agg21_one_table_per_page(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("tab"), F.col("l_quantity").cast("long").alias("cells"), "l_suppkey")
    return S.one_table_per_page(t, ["page"], "cells", ["tab", "l_suppkey"]).select("page", "tab", "cells")


@query("SELECT l_orderkey AS instance, s_name AS timepoint, p_name AS activity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'")
def jn1_scheduled_grid(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instance"), F.col("l_suppkey").alias("timepoint_id"), F.col("l_partkey").alias("activity_id"), (F.col("l_returnflag") == "A").alias("scheduled"))
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("timepoint_id"), F.col("s_name").alias("timepoint"))
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("activity_id"), F.col("p_name").alias("activity"))
    return J.scheduled_grid(i, t, a).select("instance", "timepoint", "activity")


@query("WITH t AS (SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS kept FROM supplier) SELECT DISTINCT l_partkey AS activity_id, kept AS timepoint_id FROM lineitem JOIN t ON id = l_suppkey")
def jn2_remap_and_dedup(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("activity_id"), F.col("l_suppkey").alias("timepoint_id"))
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("timepoint_id"), "s_nationkey", F.col("s_suppkey").alias("pos"))
    return J.remapped(i, t, ["s_nationkey"])


_DIFF = """a AS (SELECT o_custkey % 500 AS k, count(*) AS orders, min(o_orderpriority) AS priority, CASE WHEN max(o_totalprice) > 400000 THEN max(o_orderkey) END AS top FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 9 <> 0 GROUP BY 1),
b AS (SELECT o_custkey % 500 AS k, count(*) AS orders, min(o_orderpriority) AS priority, CASE WHEN max(o_totalprice) > 400000 THEN max(o_orderkey) END AS top FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey % 7 <> 0 GROUP BY 1)"""


@query("WITH " + _DIFF + """, j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS added, b.k IS NULL AS removed, UNNEST([('orders', CAST(a.orders AS VARCHAR), CAST(b.orders AS VARCHAR)), ('priority', a.priority, b.priority), ('top', CAST(a.top AS VARCHAR), CAST(b.top AS VARCHAR))]) AS f FROM a FULL JOIN b ON a.k = b.k)
SELECT k, 'changed' AS change, f[1] AS field, f[2] AS before, f[3] AS after FROM j WHERE NOT added AND NOT removed AND f[2] IS DISTINCT FROM f[3] UNION ALL SELECT DISTINCT k, CASE WHEN added THEN 'added' ELSE 'removed' END, NULL, NULL, NULL FROM j WHERE added OR removed""")
def jn8_version_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    side = lambda r, m: o.where((F.col("o_orderkey") % 2 == r) & (F.col("o_custkey") % m != 0)).groupBy((F.col("o_custkey") % 500).alias("k")).agg(F.count("*").alias("orders"), F.min("o_orderpriority").alias("priority"), F.when(F.max("o_totalprice") > 400000, F.max("o_orderkey")).alias("top"))
    return J.diff(side(0, 9), side(1, 7), ["k"], ["orders", "priority", "top"])


@query("""WITH q AS (SELECT p_partkey AS q FROM part), r0 AS (SELECT DISTINCT l_partkey AS q, 'sub' AS section FROM lineitem WHERE l_quantity > 49), r1 AS (SELECT DISTINCT l_partkey AS q, 'parent' AS section FROM lineitem WHERE l_discount >= 0.09)
SELECT q.q, coalesce(r0.section, r1.section, 'full text') AS section, CASE WHEN r0.q IS NOT NULL THEN 0.9 WHEN r1.q IS NOT NULL THEN 0.6 ELSE 0.0 END AS similarity, CASE WHEN r0.q IS NOT NULL THEN 0 WHEN r1.q IS NOT NULL THEN 1 ELSE 2 END AS level FROM q LEFT JOIN r0 ON r0.q = q.q LEFT JOIN r1 ON r1.q = q.q""")
def jn27_routes_with_fallback(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    r = lambda c, s, x: item.where(c).select(F.col("l_partkey").alias("q")).distinct().select("q", F.lit(s).alias("section"), F.lit(x).alias("similarity"))
    return J.routed(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("q")), [r("l_quantity > 49", "sub", 0.9), r("l_discount >= 0.09", "parent", 0.6)], "q")


@query("""WITH e AS (SELECT l_orderkey AS id, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, l_tax * 12 AS c, l_comment FROM (SELECT *, 'x' AS l_comment FROM lineitem)) SELECT id, part, supp, line, CASE WHEN c < 0.70 AND s_acctbal > 0 THEN s_name ELSE 'extracted' END AS value, CASE WHEN c < 0.70 AND s_acctbal > 0 THEN 0.85 ELSE c END AS confidence FROM e LEFT JOIN supplier ON s_suppkey = supp""")
def jn28_registry_replacement(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"), (F.col("l_tax") * 12).alias("c"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"), "s_name", "s_acctbal")
    use = (F.col("c") < 0.70) & (F.col("s_acctbal") > 0)
    return e.join(J.broadcast_if_small(s), "supp", "left").select("id", "part", "supp", "line", F.when(use, F.col("s_name")).otherwise("extracted").alias("value"), F.when(use, 0.85).otherwise(F.col("c")).alias("confidence"))


@query("WITH h AS (SELECT l_suppkey % 16 AS section, count(DISTINCT l_partkey) AS answered FROM lineitem WHERE l_quantity > 40 AND l_partkey < 60 GROUP BY 1), q AS (SELECT UNNEST(range(0, 20)) AS section) SELECT q.section, coalesce(answered, 0) AS answered FROM q LEFT JOIN h USING (section)")
def jn29_query_coverage(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").where("l_quantity > 40 AND l_partkey < 60").groupBy((F.col("l_suppkey") % 16).alias("section")).agg(F.count_distinct("l_partkey").alias("answered"))
    return spark.range(20).select(F.col("id").alias("section")).join(hits, "section", "left").select("section", F.coalesce("answered", F.lit(0)).alias("answered"))


@query("SELECT n_name AS arm, r_name AS element, row_number() OVER (PARTITION BY n_name ORDER BY r_regionkey) AS pos FROM nation, region")
def jn32_arms_by_elements(spark, sf_dir):
    from pyspark.sql import Window

    # both sides are design tables of a study: a few arms and a few elements
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("arm")).crossJoin(J.broadcast_if_small(table(spark, sf_dir, "region")))
    return rows.select("arm", F.col("r_name").alias("element"), F.row_number().over(Window.partitionBy("arm").orderBy("r_regionkey")).cast("long").alias("pos"))


@query("SELECT p.p_partkey AS part, list_sort(list(DISTINCT k.w)) AS domains FROM part p JOIN (VALUES ('STEEL'), ('BRASS'), ('TIN'), ('small'), ('Brand#1')) k(w) ON contains(lower(p.p_type || ' ' || p.p_name || ' ' || p.p_brand), lower(k.w)) GROUP BY 1")
def jn30_trigger_domains(spark, sf_dir):
    words = ("STEEL", "BRASS", "TIN", "small", "Brand#1")
    text = F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand"))
    hit = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, F.lower(w)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.array_sort(hit).alias("domains")).where(F.size("domains") > 0)


@query("WITH " + VISITS + """, o AS (SELECT study, CASE kind WHEN 'screening' THEN 'Screening' WHEN 'followup' THEN 'Follow-up' ELSE 'Treatment' END AS epoch, row_number() OVER (PARTITION BY study ORDER BY day, visit) AS pos FROM v), g AS (SELECT study, epoch, min(pos) AS pos, count(*) AS visits FROM o GROUP BY ALL)
SELECT study, epoch, visits, row_number() OVER (PARTITION BY study ORDER BY pos) AS number FROM g""")
def data_op6_epochs(spark, sf_dir):
    return S.epochs(visits(spark, sf_dir), "study", "kind", ["day", "visit"], {"screening": "Screening", "followup": "Follow-up"}, "Treatment")


@query("WITH " + VISITS + "SELECT CAST(study AS VARCHAR) AS \"STUDYID\", 'TV' AS \"DOMAIN\", CAST(row_number() OVER (PARTITION BY study ORDER BY day, visit) AS DOUBLE) AS \"VISITNUM\", name AS \"VISIT\", CAST(day AS DOUBLE) AS \"VISITDY\", CAST(early AS DOUBLE) AS \"TVSTRL\", CAST(late AS DOUBLE) AS \"TVENRL\" FROM v")
def sd3_trial_visits(spark, sf_dir):
    return S.trial_visits(visits(spark, sf_dir).withColumn("before", -F.col("early")).withColumn("after", F.col("late")), "study", ["day", "visit"])


@query("WITH a AS (SELECT DISTINCT c_nationkey AS study, c_mktsegment AS armcd FROM customer), e AS (SELECT DISTINCT s_nationkey AS study, s_suppkey AS k, 'E' || s_suppkey AS etcd FROM supplier), p AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY k) AS pos FROM e) SELECT CAST(study AS VARCHAR) AS \"STUDYID\", 'TA' AS \"DOMAIN\", armcd AS \"ARMCD\", CAST(pos AS DOUBLE) AS \"TAETORD\", etcd AS \"ETCD\" FROM a JOIN p USING (study)")
def sd2_trial_arms(spark, sf_dir):
    from pyspark.sql import Window

    arms = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("study"), F.col("c_mktsegment").alias("armcd")).distinct()
    e = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("study"), F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("etcd"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("pos"))
    return S.trial_arms(arms, e, "study")


@query("""WITH t AS (SELECT c_custkey, UNNEST(list_filter([('TITLE', c_name), ('INDIC', CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END), ('SSTYP', CASE WHEN c_acctbal > 0 THEN 'EFFICACY' END), ('PLANSUB', CAST(c_nationkey AS VARCHAR))], lambda x: x[2] IS NOT NULL)) AS p, generate_subscripts(list_filter([('TITLE', c_name), ('INDIC', CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END), ('SSTYP', CASE WHEN c_acctbal > 0 THEN 'EFFICACY' END), ('PLANSUB', CAST(c_nationkey AS VARCHAR))], lambda x: x[2] IS NOT NULL), 1) AS k FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS "STUDYID", 'TS' AS "DOMAIN", CAST(k AS DOUBLE) AS "TSSEQ", p[1] AS "TSPARMCD", p[2] AS "TSVAL" FROM t""")
def sd1_trial_summary(spark, sf_dir):
    return trial_summary(spark, sf_dir)


def trial_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return S.parameters(c, "c_custkey", {"TITLE": F.col("c_name"), "INDIC": F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), "SSTYP": F.when(F.col("c_acctbal") > 0, "EFFICACY"), "PLANSUB": F.col("c_nationkey")})


@query("SELECT p_partkey AS id, CASE WHEN upper(trim(p_type)) LIKE 'PROMO%' THEN 'Promotional' WHEN upper(trim(p_type)) LIKE 'STANDARD%' THEN 'Standard' END AS term, upper(trim(p_type)) NOT LIKE 'PROMO%' AND upper(trim(p_type)) NOT LIKE 'STANDARD%' AS review FROM part")
def str37_controlled_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type")
    return S.normalised_terms(p, "p_type", {"PROMO": "Promotional", "STANDARD": "Standard"}).select("id", "term", "review")


@query("""WITH s AS (SELECT CAST(n_nationkey AS VARCHAR) AS "STUDYID", UNNEST(range(1, 41)) AS k FROM nation), u AS (SELECT "STUDYID", 'DM' AS "DOMAIN", "STUDYID" || '-' || lpad(CAST(k AS VARCHAR), 4, '0') AS "USUBJID" FROM s)
SELECT *, ('0x' || left(md5("USUBJID" || '|11'), 8))::BIGINT % 60 + 18 AS "AGE", (['F', 'M'])[('0x' || left(md5("USUBJID" || '|12'), 8))::BIGINT % 2 + 1] AS "SEX" FROM u""")
def sd8_synthetic_subjects(spark, sf_dir):
    return S.synthetic_subjects(table(spark, sf_dir, "nation"), "n_nationkey", 40, 11)


@query("""WITH RECURSIVE e AS (SELECT o_custkey % 50 AS page, o_orderkey % 97 AS a, (o_orderkey * 7) % 97 AS b FROM orders), b AS (SELECT page, a, b FROM e UNION SELECT page, b, a FROM e), r AS (SELECT page, a, a AS label FROM b UNION SELECT b.page, b.a, r.label FROM b JOIN r ON r.page = b.page AND r.a = b.b)
SELECT page, a, min(label) AS label FROM r GROUP BY ALL""")
def gr1_shape_components(spark, sf_dir):
    k = F.col("o_orderkey")
    return S.shape_components(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("page"), (k % 97).alias("a"), ((k * 7) % 97).alias("b")))


@query("SELECT l_orderkey AS src, list_sort(list(DISTINCT l_partkey)) AS targets FROM lineitem GROUP BY 1")
def map1_adjacency(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("src")).agg(F.array_sort(F.collect_set("l_partkey")).alias("targets"))


@query("PIVOT (SELECT l_suppkey % 20 AS activity, l_linenumber AS visit FROM lineitem WHERE l_returnflag = 'A') ON visit IN (1, 2, 3, 4, 5, 6, 7) USING count(*) GROUP BY activity")
def arr2_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select((F.col("l_suppkey") % 20).alias("activity"), F.col("l_linenumber").alias("visit"))
    return rows.groupBy("activity").pivot("visit", [1, 2, 3, 4, 5, 6, 7]).count().na.fill(0)


@query("""WITH b AS (SELECT p_partkey AS id, p_size AS x, p_partkey % 40 AS page, p_retailprice / 20 AS y FROM part), r AS (SELECT s_suppkey AS box, s_suppkey % 40 AS page, s_suppkey % 25 AS x0, s_suppkey % 25 + 12 AS x1, s_suppkey % 30 + 40 AS y0, s_suppkey % 30 + 60 AS y1 FROM supplier)
SELECT b.page, box, id FROM b JOIN r ON b.page = r.page AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def jn17_containment(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("x"), (F.col("p_partkey") % 40).alias("page"), (F.col("p_retailprice") / 20).alias("y"))
    k = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select(k.alias("box"), (k % 40).alias("page"), (k % 25).alias("x0"), (k % 25 + 12).alias("x1"), (k % 30 + 40).alias("y0"), (k % 30 + 60).alias("y1"))
    shape = ["page", "x0", "x1", "y0", "y1"]
    # points meet each shape once, and only those that lie in it meet all boxes of this shape
    inside = p.join(J.broadcast_if_small(r.select(*shape).distinct()), "page").where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").select("id", F.struct(*shape).alias("shape"))
    return J.listed(inside, r.select(F.struct(*shape).alias("shape"), "box"), "shape", "box").select("shape.page", "box", "id")


@query("""WITH d AS (SELECT p_partkey AS id, p_size AS x, p_partkey % 40 AS page FROM part), r AS (SELECT s_suppkey AS box, s_suppkey % 40 AS page, s_suppkey % 50 AS x FROM supplier), n AS (SELECT d.page, id, box, abs(d.x - r.x) AS dist, row_number() OVER (PARTITION BY id ORDER BY abs(d.x - r.x), box) AS k FROM d JOIN r USING (page) WHERE abs(d.x - r.x) < 15)
SELECT page, id, box, dist FROM n WHERE k = 1""")
def jn16_nearest_shape(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("x"), (F.col("p_partkey") % 40).alias("page"))
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("box"), (F.col("s_suppkey") % 40).alias("page"), (F.col("s_suppkey") % 50).alias("rx"))
    # of shapes at one place only the first can be the nearest, and points at one place have the same one
    first = r.groupBy("page", "rx").agg(F.min("box").alias("box"))
    near = p.select("page", "x").distinct().join(J.broadcast_if_small(first), "page").withColumn("dist", F.abs(F.col("x") - F.col("rx"))).where("dist < 15")
    best = near.groupBy("page", "x").agg(F.min(F.struct("dist", "box")).alias("s"))
    found = p.join(J.broadcast_if_small(best), ["page", "x"])
    return found.groupBy("page", "id").agg(F.min("s").alias("s")).select("page", "id", "s.box", "s.dist")


typed(jn27_routes_with_fallback="similarity DOUBLE")
