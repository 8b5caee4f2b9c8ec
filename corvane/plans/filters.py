"""Predicates, sorts, set operations, dates, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import predicates as P
from corvane.functions import text as T
from corvane.functions.text import natural_key
from corvane.operators import joins as J
from corvane.operators.sets import first_per_key, near_duplicates_removed
from corvane.registry import query, table, typed

ITEM = "l_orderkey AS id, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line"


def item(spark, sf_dir, *more):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"), *more)


@query("SELECT doc_id, quality FROM labels JOIN documents USING (doc_id) WHERE quality >= 0.8 AND trim(text) <> ''")
def fil1_confidence_filter(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("quality >= 0.8").join(table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id"), "doc_id").select("doc_id", "quality")


@query(f"SELECT {ITEM}, l_tax * 12 < CASE l_suppkey % 16 + 1 WHEN 4 THEN 0.85 WHEN 5 THEN 0.80 ELSE 0.70 END AS review FROM lineitem")
def fil2_section_thresholds(spark, sf_dir):
    dim = spark.createDataFrame([(4, 0.85), (5, 0.80)], "code long, threshold double")
    rows = item(spark, sf_dir, (F.col("l_suppkey") % 16 + 1).alias("code"), (F.col("l_tax") * 12).alias("c"))
    return rows.join(F.broadcast(dim), "code", "left").select("id", "part", "supp", "line", (F.col("c") < F.coalesce("threshold", F.lit(0.70))).alias("review"))


@query("SELECT p_brand AS parent, count(*) AS queries, count(*) FILTER (p_size > 25) AS required FROM part GROUP BY 1")
def fil3_query_selectors(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("parent")).agg(F.count("*").alias("queries"), F.count(F.when(F.col("p_size") > 25, 1)).alias("required")).orderBy(natural_key("parent"))


@query(r"SELECT doc_id, page AS line, length(h) > 60 OR regexp_matches(h, '^\s*[Pp]age\s+\d+') OR regexp_matches(h, '^\d{1,2}/\d{1,2}/\d{2,4}$') OR regexp_matches(h, '(?i)(confidential|version|protocol number|table of contents)') AS boilerplate FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS h, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)")
def fil6_boilerplate_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "h"))
    return rows.select("doc_id", (F.col("p") + 1).alias("line"), P.boilerplate_header(F.col("h")).alias("boilerplate"))


@query(r"""WITH h AS (SELECT doc_id, string_split(string_split(text, chr(10))[1], ' ') AS h FROM documents) SELECT doc_id, len(h) >= 5 AND len(list_filter(h, lambda x: regexp_matches(x, '(?i)^(the|and|of|de|le|la|der|die|un)$'))) >= 3 AS is_table FROM h""")
def fil7_schedule_table(spark, sf_dir):
    h = F.split(F.element_at(F.split("text", "\n"), 1), " ")
    return table(spark, sf_dir, "documents").select("doc_id", P.schedule_table(h, r"(?i)^(the|and|of|de|le|la|der|die|un)$").alias("is_table"))


@query("SELECT DISTINCT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?i)the [a-z]*tion')")
def fil8_candidate_pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.col("text").rlike("(?i)the [a-z]*tion")).select("conv_id", "turn").distinct()


@query("""WITH p AS (SELECT conv_id, UNNEST(range(1, max(turn) + 2)) AS page FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, turn + 1 AS page, count(*) AS blocks, sum(length(text)) AS chars, bool_or(contains(text, '|')) AS tab FROM conversations GROUP BY ALL),
s AS (SELECT p.conv_id, p.page, CASE WHEN p.page <= 3 THEN 0 WHEN NOT coalesce(tab, false) AND coalesce(blocks, 0) < 1 THEN 1 WHEN NOT coalesce(tab, false) AND coalesce(chars, 0) < 50 THEN 2 END AS priority FROM p LEFT JOIN b USING (conv_id, page)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY priority, page) AS k FROM s WHERE priority IS NOT NULL) SELECT conv_id, page, priority FROM r WHERE k <= 5""")
def fil9_sparse_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    pages = c.groupBy("conv_id").agg(F.max("turn").alias("last")).select("conv_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last") + 1)).alias("page"))
    blocks = c.groupBy("conv_id", (F.col("turn") + 1).alias("page")).agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), F.bool_or(F.contains("text", F.lit("|"))).alias("tab"))
    bare = ~F.coalesce("tab", F.lit(False))
    priority = F.when(F.col("page") <= 3, 0).when(bare & (F.coalesce("blocks", F.lit(0)) < 1), 1).when(bare & (F.coalesce("chars", F.lit(0)) < 50), 2)
    rows = pages.join(blocks, ["conv_id", "page"], "left").withColumn("priority", priority).where("priority IS NOT NULL")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("priority", "page"))).where("k <= 5").select("conv_id", "page", "priority")


@query(r"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '(\.{3,}|\|)\s*\S*$')), chr(10)) AS stripped, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '(\.{3,}|\|)\s*\S*$'))) AS dropped FROM documents""")
def fil10_contents_lines(spark, sf_dir):
    pattern = r"(\.{3,}|\|)\s*\S*$"
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(pattern))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(kept, "\n").alias("stripped"), (F.size(lines) - F.size(kept)).cast("long").alias("dropped"))


@query("SELECT l_orderkey AS id, count(DISTINCT l_returnflag) >= 2 AS multi FROM lineitem GROUP BY 1")
def fil11_multi_indication(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.size(F.array_distinct(F.collect_list("l_returnflag"))) >= 2).alias("multi"))


@query("SELECT l_partkey AS intervention, count(DISTINCT l_suppkey) AS arms, count(DISTINCT l_quantity) AS doses FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2 AND count(DISTINCT l_quantity) >= 2")
def fil12_dose_ranging(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_linestatus <> 'F'").groupBy(F.col("l_partkey").alias("intervention")).agg(F.count_distinct("l_suppkey").alias("arms"), F.count_distinct("l_quantity").alias("doses"))
    return rows.where("arms >= 2 AND doses >= 2")


@query("SELECT c_custkey AS id, coalesce(canonical, c_mktsegment) AS sponsor FROM customer LEFT JOIN (VALUES ('building', 'Construction'), ('machinery', 'Engineering')) a(alias, canonical) ON lower(c_mktsegment) = alias")
def fil13_canonical_sponsors(spark, sf_dir):
    dim = spark.createDataFrame([("building", "Construction"), ("machinery", "Engineering")], "alias string, canonical string")
    c = table(spark, sf_dir, "customer")
    return c.join(F.broadcast(dim), F.lower("c_mktsegment") == F.col("alias"), "left").select(F.col("c_custkey").alias("id"), F.coalesce("canonical", "c_mktsegment").alias("sponsor"))


@query("WITH g AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 2 AND count(DISTINCT l_partkey) >= 2 AND avg(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) <= 0.5) SELECT l_orderkey AS id, count(*) AS n FROM lineitem SEMI JOIN g USING (l_orderkey) GROUP BY 1")
def fil14_matrix_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    passed = rows.groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("v"), F.count_distinct("l_partkey").alias("a"), F.avg((F.col("l_quantity") > 40).cast("int")).alias("prose")).where("v >= 2 AND a >= 2 AND prose <= 0.5")
    return rows.join(passed, "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, regexp_matches(lower(text), '(cannot|unable to|i am sorry|as an ai|ther the)') AS refusal FROM conversations")
def fil15_refusals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.any_phrase("text", ["cannot", "unable to", "i am sorry", "as an ai", "ther the"]).alias("refusal"))


@query("SELECT s_suppkey AS id, s_name AS label, s_acctbal AS x, CASE WHEN s_acctbal < 0 THEN 'late' ELSE 'early' END AS lane FROM supplier")
def fil18_plot_projection(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_acctbal").alias("x"), F.when(F.col("s_acctbal") < 0, "late").otherwise("early").alias("lane"))


@query("SELECT o_custkey AS study, o_orderkey AS visit, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey, o_orderpriority) AS place FROM orders")
def srt2_visit_order(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate"), "o_orderkey", "o_orderpriority")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("visit"), F.row_number().over(w).cast("long").alias("place"))


@query("SELECT DISTINCT l_linenumber AS visit_index, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS lane, l_suppkey AS assessment FROM lineitem")
def srt3_grid_order(spark, sf_dir):
    lane = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("visit_index"), lane.alias("lane"), F.col("l_suppkey").alias("assessment")).distinct().orderBy("visit_index", "lane", "assessment")


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS rank FROM orders")
def srt4_severity_order(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("rank")).orderBy("rank", "id")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal >= 5000 THEN 1 WHEN c_acctbal >= 0 THEN 2 ELSE 3 END AS tier, c_acctbal AS confidence FROM customer ORDER BY tier, confidence DESC, id LIMIT 50")
def srt5_catalogue_order(spark, sf_dir):
    tier = F.when(F.col("c_acctbal") >= 5000, 1).when(F.col("c_acctbal") >= 0, 2).otherwise(3)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tier.alias("tier"), F.col("c_acctbal").alias("confidence")).orderBy("tier", F.desc("confidence"), "id").limit(50)


@query("SELECT max(url) AS latest FROM pages")
def srt7_latest_baseline(spark, sf_dir):
    return table(spark, sf_dir, "pages").agg(F.max("url").alias("latest"))


@query("""WITH RECURSIVE d(stage, needs) AS (VALUES ('extract', ''), ('parse', 'extract'), ('match', 'parse'), ('answer', 'match'), ('assemble', 'answer'), ('schedule', 'parse')), r AS (SELECT stage, 0 AS depth FROM d WHERE needs = '' UNION ALL SELECT d.stage, depth + 1 FROM d JOIN r ON d.needs = r.stage) SELECT stage, max(depth) AS depth FROM r GROUP BY 1""")
def srt8_stage_order(spark, sf_dir):
    rows = spark.createDataFrame([("extract", ""), ("parse", "extract"), ("match", "parse"), ("answer", "match"), ("assemble", "answer"), ("schedule", "parse")], "stage string, needs string")
    rows.createOrReplaceTempView("stage_needs")
    return spark.sql("WITH RECURSIVE r AS (SELECT stage, 0 AS depth FROM stage_needs WHERE needs = '' UNION ALL SELECT d.stage, depth + 1 FROM stage_needs d JOIN r ON d.needs = r.stage) SELECT stage, max(depth) AS depth FROM r GROUP BY stage")


@query("""WITH t AS (SELECT DISTINCT p_type AS term FROM part), v AS (SELECT DISTINCT c_mktsegment AS value FROM customer), s AS (SELECT value, term, 1 - levenshtein(lower(value), lower(term)) / greatest(length(value), length(term)) AS similarity FROM v, t), r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY similarity DESC, term) AS k FROM s) SELECT value, term, similarity FROM r WHERE k <= 3""")
def srt9_closest_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select(F.col("p_type").alias("term")).distinct()
    values = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value")).distinct()
    similarity = 1 - F.levenshtein(F.lower("value"), F.lower("term")) / F.greatest(F.length("value"), F.length("term"))
    rows = values.crossJoin(J.broadcast_if_small(terms)).select("value", "term", similarity.alias("similarity"))  # a code list is short
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("value").orderBy(F.desc("similarity"), "term"))).where("k <= 3").select("value", "term", "similarity")


@query("SELECT DISTINCT part, supp FROM (SELECT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 30 UNION ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45)")
def set1_union_of_streams(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_returnflag", "l_quantity")
    return rows.where("l_returnflag = 'A' AND l_quantity > 30").select("part", "supp").unionByName(rows.where("l_returnflag = 'N' AND l_quantity > 45").select("part", "supp")).distinct()


@query(r"""WITH t AS (SELECT doc_id AS url, string_split_regex(text, '[.!?][ \t\n\f\r]+|\n')[1] AS title FROM documents), o AS (SELECT DISTINCT list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM t WHERE url % 2 = 0), n AS (SELECT url, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM t WHERE url % 2 = 1)
SELECT url FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE len(list_intersect(n.w, o.w)) > 0.8 * len(list_distinct(list_concat(n.w, o.w))))""")
def set7_near_duplicate_articles(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), F.get(T.sentences(F.col("text")), F.lit(0)).alias("title"))
    return near_duplicates_removed(t.where("url % 2 = 1"), t.where("url % 2 = 0"), "url", "title").select("url")


@query("SELECT DISTINCT l_orderkey AS nct, l_suppkey AS section FROM lineitem WHERE l_returnflag = 'N' AND (l_orderkey, l_suppkey) NOT IN (SELECT (l_orderkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'A')")
def set8_already_seeded(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("nct"), F.col("l_suppkey").alias("section"), "l_returnflag")
    return rows.where("l_returnflag = 'N'").select("nct", "section").distinct().join(rows.where("l_returnflag = 'A'"), ["nct", "section"], "left_anti")


@query("SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT), '%Y-%m-%d') AS dtc FROM orders")
def dat1_date_add(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 90).cast("int")), "yyyy-MM-dd").alias("dtc"))


@query("SELECT event_id FROM events WHERE 1706659200 - epoch(ts) <= 168 * 3600")
def dat3_time_to_live(spark, sf_dir):
    from corvane.sources.readers import cached

    rows = table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("fetched_at"))
    return cached(rows, 1706659200).select("event_id")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.text'), json_extract_string(props, '$.k'), props) AS text, json_array_length('[1,2]') AS n FROM events""")
def jsn1_json_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.text"), F.get_json_object("props", "$.k"), "props").alias("text"), F.json_array_length(F.lit("[1,2]")).cast("long").alias("n"))


@query("SELECT l_orderkey AS id, CAST(len(list(l_linenumber)) AS BIGINT) AS found, array_to_string(list_transform(range(1, 8), lambda k: CASE WHEN k <= count(*) THEN 'x' ELSE '-' END), '') AS flags FROM lineitem GROUP BY 1")
def arr1_padded_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.lit("x")).alias("f"))
    return rows.select("id", F.size("f").cast("long").alias("found"), F.array_join(P.padded("f", 7, "-"), "").alias("flags"))


@query("SELECT DISTINCT l_suppkey AS assessment, CASE WHEN l_suppkey % 3 = 0 THEN 'lab' ELSE 'visit' END AS assessment_type, l_linenumber AS visit, l_linenumber * 7 AS day FROM lineitem WHERE l_returnflag = 'A'")
def arr3_grid_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("assessment"), F.when(F.col("l_suppkey") % 3 == 0, "lab").otherwise("visit").alias("assessment_type"), F.col("l_linenumber").alias("visit"), (F.col("l_linenumber") * 7).alias("day")).distinct()
    return rows.orderBy("visit", "assessment_type", "assessment")


@query(f"SELECT {ITEM}, round(1800 * l_quantity * 0.000003 + 500 * l_linenumber * 0.000015, 6) AS cost FROM lineitem")
def mth10_cost_estimate(spark, sf_dir):
    return item(spark, sf_dir, F.round(1800 * F.col("l_quantity") * 0.000003 + 500 * F.col("l_linenumber") * 0.000015, 6).alias("cost"))


@query(f"SELECT {ITEM}, CASE WHEN l_discount >= 0.03 THEN least(l_tax * 10 + 0.2, 1.0) ELSE l_tax * 10 END AS score, CASE WHEN l_discount >= 0.03 THEN 'CONFIRMED' ELSE 'DIVERGENT' END AS state FROM lineitem")
def mth7_confirmation_boost(spark, sf_dir):
    seen = F.col("l_discount") >= 0.03
    return item(spark, sf_dir, F.when(seen, F.least(F.col("l_tax") * 10 + 0.2, F.lit(1.0))).otherwise(F.col("l_tax") * 10).alias("score"), F.when(seen, "CONFIRMED").otherwise("DIVERGENT").alias("state"))


@query(f"SELECT {ITEM}, round(0.3 * l_discount * 10 + 0.3 * l_tax * 10 + 0.2 * CASE WHEN l_returnflag = 'A' THEN 0.5 ELSE l_quantity / 50 END + 0.2 * 0.5, 6) AS alignment FROM lineitem")
def mth8_alignment_score(spark, sf_dir):
    temporal = F.when(F.col("l_returnflag") != "A", F.col("l_quantity") / 50)
    return item(spark, sf_dir, F.round(P.alignment(F.col("l_discount") * 10, F.col("l_tax") * 10, temporal, F.lit(None).cast("double")), 6).alias("alignment"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(sqrt(pow(greatest(a.s_suppkey % 10 * 3 - (b.s_suppkey % 10 * 3 + 2), b.s_suppkey % 10 * 3 - (a.s_suppkey % 10 * 3 + 2), 0), 2) + pow(greatest(a.s_suppkey % 7 * 4 - (b.s_suppkey % 7 * 4 + 2), b.s_suppkey % 7 * 4 - (a.s_suppkey % 7 * 4 + 2), 0), 2)), 5) AS dist FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def mth12_rectangle_distance(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey", (F.col("s_suppkey") % 10 * 3).alias("x"), (F.col("s_suppkey") % 7 * 4).alias("y"))
    side = lambda n: s.select("s_nationkey", F.col("k").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    gap = lambda u, v: F.greatest(F.col(u) - (F.col(v) + 2), F.col(v) - (F.col(u) + 2), F.lit(0))
    return side("a").join(side("b"), "s_nationkey").where("a < b").select("a", "b", F.round(F.sqrt(F.pow(gap("xa", "xb"), 2) + F.pow(gap("ya", "yb"), 2)), 5).alias("dist"))


@query("""SELECT c_custkey AS id, ('0x' || left(md5(c_custkey || '|3'), 8))::BIGINT % 100 AS draw, (['low', 'mid', 'high'])[CASE WHEN ('0x' || left(md5(c_custkey || '|4'), 8))::BIGINT % 100 < 50 THEN 1 WHEN ('0x' || left(md5(c_custkey || '|4'), 8))::BIGINT % 100 < 80 THEN 2 ELSE 3 END] AS choice FROM customer""")
def mth13_seeded_draws(spark, sf_dir):
    from corvane.operators.studies import hash_draw

    d = hash_draw(F.col("c_custkey"), 4, 100)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), hash_draw(F.col("c_custkey"), 3, 100).alias("draw"), F.when(d < 50, "low").when(d < 80, "mid").otherwise("high").alias("choice"))


@query("SELECT p_partkey AS id, trim(regexp_replace(p_name || ' (mg)', '\\s*\\((mg|mL|kg)\\)', '', 'g')) AS canonical FROM part")
def data_op7_canonical_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.trim(F.regexp_replace(F.concat("p_name", F.lit(" (mg)")), r"\s*\((mg|mL|kg)\)", "")).alias("canonical"))


@query("WITH t AS (SELECT s_suppkey AS tp, 'V' || s_suppkey % 30 AS name, min(s_suppkey) OVER (PARTITION BY 'V' || s_suppkey % 30) AS kept FROM supplier) SELECT kept, any_value(name) AS name, count(DISTINCT l_partkey) AS activities FROM lineitem JOIN t ON tp = l_suppkey GROUP BY kept")
def data_op5_timepoint_dedup(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("timepoint_id"), F.concat(F.lit("V"), (F.col("s_suppkey") % 30).cast("string")).alias("name"), F.col("s_suppkey").alias("pos"))
    i = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("activity_id"), F.col("l_suppkey").alias("timepoint_id"))
    kept = first_per_key(t, ["name"], ["pos"]).select(F.col("timepoint_id").alias("kept"), "name")
    mapped = J.remapped(i, t, ["name"])
    return mapped.groupBy(F.col("timepoint_id").alias("kept")).agg(F.count("*").alias("activities")).join(kept, "kept").select("kept", "name", "activities")


@query("""WITH i AS (SELECT l_orderkey AS doc, l_partkey AS act, l_linenumber AS visit FROM lineitem WHERE l_returnflag = 'A'), f AS (SELECT DISTINCT l_orderkey AS doc, a.l_partkey AS act, v.l_linenumber AS visit FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) v USING (l_orderkey) WHERE l_orderkey NOT IN (SELECT doc FROM i))
SELECT DISTINCT doc, act, visit, 'table' AS source FROM i UNION ALL SELECT doc, act, visit, 'fallback' FROM f""")
def data_op8_matrix_with_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("act"), F.col("l_linenumber").alias("visit"), "l_returnflag")
    found = rows.where("l_returnflag = 'A'").select("doc", "act", "visit").distinct()
    rest = rows.join(found, "doc", "left_anti")
    full = rest.select("doc", "act").distinct().join(rest.select("doc", "visit").distinct(), "doc")
    return found.withColumn("source", F.lit("table")).unionByName(full.withColumn("source", F.lit("fallback")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'NCT' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') WHEN o_orderkey % 3 = 1 THEN 'P-' || o_custkey ELSE 'unknown' END AS identifier FROM orders")
def data_op10_identifier_coalesce(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("file NCT"), F.lpad(k.cast("string"), 8, "0"), F.lit(".pdf"))).otherwise("file.pdf")
    meta = F.when(k % 3 == 1, F.concat(F.lit("P-"), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.coalesce(F.nullif(F.regexp_extract(name, r"NCT\d{8}", 0), F.lit("")), meta, F.lit("unknown")).alias("identifier"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id FROM r WHERE k = 1")
def data_op18_latest_decision(spark, sf_dir):
    from corvane.sources.readers import latest_per_key

    return latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query("SELECT vec_id AS id, 'gold' AS source FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, 'bootstrap' FROM embeddings WHERE label >= 8")
def data_op21_training_union(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    part = lambda c, s: e.where(c).select(F.col("vec_id").alias("id"), F.lit(s).alias("source"))
    return part("label < 3", "gold").unionByName(part("label >= 8", "bootstrap"))


@query("SELECT a.n AS parent, count(b.n) AS children FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS n FROM part) a LEFT JOIN (SELECT DISTINCT p_size || '.' || p_partkey % 9 AS n FROM part) b ON b.n LIKE a.n || '.%' GROUP BY 1")
def data_op23_section_children(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    children = p.select(F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 9).cast("string")).alias("n")).distinct().withColumn("parent", F.substring_index("n", ".", 1))
    return p.select(F.col("p_size").cast("string").alias("parent")).distinct().join(children, "parent", "left").groupBy("parent").agg(F.count("n").alias("children"))


@query("SELECT s_suppkey AS section, true AS synthetic FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R')")
def data_op24_synthetic_sections(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_returnflag = 'R'").select(F.col("l_suppkey").alias("section"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("section")).join(have, "section", "left_anti").withColumn("synthetic", F.lit(True))


@query("WITH l AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL) SELECT user_id, count(*) AS annotated, count(*) >= 5 AS complete FROM l GROUP BY 1")
def data_op27_annotation_completeness(spark, sf_dir):
    from corvane.sources.readers import latest_per_key

    rows = latest_per_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts")
    return rows.groupBy("user_id").agg(F.count("*").alias("annotated"), (F.count("*") >= 5).alias("complete"))


typed(fil6_boilerplate_headers="line INTEGER", jsn1_json_text="n BIGINT")
