"""Dataset builders, reports, lineage, graph and source operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.vector import cosine, unit
from corvane.operators import joins as J
from corvane.operators import rules as R
from corvane.operators import studies as S
from corvane.operators.analytics import ratio
from corvane.plans.studies import trial_summary
from corvane.plans.windows import VISITS, visits
from corvane.registry import query, table
from corvane.sources import readers


@query("SELECT page_id, 'page' || page_id || '.html' AS path, CASE WHEN html LIKE '%PDF%' AND starts_with(html, '%PDF') THEN 'pdf' WHEN starts_with(lower(html), '<?xml') THEN 'ctr_xml' ELSE 'unknown' END AS format FROM pages")
def src1_format_sniff(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "html")
    return p.select("page_id", "path", readers.sniff(F.encode("html", "UTF-8"), F.col("path")).alias("format"))


@query("SELECT doc_id AS source_registry_id, count(*) AS blocks, count(*) FILTER (regexp_matches(l, '\\|.*\\|')) AS tables FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' GROUP BY 1")
def src2_src7_text_blocks(spark, sf_dir):
    blocks = readers.text_blocks_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    return blocks.groupBy("source_registry_id").agg(F.count("*").alias("blocks"), F.count(F.when(F.col("text").rlike(r"\|.*\|"), 1)).alias("tables"))


@query("SELECT o_orderkey AS page FROM orders ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 6) t ON l_orderkey = o_orderkey")
def src3_fallback_pages(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").where("l_quantity >= 6").select(F.col("l_orderkey").alias("page"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page")).join(have, "page", "left_anti")


@query("SELECT CAST(n_nationkey AS BIGINT) AS source_registry_id, UNNEST([n_name, 'text ' || n_nationkey]) AS text FROM nation")
def src5_xml_blocks(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit('<ODM><ItemDef Name="'), F.col("n_name"), F.lit('"><Description><TranslatedText>text '), F.col("n_nationkey").cast("string"), F.lit("</TranslatedText></Description></ItemDef></ODM>")).alias("x"))
    return readers.xml_blocks(n, "x", "id").select("source_registry_id", "text")


@query("SELECT CAST(n_nationkey AS BIGINT) AS registry_id, n_name AS activity, v AS visit, v <> 'v3' AS scheduled FROM nation, (VALUES ('v1'), ('v2'), ('v3')) t(v)")
def src6_structured_protocols(spark, sf_dir):
    cell = lambda v, s: F.struct(F.lit(v).alias("visit"), F.lit(s).alias("status"))
    doc = F.to_json(F.struct(F.array(F.struct(F.col("n_name").alias("name"), F.array(cell("v1", "Required"), cell("v2", "optional"), cell("v3", "none")).alias("cells"))).alias("activities")))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), doc.alias("j"))
    return readers.m11_tables(n, "j", "id")["instances"].select("registry_id", "activity", "visit", "scheduled")


@query("SELECT event_id AS id, user_id AS run_id, sha256(props) AS sha256 FROM events WHERE user_id = 7 ORDER BY event_id")
def src14_lineage_scan(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.sha2("props", 256).alias("sha256"))
    return readers.lineage_of(log, 7)


@query("SELECT 'NCT' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS nct_id, c_name AS title, c_nationkey AS enrollment FROM customer")
def src17_fil17_registry_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    doc = F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("NCT"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("nctId"), F.col("c_name").alias("briefTitle")).alias("identificationModule"), F.struct(F.struct(F.col("c_nationkey").alias("count")).alias("enrollmentInfo")).alias("designModule")).alias("protocolSection")))
    return c.select(doc.alias("j")).select(*readers.registry_columns("j")).select("nct_id", "title", F.col("enrollment").cast("int").alias("enrollment"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS pmid, p_name AS title, p_type AS abstract FROM part")
def src18_articles(spark, sf_dir):
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    clean = lambda c: F.regexp_replace(c, "[<&]", " ")
    x = F.concat(F.lit("<S><PubmedArticle>"), tag("PMID", F.col("p_partkey").cast("string")), tag("ArticleTitle", clean("p_name")), tag("Abstract", tag("AbstractText", clean("p_type"))), F.lit("</PubmedArticle></S>"))
    return readers.articles(table(spark, sf_dir, "part").select(x.alias("x")), "x")


@query("SELECT '| r_regionkey | r_name |' AS line UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def src25_markdown_export(spark, sf_dir):
    return readers.markdown(table(spark, sf_dir, "region"))


@query("SELECT 'NCT' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS nct_id, '1.' || (c_custkey % 3) AS version FROM customer WHERE c_custkey % 2 = 0")
def src23_manifest(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("/d/NCT"), F.lpad(k.cast("string"), 8, "0"), F.lit("_1."), (k % 3).cast("string"), F.lit(".pdf"))).otherwise("/d/notes.txt")
    return readers.manifest(table(spark, sf_dir, "customer").select(name.alias("path"), F.lit("0" * 64).alias("sha256"))).select("nct_id", "version")


@query("SELECT c_custkey AS id, coalesce(n_name, c_mktsegment) AS place FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 2 = 0 ORDER BY 1")
def src24_catalogue(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf_dir, "customer").join(J.broadcast_if_small(n), "c_nationkey", "left")
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.coalesce("n_name", "c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("place")).orderBy("id")


@query("WITH " + VISITS + ", t AS (SELECT study, row_number() OVER (PARTITION BY study ORDER BY day, visit) AS seq, day FROM v), g AS (SELECT *, lag(seq) OVER (PARTITION BY study ORDER BY day) AS p FROM t) SELECT study, count(*) AS rows, count(*) FILTER (seq <= 0) AS bad FROM g GROUP BY 1")
def val2_sequence_rules(spark, sf_dir):
    from corvane.operators.windows import numbered

    rows = numbered(visits(spark, sf_dir), ["study"], ["day", "visit"])
    return rows.groupBy("study").agg(F.count("*").alias("rows"), F.count(F.when(F.col("seq") <= 0, 1)).alias("bad"))


@query("SELECT v AS variable FROM (VALUES ('STUDYID'), ('DOMAIN'), ('TSSEQ'), ('TSPARMCD'), ('TSVAL'), ('TSVALNF')) t(v) WHERE v NOT IN ('STUDYID', 'DOMAIN', 'TSSEQ', 'TSPARMCD', 'TSVAL')")
def val9_declared_variables(spark, sf_dir):
    have = spark.createDataFrame([(c,) for c in trial_summary(spark, sf_dir).columns], "variable string")
    declared = spark.createDataFrame([(v,) for v in ("STUDYID", "DOMAIN", "TSSEQ", "TSPARMCD", "TSVAL", "TSVALNF")], "variable string")
    return declared.join(have, "variable", "left_anti")


@query("SELECT d AS domain, d IN (SELECT DISTINCT l_returnflag FROM lineitem) AS present FROM (VALUES ('A'), ('N'), ('R'), ('X')) t(d)")
def val10_required_domains(spark, sf_dir):
    return R.completeness(table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "N", "R", "X"]).withColumnRenamed("parameter", "domain")


@query("SELECT l_returnflag AS domain, count(*) || ' rows, ' || count(DISTINCT l_partkey) || ' items' AS line FROM lineitem GROUP BY 1")
def val11_report_lines(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("domain")).agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("p"))
    return g.select("domain", F.concat(F.col("n").cast("string"), F.lit(" rows, "), F.col("p").cast("string"), F.lit(" items")).alias("line"))


@query("SELECT l_suppkey % 16 AS section, l_returnflag AS source, count(*) AS flows, CASE WHEN avg(l_tax) >= 0.04 THEN 'green' ELSE 'amber' END AS colour FROM lineitem GROUP BY 1, 2")
def val13_lineage_flows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("section"), F.col("l_returnflag").alias("source")).agg(F.count("*").alias("flows"), F.when(F.avg("l_tax") >= 0.04, "green").otherwise("amber").alias("colour"))


@query("SELECT coalesce(a.k, b.k) AS section, a.t AS mapped, b.t AS hits FROM (SELECT l_suppkey AS k, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS t FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS t FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1) b ON a.k = b.k")
def val14_side_by_side(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    side = lambda f, n: rows.where(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("section")).agg(F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias(n))
    return side("A", "mapped").join(side("R", "hits"), "section", "full_outer")


@query("WITH e AS (SELECT s_suppkey AS id, s_acctbal AS w, s_suppkey % 50 + 5 AS h FROM supplier) SELECT id, CASE WHEN w / h BETWEEN 0.5 AND 20 AND w >= 20 THEN 'rect' WHEN w < 0 THEN 'line' ELSE 'other' END AS shape FROM e")
def gr2_shapes(spark, sf_dir):
    w, h = F.col("s_acctbal"), F.col("s_suppkey") % 50 + 5
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when((w / h).between(0.5, 20) & (w >= 20), "rect").when(w < 0, "line").otherwise("other").alias("shape"))


@query("SELECT conv_id AS page, 't' || turn AS node, 'text' AS kind FROM conversations UNION ALL SELECT conv_id, 'r' || role, 'table' FROM (SELECT DISTINCT conv_id, role FROM conversations)")
def gr3_layout_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = c.select(F.col("conv_id").alias("page"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("node"), F.lit("text").alias("kind"))
    return text.unionByName(c.select(F.col("conv_id").alias("page"), F.concat(F.lit("r"), "role").alias("node"), F.lit("table").alias("kind")).distinct())


@query("SELECT e.vec_id, coalesce(CASE WHEN e.vec_id % 4 = 0 THEN 100 + e.label END, e.label) AS label FROM embeddings e")
def gr5_apply_pseudo_labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = e.where("vec_id % 4 = 0").select("vec_id", (F.col("label") + 100).alias("new"))
    return e.join(new, "vec_id", "left").select("vec_id", F.coalesce("new", "label").alias("label"))


@query(None)
def gr7_text_encoder(spark, sf_dir):
    from corvane.operators.encoder import fit_encoder

    d = table(spark, sf_dir, "documents")
    found = fit_encoder(d, "text").encode(J.spread(d.select("doc_id", "text")), "text", "v")
    return found.select("doc_id", F.size("v").cast("long").alias("dims"), F.transform(F.slice("v", 1, 4), lambda x: F.round(x, 4)).alias("head"))


@query(None)
def gr11_window_classifier(spark, sf_dir):
    from corvane.operators import encoder as E
    from corvane.operators.studies import _cut

    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    base = E.fit_encoder(d, "text")
    # each window is encoded once, whether it is learnt from or not
    windows = _cut(E.encoded(base, d, "text"))
    learnt = windows.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    model = E.classifier_by(learnt, "lang", base)
    found = E.sections(model.classified(windows.drop("lang")), "doc_id")
    return found.select("doc_id", "label", F.round("confidence", 4).alias("confidence"), "windows", F.col("at").cast("long").alias("at"), F.col("until").cast("long").alias("until"))


@query(None)
def gr8_tuned_encoder(spark, sf_dir):
    """Mean similarity of documents of one language and of two, before and after tuning on the other documents."""
    from corvane.operators import encoder as E
    from corvane.operators.studies import _cut
    from corvane.operators.vectors import label_similarity

    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    base = E.fit_encoder(d, "text")
    # each text is encoded once, whatever reads its vector
    vectors = _cut(base.encode(J.spread(d.withColumn("held", held).select("lang", "held", "text")), "text", "v").drop("text"))
    asked = vectors.where("held")
    model = E.tuned_by(base, vectors.where("NOT held"), "v", "lang")
    parts = [label_similarity(rows, "lang", "v").withColumn("tuned", F.lit(name)) for name, rows in ((False, asked), (True, _cut(model.turned(asked, "v"))))]
    return parts[0].unionByName(parts[1]).select("tuned", "same", "pairs", F.round("mean", 4).alias("mean"))


@query("SELECT label, count(*) * (count(*) - 1) // 2 AS pairs FROM embeddings GROUP BY 1")
def gr8_pair_counts(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.floor(n * (n - 1) / 2).cast("long").alias("pairs"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN 'en' WHEN contains(lower(text), 'eau') THEN 'fr' ELSE 'other' END AS weak, lang FROM documents")
def gr12_weak_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_keyword(F.col("text"), [("the", "en"), ("eau", "fr")], "other").alias("weak"), "lang")


@query(r"""WITH b AS (SELECT DISTINCT trim(regexp_replace(lower(text), '[ \t\n\f\r]+', ' ', 'g')) AS o FROM benchmark), s AS (SELECT doc_id, UNNEST(string_split_regex(text, '[.!?][ \t\n\f\r]+|\n')) AS x FROM documents), n AS (SELECT doc_id, trim(regexp_replace(lower(x), '[ \t\n\f\r]+', ' ', 'g')) AS x FROM s),
h AS (SELECT DISTINCT left(x, 60) AS head FROM n WHERE length(x) >= 20), o AS (SELECT DISTINCT head FROM h JOIN b ON contains(o, head)),
f AS (SELECT doc_id, sum(CASE WHEN head IS NOT NULL THEN length(x) ELSE 0 END) / sum(length(x)) AS share FROM n LEFT JOIN o ON head = left(x, 60) WHERE length(x) >= 20 GROUP BY 1) SELECT d.doc_id, coalesce(share, 1.0) AS fidelity FROM documents d LEFT JOIN f USING (doc_id)""")
def gr19_fidelity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(T.sentences(F.coalesce("text", F.lit(""))), T.one_line).alias("said"))
    return J.fidelity(d, "doc_id", "said", table(spark, sf_dir, "benchmark").select(T.one_line(F.col("text")).alias("original")), "original")


@query("SELECT l_orderkey AS study, l_suppkey AS element, l_linenumber AS visitnum, CASE WHEN l_returnflag = 'A' THEN 'LB' ELSE 'VS' END AS domain FROM lineitem WHERE l_quantity > 45")
def sd4_cell_matrix(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("study"), F.col("l_suppkey").alias("element"), F.col("l_linenumber").alias("visitnum"), F.when(F.col("l_returnflag") == "A", "LB").otherwise("VS").alias("domain"))


@query("SELECT doc_id, list_filter(['tion', 'eau', 'ung', 'ción'], lambda k: contains(lower(text), k)) AS categories FROM documents")
def sd5_history_categories(spark, sf_dir):
    words = F.array(*map(F.lit, ("tion", "eau", "ung", "ción")))
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(words, lambda k: F.contains(F.lower("text"), k)).alias("categories"))


@query("SELECT c_custkey AS id, 'IE' || lpad(CAST(k AS VARCHAR), 3, '0') || CASE WHEN k % 2 = 0 THEN 'I' ELSE 'E' END AS code FROM customer, (SELECT UNNEST(range(1, 4)) AS k)")
def sd6_criteria_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    return rows.select("id", F.concat(F.lit("IE"), F.lpad(F.col("k").cast("string"), 3, "0"), F.when(F.col("k") % 2 == 0, "I").otherwise("E")).alias("code"))


@query("SELECT p_partkey AS id, CASE WHEN contains(lower(p_type), 'tin') THEN 'BLOOD' WHEN contains(lower(p_type), 'copper') THEN 'URINE' ELSE 'NONE' END AS specimen, left(upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')), 8) AS testcd FROM part")
def sd7_test_codes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.first_keyword(F.col("p_type"), [("tin", "BLOOD"), ("copper", "URINE")], "NONE").alias("specimen"), F.left(F.upper(F.regexp_replace("p_type", "[^A-Za-z]", "")), F.lit(8)).alias("testcd"))


@query("SELECT c_custkey AS id, (['LOW', 'NORMAL', 'HIGH'])[('0x' || left(md5(c_custkey || '|21'), 8))::BIGINT % 3 + 1] AS code, CAST(10 + ('0x' || left(md5(c_custkey || '|22'), 8))::BIGINT % 91 AS BIGINT) AS value FROM customer")
def sd9_mock_rows(spark, sf_dir):
    k = F.col("c_custkey")
    codes = F.array(*map(F.lit, ("LOW", "NORMAL", "HIGH")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.element_at(codes, (S.hash_draw(k, 21, 3) + 1).cast("int")).alias("code"), (S.hash_draw(k, 22, 91) + 10).alias("value"))


@query(None)
def sd9_copula_rows(spark, sf_dir):
    from corvane.operators import copula

    item = table(spark, sf_dir, "lineitem")
    model = copula.fit(item, ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"])
    return model.rows(spark, item.count(), "mock rows")


@query("SELECT * FROM (VALUES ('STUDYID', 'not_null', NULL), ('SEX', 'in_set', 'F,M'), ('AGE', 'between', '18,90')) t(variable, expectation, argument)")
def sd10_expectation_suite(spark, sf_dir):
    spec = spark.createDataFrame([("STUDYID", "Req", None, None, None), ("SEX", "Exp", "F,M", None, None), ("AGE", "Exp", None, 18, 90)], "variable string, core string, codelist string, low int, high int")
    kind = F.when(F.col("codelist").isNotNull(), "in_set").when(F.col("low").isNotNull(), "between").otherwise("not_null")
    return spec.select("variable", kind.alias("expectation"), F.coalesce("codelist", F.when(F.col("low").isNotNull(), F.concat_ws(",", "low", "high"))).alias("argument"))


@query("SELECT DISTINCT p_partkey AS id, 1 AS source FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, 2 FROM part WHERE p_size BETWEEN 5 AND 20 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def data_op11_enrichment_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    one = p.where("p_size < 10").select("id").distinct()
    two = p.where("p_size BETWEEN 5 AND 20").select("id").join(one, "id", "left_anti")
    return one.withColumn("source", F.lit(1)).unionByName(two.withColumn("source", F.lit(2)))


@query("WITH c AS (SELECT o_orderkey AS doc, CASE WHEN o_totalprice > 300000 THEN 'full' WHEN o_totalprice > 150000 THEN 'partial' ELSE 'none' END AS verdict, o_totalprice / 500000 AS conf FROM orders) SELECT doc, verdict, conf < 0.7 AS queued FROM c WHERE verdict <> 'none'")
def data_op17_section_service(spark, sf_dir):
    p = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.when(p > 300000, "full").when(p > 150000, "partial").otherwise("none").alias("verdict"), (p / 500000).alias("conf"))
    return rows.where("verdict <> 'none'").select("doc", "verdict", (F.col("conf") < 0.7).alias("queued"))


@query("SELECT event_type AS header, user_id % 5 AS corrected, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL")
def data_op19_feedback(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("header"), (F.col("user_id") % 5).alias("corrected")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query("SELECT doc_id, quality FROM documents SEMI JOIN labels USING (doc_id) JOIN labels USING (doc_id)")
def data_op22_linkable_documents(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").select("doc_id").join(l, "doc_id")


@query("WITH c AS (SELECT conv_id AS run, turn AS stage, sha256(text) AS artifact FROM conversations) SELECT run, stage, artifact, coalesce(lag(artifact) OVER (PARTITION BY run ORDER BY stage), 'start') AS source FROM c")
def data_op26_checkpoints(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("stage"), F.sha2("text", 256).alias("artifact"))
    return c.withColumn("source", F.coalesce(F.lag("artifact").over(Window.partitionBy("run").orderBy("stage")), F.lit("start")))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 14, 15)")
def data_op28_knowledge_lookup(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(3, 14, 15)).select("vec_id", "label")


@query("SELECT event_id, CAST(to_json({'k': CAST(json_extract_string(props, '$.k') AS BIGINT)}) AS VARCHAR) AS j, strftime(ts, '%Y-%m') AS month FROM events")
def jsn3_dat2_serialise(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(k.alias("k"))).alias("j"), F.date_format("ts", "yyyy-MM").alias("month"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Phase ' || (p_size % 4 + 1) WHEN 1 THEN '1996-03-13' ELSE '42' END AS value, (['enum', 'date', 'numeric'])[p_size % 3 + 1] AS kind FROM part")
def str11_extractor_dispatch(spark, sf_dir):
    s = F.col("p_size")
    kind = F.when(s % 3 == 0, "enum").when(s % 3 == 1, "date").otherwise("numeric")
    text = F.concat(F.lit("A Phase "), (s % 4 + 1).cast("string"), F.lit(" study of 42 people from 1996-03-13 on."))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), text.alias("text"))
    value = F.when(F.col("kind") == "enum", F.concat(F.lit("Phase "), T.found("text", r"(?i)phase\s+([1-4])", 1))).when(F.col("kind") == "date", T.date_of(F.col("text"))[0]).otherwise(T.found("text", r"of (\d+) people", 1))
    return rows.select("id", value.alias("value"), "kind")


@query(r"""WITH t AS (SELECT conv_id, string_agg(upper(role) || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS x FROM conversations GROUP BY 1), l AS (SELECT conv_id, UNNEST(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM t), w AS (SELECT *, string_split_regex(line, '[ \t]+') AS w FROM l),
h AS (SELECT conv_id, i, line, regexp_matches(line, '^[A-Z][A-Z \t]{3,}$') OR NOT starts_with(line, ' ') AND (regexp_matches(w[1], '^[0-9].*[.)]$') AND regexp_matches(w[1], '^[0-9.)]*$') AND NOT contains(w[1], '..') AND regexp_matches(coalesce(w[2], ''), '^[A-Z]') OR w[1] IN ('Section', 'SECTION', 'Part', 'PART') AND regexp_matches(coalesce(w[2], ''), '^[A-Z0-9]')) AS head FROM w),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS b, max(i) OVER (PARTITION BY conv_id) AS n FROM h), b AS (SELECT conv_id, b, string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) AS block FROM g WHERE b > 0 GROUP BY ALL),
s AS (SELECT conv_id, string_split(list_reduce(list(block ORDER BY b), lambda s, x: CASE WHEN length(string_split(s, chr(1))[-1]) < 500 THEN s || x ELSE s || chr(1) || x END), chr(1)) AS parts FROM b GROUP BY 1)
SELECT conv_id, CASE WHEN len(parts) > 1 AND length(parts[-1]) < 500 THEN len(parts) - 1 ELSE len(parts) END AS blocks, CAST(list_sum([length(y) FOR y IN parts]) AS BIGINT) AS chars FROM s""")
def str21_heading_blocks(spark, sf_dir):
    from corvane.functions.blocks import heading_blocks
    from corvane.plans.matching import conversation_texts

    t = conversation_texts(spark, sf_dir, F.concat(F.upper("role"), F.lit("\n"), F.coalesce("text", F.lit(""))), "\n").select("conv_id", heading_blocks(F.col("text")).alias("b"))
    return t.select("conv_id", F.size("b").cast("long").alias("blocks"), F.aggregate("b", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"))


@query("SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey < 20 GROUP BY ALL")
def str30_diagram_pairs(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    a = i.where("l_partkey < 20").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    return a.join(i.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst")), ["l_orderkey", "l_linenumber"]).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def dat4_date_struct(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    info = F.when(F.col("event_id") % 3 == 1, F.to_json(F.struct(day.alias("date"), F.lit("ACTUAL").alias("type")))).when(F.col("event_id") % 3 == 2, F.to_json(F.struct(day.alias("date")))).otherwise(F.lit("{}"))
    return table(spark, sf_dir, "events").select("event_id", readers.struct_date(info).alias("day"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_orderkey % 4 = 0 THEN count(*) END AS n FROM lineitem GROUP BY l_orderkey, l_linenumber")
def jsn2_list_length(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")).agg(F.collect_list("l_partkey").alias("items"))
    own = F.to_json(F.struct(F.col("items").alias("items")))
    text = F.when(F.col("id") % 4 == 0, own).when(F.col("id") % 4 == 1, F.lit('{"items": "none"}')).when(F.col("id") % 4 == 2, F.lit('{"other": [1]}')).otherwise(F.lit("no json"))
    return rows.select("id", "line", readers.json_list_length(text, "items").alias("n"))


@query("SELECT p_partkey AS id, coalesce(r_name, 'OTHER') AS term FROM part LEFT JOIN region ON r_regionkey = p_partkey % 8")
def map2_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("term"))
    return J.looked_up(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 8).alias("code")), names, "code", "term", "OTHER").select("id", "term")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 1 AND c_custkey % 3 = 1 THEN 'E1' WHEN c_custkey % 2 = 1 THEN 'E2' ELSE 'E3' END AS extraction,
CASE WHEN c_custkey % 11 = 0 THEN 'C5' WHEN c_custkey % 5 > 2 AND c_custkey % 7 > 3 AND c_custkey % 3 = 1 THEN 'C1' WHEN c_custkey % 5 > 2 AND c_custkey % 3 = 1 THEN 'C2' WHEN c_custkey % 3 = 1 THEN 'C3' WHEN c_custkey % 5 > 2 THEN 'C4' ELSE 'C5' END AS classification FROM customer""")
def val16_levels(spark, sf_dir):
    k = F.col("c_custkey")
    has = {"layout": k % 2 == 1, "vision": k % 3 == 1, "model": k % 5 > 2, "index": k % 7 > 3, "language": k % 3 == 1}
    return table(spark, sf_dir, "customer").select(k.alias("id"), R.best_level(R.EXTRACTION_LEVELS, has).alias("extraction"), R.best_level(R.CLASSIFICATION_LEVELS, has, F.when(k % 11 == 0, "C5")).alias("classification"))


@query("""WITH a AS (SELECT l_suppkey AS visit, min(l_linenumber) AS day, min(l_tax) AS early, count(*) AS n, max(l_returnflag) AS status FROM lineitem WHERE l_orderkey % 2 = 0 AND l_suppkey % 9 <> 0 GROUP BY 1), b AS (SELECT l_suppkey AS visit, min(l_linenumber) AS day, min(l_tax) AS early, count(*) AS n, max(l_returnflag) AS status FROM lineitem WHERE l_orderkey % 2 = 1 AND l_suppkey % 7 <> 0 GROUP BY 1),
j AS (SELECT coalesce(a.visit, b.visit) AS visit, a.visit IS NULL AS added, b.visit IS NULL AS removed, a.day AS da, b.day AS db, a.early AS ea, b.early AS eb, a.n AS na, b.n AS nb, a.status AS sa, b.status AS sb FROM a FULL JOIN b ON a.visit = b.visit)
SELECT visit, 1 AS part, CASE WHEN added THEN 'added' ELSE 'removed' END AS change FROM j WHERE added OR removed UNION ALL SELECT visit, 2, 'timing' FROM j WHERE NOT added AND NOT removed AND da IS DISTINCT FROM db UNION ALL SELECT visit, 3, 'window' FROM j WHERE NOT added AND NOT removed AND ea IS DISTINCT FROM eb
UNION ALL SELECT visit, 4, 'assessments' FROM j WHERE NOT added AND NOT removed AND na IS DISTINCT FROM nb UNION ALL SELECT visit, 5, 'status' FROM j WHERE NOT added AND NOT removed AND sa IS DISTINCT FROM sb""")
def data_op25_amendment_diff(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    side = lambda r, m: item.where((F.col("l_orderkey") % 2 == r) & (F.col("l_suppkey") % m != 0)).groupBy(F.col("l_suppkey").alias("visit")).agg(F.min("l_linenumber").alias("day"), F.min("l_tax").alias("early"), F.count("*").alias("n"), F.max("l_returnflag").alias("status"))
    parts = [("timing", ["day"]), ("window", ["early"]), ("assessments", ["n"]), ("status", ["status"])]
    return J.amendment(side(0, 9), side(1, 7), "visit", parts)


_INDEXED = "SELECT vec_id, label, embedding FROM embeddings WHERE label % 5 <> 0"


@query("WITH i AS (" + _INDEXED + """), p AS (SELECT a.vec_id AS query, b.vec_id AS idx, b.label, list_sum(list_transform(range(1, 65), lambda k: CAST(a.embedding[k] AS DOUBLE) * CAST(b.embedding[k] AS DOUBLE))) AS s FROM embeddings a JOIN i b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, idx) AS rank FROM p) SELECT query, idx, CAST(label AS VARCHAR) AS section_code, round(s, 4) AS similarity, rank FROM r WHERE rank <= 5""")
def gr6_src22_index(spark, sf_dir):
    from corvane.operators import neighbour_index as N
    from corvane.operators import vectors as O

    e = table(spark, sf_dir, "embeddings").withColumn("section_code", F.col("label").cast("string")).withColumn("confidence_score", (F.col("label") % 5).cast("double") / 4).withColumn("source", F.lit("registry"))
    kept = O.indexable(e, "vec_id", "embedding", 0.2)
    path, grown = S.shared_path(spark, "index"), S.shared_path(spark, "index")
    N.build(kept.where("vec_id % 2 = 0"), "vec_id", "embedding").save(path)
    # what the index holds stays, the rest is added
    N.load(spark, path).add(kept, "vec_id", "embedding").tuned(5).save(grown)
    found = O.search_sections(N.load(spark, grown), e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, exact=True)
    return found.select("query", "idx", "section_code", F.round("similarity", 4).alias("similarity"), "rank")
