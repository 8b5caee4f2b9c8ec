"""Round trips through the persistent tables: each query writes to the shared folder and reads back under the declared schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators.studies import shared_path
from corvane.registry import query, table
from corvane.sources import readers


@query("SELECT 'NCT' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS registry_id, 'B.' || (doc_id % 16 + 1) AS section_code, CAST(n_chars % 100 AS FLOAT) / 100 AS confidence_score, n_chars % 100 < 70 AS review_required, text AS content_text FROM documents")
def src8_sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = (F.col("n_chars") % 100).cast("float") / 100
    rows = d.select(
        F.lit("run").alias("run_id"), F.lit("source").alias("source_run_id"), F.sha2("text", 256).alias("source_sha256"), F.concat(F.lit("NCT"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("registry_id"), F.concat(F.lit("B."), (F.col("doc_id") % 16 + 1).cast("string")).alias("section_code"),
        F.lit("Section").alias("section_name"), F.lit("{}").alias("content_json"), c.cast("float").alias("confidence_score"), (F.col("n_chars") % 100 < 70).alias("review_required"), F.lit(False).alias("legacy_format"), F.lit("2024-01-01T00:00:00Z").alias("extraction_timestamp_utc"), F.col("text").alias("content_text"),
    )
    path = shared_path(spark, "sections")
    readers.write_declared(readers.checked_sections(rows), path, readers.SECTIONS)
    return readers.declared(spark, path, readers.SECTIONS).select("registry_id", "section_code", "confidence_score", "review_required", "content_text")


@query("""WITH e AS (SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, CAST(r_regionkey AS BIGINT) AS pos FROM region), t AS (SELECT CAST(s_suppkey AS VARCHAR), s_name, s_suppkey * 7 FROM supplier), a AS (SELECT CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS BIGINT) FROM nation),
i AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber, CAST(l_partkey AS VARCHAR), CAST(count(*) AS BIGINT) FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber), s AS (SELECT p_name || p_partkey, p_type, p_partkey FROM part)
SELECT 'epochs' AS entity, * FROM e UNION ALL SELECT 'timepoints', * FROM t UNION ALL SELECT 'activities', * FROM a UNION ALL SELECT 'instances', * FROM i UNION ALL SELECT 'synonyms', * FROM s""")
def src9_study_design_tables(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    head = [F.lit("run").alias("run_id"), F.lit("NCT").alias("registry_id")]
    t = {n: table(spark, sf_dir, n) for n in ("region", "supplier", "nation", "lineitem", "part")}
    item = t["lineitem"].groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    made = {
        "epochs": (readers.EPOCHS, t["region"].select(*head, text("r_regionkey").alias("epoch_id"), F.col("r_name").alias("epoch_name"), F.lit("Treatment").alias("epoch_type"), F.col("r_regionkey").alias("epoch_order")), ("epoch_id", "epoch_name", "epoch_order")),
        "timepoints": (readers.TIMEPOINTS, _wide(t["supplier"].select(*head, text("s_suppkey").alias("timepoint_id"), F.col("s_name").alias("visit_name"), (F.col("s_suppkey") * 7).alias("day_offset")), readers.TIMEPOINTS), ("timepoint_id", "visit_name", "day_offset")),
        "activities": (readers.ACTIVITIES, t["nation"].select(*head, text("n_nationkey").alias("activity_id"), F.col("n_name").alias("activity_name"), text("n_regionkey").alias("activity_type")), ("activity_id", "activity_name", "activity_type")),
        "instances": (readers.INSTANCES, item.select(*head, F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("instance_id"), text("l_partkey").alias("activity_id"), text("n").alias("timepoint_id"), F.lit(True).alias("scheduled")), ("instance_id", "activity_id", "timepoint_id")),
        "synonyms": (readers.SYNONYMS, _wide(t["part"].select(*head, F.concat("p_name", "p_partkey").alias("original_text"), F.col("p_type").alias("canonical_label"), text("p_partkey").alias("method")), readers.SYNONYMS), ("original_text", "canonical_label", "method")),
    }
    out = None
    for entity, (schema, rows, (a, b, c)) in made.items():
        path = shared_path(spark, entity)
        readers.write_declared(rows, path, schema)
        back = readers.declared(spark, path, schema).select(F.lit(entity).alias("entity"), F.col(a).alias("id"), F.col(b).alias("name"), F.col(c).cast("long").alias("pos"))
        out = back if out is None else out.unionByName(back)
    return out


def _wide(rows, schema):
    """Rows with all columns of a schema; those that they lack are null."""
    from pyspark.sql.types import StructType

    return rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields if f.name not in rows.columns))


@query("""SELECT UNNEST(['n_nationkey', 'n_name', 'n_regionkey']) AS variable, UNNEST(['integer', 'text', 'integer']) AS kind, CAST(UNNEST([1, 2, 3]) AS BIGINT) AS pos""")
def src11_define_xml(spark, sf_dir):
    xml = readers.define_xml(table(spark, sf_dir, "nation"), "NA")
    rows = spark.createDataFrame([(f"<d>{xml}</d>",)], "x string")
    of = lambda path: F.xpath("x", F.lit(path))
    both = F.arrays_zip(of("//ItemDef/@Name").alias("variable"), of("//ItemDef/@DataType").alias("kind"), of("//ItemRef/@OrderNumber").alias("pos"))
    return rows.select(F.inline(both)).select("variable", "kind", F.col("pos").cast("long").alias("pos"))


@query("SELECT 'run' AS run_id, CAST(page_id AS VARCHAR) AS name, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS size FROM pages")
def src12_artifacts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.col("html").cast("binary").alias("content"))
    path, log = shared_path(spark, "artifacts"), shared_path(spark, "lineage")
    readers.append_log(readers.put_artifacts(rows, path, "run"), log)
    return readers.json_lines(spark, log, "run_id string, name string, sha256 string, size long")


@query("SELECT doc_id AS id, lang AS section_code, length(text) AS chars FROM documents")
def src20_gold_corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = shared_path(spark, "corpus")
    good = d.select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("lang").alias("section_code"), "text")).alias("value"))
    good.unionByName(d.select(F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "text"')).alias("value"))).write.text(path)
    return readers.json_lines(spark, path, "id long, section_code string, text string").select("id", "section_code", F.length("text").cast("long").alias("chars"))


@query("SELECT 'q' || p_partkey AS query_id, p_type AS section_id, CAST(p_size AS BIGINT) AS priority, p_size > 25 AS required FROM part")
def src21_query_dims(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query_id"), F.col("p_type").alias("section_id"), F.col("p_size").cast("long").alias("priority"), (F.col("p_size") > 25).alias("required"))
    path = shared_path(spark, "queries")
    readers.export(rows, path, "json")
    return readers.dims(spark, path, "query_id string, section_id string, priority long, required boolean", ["query_id", "section_id"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS nct_id, c_name AS title, c_mktsegment AS status FROM customer")
def src26_csv_index(spark, sf_dir):
    path = shared_path(spark, "index-csv")
    readers.export(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("status"), F.col("c_name").alias("title"), F.col("c_custkey").alias("nct_id")), path, "csv", ["nct_id", "title", "status"])
    return spark.read.option("header", True).csv(path)


@query("SELECT event_id AS id, event_type AS action, CAST(user_id AS VARCHAR) AS user_id FROM events UNION ALL SELECT event_id, 'review', CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'click'")
def src27_audit_log(spark, sf_dir):
    path = shared_path(spark, "audit")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("user_id"))
    readers.append_log(e, path)
    readers.append_log(e.where("action = 'click'").withColumn("action", F.lit("review")), path)
    return readers.json_lines(spark, path, "id long, action string, user_id string")


@query("SELECT vec_id, label, round(list_sum(list_transform(range(1, 65), lambda k: CAST(embedding[k] AS DOUBLE) * CAST(embedding[65 - k] AS DOUBLE))) / list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS similarity FROM embeddings")
def mth2_cosine(spark, sf_dir):
    from corvane.functions.vector import cosine

    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(cosine("embedding", F.reverse("embedding")), 5).alias("similarity"))


@query("SELECT 'ST' || (o_custkey % 40) AS STUDYID, 'TS' AS DOMAIN, CAST(o_orderkey AS DOUBLE) AS TSSEQ, o_orderpriority AS TSPARM, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice * (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) END AS TSVAL FROM orders")
def src10_transport(spark, sf_dir):
    from corvane.sources import transport

    k = F.col("o_orderkey")
    value = F.when(k % 7 != 0, F.col("o_totalprice") * F.when(k % 2 == 0, 1).otherwise(-1))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("ST"), (F.col("o_custkey") % 40).cast("string")).alias("STUDYID"), F.lit("TS").alias("DOMAIN"), k.cast("double").alias("TSSEQ"), F.col("o_orderpriority").alias("TSPARM"), value.alias("TSVAL"))
    path = shared_path(spark, "transport")
    transport.transport_files(rows, "STUDYID", "TS", ["TSSEQ"], "Trial Summary").write.parquet(path)
    return transport.transport_rows(spark.read.parquet(path), "STUDYID string, DOMAIN string, TSSEQ double, TSPARM string, TSVAL double")


@query("""WITH p AS (SELECT CAST(page_id AS VARCHAR) AS key, page_id, coalesce(html, '') AS html FROM pages) SELECT key, CAST(1 AS BIGINT) AS version, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS size, page_id % 3 = 0 AS immutable FROM p
UNION ALL SELECT key, 2, sha256(html || ' again'), strlen(html) + 6, false FROM p WHERE page_id % 3 = 1""")
def src12_versions(spark, sf_dir):
    from corvane.sources.artifacts import ArtifactStore

    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("key"), "page_id", F.coalesce("html", F.lit("")).alias("html"), F.lit("text/html").alias("content_type"))
    store = ArtifactStore(spark, shared_path(spark, "artifacts"))
    store.put(p.select("key", F.col("html").cast("binary").alias("content"), "content_type", (F.col("page_id") % 3 == 0).alias("immutable")), "first", "reader")
    # keys divisible by 3 are immutable and stay as they are
    again = p.where("page_id % 3 <> 2").select("key", F.concat("html", F.lit(" again")).cast("binary").alias("content"), "content_type", F.lit(False).alias("immutable"))
    store.put(again, "second", "reader", skip_refused=True)
    return store.lineage().select("key", "version", "sha256", "size", "immutable")


def _of_flag(rows):
    return rows.where("l_returnflag <> 'N'").select("l_suppkey", "l_quantity")


def _per_supplier(rows):
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("items"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("SELECT l_suppkey, count(*) AS items, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def src28_stages(spark, sf_dir):
    from corvane.operators.stages import Stages

    stages = Stages(spark, shared_path(spark, "stages"))
    rows = table(spark, sf_dir, "lineitem")
    stages.run([("flag", _of_flag)], rows)
    # the first stage is committed by now, so only the second one runs
    return stages.run([("flag", _of_flag), ("supplier", _per_supplier)], rows)


@query("""WITH e AS (SELECT user_id, event_type, event_id, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM e) SELECT user_id, event_type, event_id, ts FROM r WHERE k = 1""")
def data_op27_upsert(spark, sf_dir):
    from corvane.operators.stages import create_keyed, upsert

    key = ["user_id", "event_type"]
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", F.struct("ts", "event_id").alias("at"))
    last = lambda rows: rows.groupBy(*key).agg(F.max_by(F.struct("event_id", "ts", "at"), "at").alias("s")).select(*key, "s.*")
    path = shared_path(spark, "annotations")
    create_keyed(last(e.where("event_id % 2 = 0")), path, key)
    upsert(e.where("event_id % 2 = 1"), path, key, "at")
    return spark.read.parquet(path).select(*key, "event_id", "ts")


@query("""SELECT 'ORDERS' AS domain, 'o_orderstatus' AS variable, o_orderstatus AS item FROM orders GROUP BY ALL UNION ALL SELECT 'ORDERS', 'o_orderpriority', o_orderpriority FROM orders GROUP BY ALL UNION ALL SELECT 'ITEMS', 'l_returnflag', l_returnflag FROM lineitem GROUP BY ALL""")
def src11_code_lists(spark, sf_dir):
    from corvane.sources import define_xml as X

    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lists = X.code_lists(orders, "ORDERS", ["o_orderstatus", "o_orderpriority"]) | X.code_lists(items, "ITEMS", ["l_returnflag"])
    xml = X.to_xml({"ORDERS": orders.schema, "ITEMS": items.schema}, "ST", lists)
    docs = spark.createDataFrame([("d", xml)], "doc string, xml string")
    held = X.variables(docs, "doc", "xml").where("code_list IS NOT NULL").select("doc", "domain", "variable", "code_list")
    return held.join(X.list_items(docs, "doc", "xml"), ["doc", "code_list"]).select("domain", "variable", "item")


@query("SELECT CAST(o_orderkey AS DOUBLE) AS TSSEQ, o_orderpriority AS TSPARM, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS TSVAL FROM orders")
def src10_transport_source(spark, sf_dir):
    from corvane.sources import xport

    xport.register(spark)
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.cast("double").alias("TSSEQ"), F.col("o_orderpriority").alias("TSPARM"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("TSVAL"))
    path = shared_path(spark, "xport")
    rows.write.format("xport").option("dataset", "TS").option("textWidth", 40).mode("append").save(path)
    return spark.read.format("xport").load(path)
