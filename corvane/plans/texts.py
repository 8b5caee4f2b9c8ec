"""Text operators over documents, pages, conversations and labels made of orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.sets import jaccard
from corvane.registry import query, table, typed

LABELS = """lab AS (SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'Cycle ' || (o_orderkey % 6 + 1) || ' Day ' || (o_orderkey % 21 + 1) WHEN 1 THEN 'Day ' || (o_orderkey % 90) WHEN 2 THEN 'Week ' || (o_orderkey % 52 + 1) WHEN 3 THEN 'Month ' || (o_orderkey % 12 + 1)
 WHEN 4 THEN 'Screening' WHEN 5 THEN 'Baseline' WHEN 6 THEN 'End of treatment' WHEN 7 THEN 'Follow-up visit' WHEN 8 THEN 'Cycle ' || (o_orderkey % 6 + 1) ELSE 'Unscheduled' END AS label, o_custkey AS doc FROM orders) """


def labels(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    text = (
        F.when(k % 10 == 0, F.concat(F.lit("Cycle "), s(k % 6 + 1), F.lit(" Day "), s(k % 21 + 1))).when(k % 10 == 1, F.concat(F.lit("Day "), s(k % 90))).when(k % 10 == 2, F.concat(F.lit("Week "), s(k % 52 + 1))).when(k % 10 == 3, F.concat(F.lit("Month "), s(k % 12 + 1)))
        .when(k % 10 == 4, "Screening").when(k % 10 == 5, "Baseline").when(k % 10 == 6, "End of treatment").when(k % 10 == 7, "Follow-up visit").when(k % 10 == 8, F.concat(F.lit("Cycle "), s(k % 6 + 1))).otherwise("Unscheduled")
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("label"), F.col("o_custkey").alias("doc"))


@query("WITH " + LABELS + """SELECT id, label, CAST(CASE WHEN id % 10 = 0 THEN (id % 6) * 21 + id % 21 + 1 WHEN id % 10 = 1 THEN id % 90 WHEN id % 10 = 2 THEN (id % 52) * 7 + 1 WHEN id % 10 = 3 THEN (id % 12) * 30 + 1 WHEN id % 10 = 4 THEN -14 WHEN id % 10 = 5 THEN 1 WHEN id % 10 = 8 THEN (id % 6) * 21 + 1 ELSE 0 END AS BIGINT) AS day,
 (['cycle_day', 'explicit_day', 'week', 'month', 'screening', 'baseline', 'eot', 'follow_up', 'cycle_only', 'unresolved'])[id % 10 + 1] AS method, ([0.95, 1.0, 0.9, 0.8, 1.0, 1.0, 0.7, 0.7, 0.85, 0.0])[id % 10 + 1] AS confidence FROM lab""")
def str26_visit_day(spark, sf_dir):
    return labels(spark, sf_dir).select("id", "label", T.visit_day(F.col("label")).alias("v")).select("id", "label", "v.day", "v.method", "v.confidence")


@query("WITH " + LABELS + """, d AS (SELECT doc, id, label, CAST(CASE WHEN id % 10 = 0 THEN (id % 6) * 28 + id % 21 + 1 WHEN id % 10 = 1 THEN id % 90 WHEN id % 10 = 2 THEN (id % 52) * 7 + 1 WHEN id % 10 = 3 THEN (id % 12) * 30 + 1 WHEN id % 10 = 4 THEN -14 WHEN id % 10 = 5 THEN 1 WHEN id % 10 = 8 THEN (id % 6) * 28 + 1 ELSE 0 END AS BIGINT) AS day FROM lab),
t AS (SELECT *, coalesce(max(CASE WHEN day > 0 THEN day END) OVER (PARTITION BY doc), 1) AS top FROM d) SELECT doc, id, CASE WHEN id % 10 = 6 THEN top + 1 WHEN id % 10 = 7 THEN top + 30 ELSE day END AS day FROM t""")
def data_op9_timepoint_days(spark, sf_dir):
    from corvane.operators.windows import milestones

    rows = labels(spark, sf_dir).withColumn("cycle", T.cycle_length(F.lit("given in a 28-day cycle")))
    rows = rows.withColumn("v", T.visit_day(F.col("label"), F.col("cycle"))).select("doc", "id", "cycle", F.col("v.day").alias("day"), F.when(F.col("v.method") == "eot", "EOT").when(F.col("v.method") == "follow_up", "FU").when(F.col("v.method") == "repeating", "REPEAT").alias("kind"))
    return milestones(rows.withColumn("kind", F.coalesce("kind", F.lit("DAY"))), "doc", "kind", "day", "cycle").select("doc", "id", F.col("filled_day").alias("day"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 21 WHEN 1 THEN (o_orderkey % 5 + 1) * 7 WHEN 2 THEN o_orderkey % 30 + 1 ELSE o_orderkey % 40 + 1 END AS cycle FROM orders""")
def str27_cycle_length(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    text = F.when(k % 4 == 0, "no cycle stated").when(k % 4 == 1, F.concat(F.lit("dosed q"), s(k % 5 + 1), F.lit("w"))).when(k % 4 == 2, F.concat(F.lit("given every "), s(k % 30 + 1), F.lit(" days"))).otherwise(F.concat(F.lit("in a "), s(k % 40 + 1), F.lit("-day treatment cycle")))
    return table(spark, sf_dir, "orders").select(k.alias("id"), T.cycle_length(text).alias("cycle"))


CHAIN = [(r"\b\d{16}\b", 0, 0.95), (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0, 0.92), (r"token = \"([0-9a-f]+)\"", 1, 0.85), (r"\+1 \((\d{3})\)", 1, 0.70)]


@query(r"""WITH m AS (SELECT doc_id, regexp_extract(text, '\b\d{16}\b') AS a, regexp_extract(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') AS b, regexp_extract(text, 'token = "([0-9a-f]+)"', 1) AS c, regexp_extract(text, '\+1 \((\d{3})\)', 1) AS d FROM documents)
SELECT doc_id, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN c <> '' THEN c ELSE d END AS value, CASE WHEN a <> '' THEN 0.95 WHEN b <> '' THEN 0.92 WHEN c <> '' THEN 0.85 WHEN d <> '' THEN 0.70 ELSE 0.0 END AS confidence FROM m""")
def str1_identifier_chain(spark, sf_dir):
    value, confidence = T.first_of("text", CHAIN)
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("value"), confidence.alias("confidence"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%B %d, %Y') WHEN 2 THEN strftime(o_orderdate, '%d %B %Y') ELSE '' END AS value, CASE WHEN o_orderkey % 4 = 3 THEN 0.0 ELSE 0.92 END AS confidence FROM orders")
def str2_date(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.concat(F.lit("Signed on "), F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "MMMM dd, yyyy")).when(k % 4 == 2, F.date_format(d, "dd MMMM yyyy")).otherwise("an unknown day"), F.lit(" by both."))
    value, confidence = T.date_of(F.col("text"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text")).select("id", value.alias("value"), confidence.alias("confidence"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 900 + 10 AS VARCHAR) WHEN 1 THEN '80' ELSE CAST(o_orderkey % 40 AS VARCHAR) || ' mg' END AS value, ([0.92, 0.90, 0.75])[o_orderkey % 3 + 1] AS confidence FROM orders")
def str3_numeric(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("a sample size of "), (k % 900 + 10).cast("string"))).when(k % 3 == 1, "with a power of 80 %").otherwise(F.concat(F.lit("dosed at "), (k % 40).cast("string"), F.lit(" mg")))
    value, confidence = T.first_of("text", [(r"(?i)sample\s+size\s*(?:of|is)?\s*(\d[\d,]*)", 1, 0.92), (r"(?i)power\s*(?:of\s+)?(\d+(?:\.\d+)?)", 1, 0.90), (r"\d[\d,]*\.?\d*\s*(?:mg|kg|mL)", 0, 0.75)])
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text")).select("id", value.alias("value"), confidence.alias("confidence"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'Phase ' || (p_size % 4 + 1) WHEN p_size % 3 = 1 THEN 'randomized, open' ELSE '' END AS value FROM part")
def str4_enum(spark, sf_dir):
    s = F.col("p_size")
    text = F.when(s % 3 == 0, F.concat(F.lit("This is a Phase "), (s % 4 + 1).cast("string"), F.lit(" study"))).when(s % 3 == 1, "an open, randomized design").otherwise("neither")
    phase = T.found("text", r"(?i)phase\s+([1-4])", 1)
    words = F.filter(F.array(*map(F.lit, ("randomized", "blind", "open"))), lambda w: F.contains(F.lower("text"), w))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")).select("id", F.coalesce(F.concat(F.lit("Phase "), phase), F.array_join(words, ", ")).alias("value"))


@query(r"""SELECT doc_id, CASE WHEN length(s) > 10 THEN left(s, 300) ELSE left(text, 300) END AS value, CASE WHEN length(s) > 10 THEN 0.65 ELSE 0.50 END AS confidence FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1] AS s FROM documents)""")
def str5_short_text(spark, sf_dir):
    first = F.element_at(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001"), 1)
    long = F.length(first) > 10
    return table(spark, sf_dir, "documents").select("doc_id", F.when(long, F.left(first, F.lit(300))).otherwise(F.left("text", F.lit(300))).alias("value"), F.when(long, 0.65).otherwise(0.50).alias("confidence"))


WORDS = ["the", "tion", "ver", "eau", "ción"]


@query("""SELECT doc_id, len(list_filter(['the', 'tion', 'ver', 'eau', 'ción'], lambda w: contains(lower(text), w))) / 5 AS overlap, CASE WHEN length(text) <= 4000 THEN 'passthrough' ELSE 'relevance_excerpt' END AS method, 0.45 + 0.40 * (len(list_filter(['the', 'tion', 'ver', 'eau', 'ción'], lambda w: contains(lower(text), w))) / 5) AS confidence FROM documents""")
def str6_long_text(spark, sf_dir):
    words = F.array(*map(F.lit, WORDS))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", T.overlap(F.col("text"), words).alias("overlap"))
    return rows.select("doc_id", "overlap", F.when(F.length("text") <= 4000, "passthrough").otherwise("relevance_excerpt").alias("method"), (0.45 + 0.40 * F.col("overlap")).alias("confidence"))


@query(r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\|.*\|'))) AS table_lines, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^[A-Z][a-z]+\.$'))) AS item_lines FROM documents""")
def str7_str8_list_and_table_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.lines_like("text", r"\|.*\|")).cast("long").alias("table_lines"), F.size(T.lines_like("text", r"^[A-Z][a-z]+\.$")).cast("long").alias("item_lines"))


@query(r"""WITH s AS (SELECT doc_id, UNNEST(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS k FROM documents),
c AS (SELECT *, CAST(contains(lower(s), 'the') AS INT) + CAST(contains(lower(s), 'ing') AS INT) + CAST(contains(lower(s), 'ation') AS INT) + CAST(contains(lower(s), 'eau') AS INT) + CAST(contains(lower(s), 'keit') AS INT) AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS n FROM c)
SELECT doc_id, s AS sentence, score, CASE WHEN score >= 3 THEN least(0.92, 0.60 + score * 0.08) ELSE 0.60 + score * 0.08 END AS confidence FROM r WHERE n = 1 AND score > 0""")
def str9_statement(spark, sf_dir):
    best = T.best_sentence(F.col("text"), ["the", "ing", "ation", "eau", "keit"])
    rows = table(spark, sf_dir, "documents").select("doc_id", best.alias("b")).where("b.score > 0")
    return rows.select("doc_id", F.col("b.sentence").alias("sentence"), F.col("b.score").alias("score"), F.least(F.lit(0.92), 0.60 + F.col("b.score") * 0.08).alias("confidence"))


@query("SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda w: w NOT IN ('the', 'and', 'that')))) AS words FROM benchmark")
def str10_query_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(T.keywords("text", ["the", "and", "that"])).alias("words"))


@query("""SELECT l_orderkey AS id, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, round(least(1.0, CASE WHEN l_returnflag = 'A' THEN l_tax * 10 * 0.7 WHEN l_returnflag = 'R' THEN l_tax * 10 * 0.85 ELSE l_tax * 10 END), 4) AS confidence FROM lineitem""")
def str12_penalties(spark, sf_dir):
    c = F.col("l_tax") * 10
    scaled = F.when(F.col("l_returnflag") == "A", c * 0.7).when(F.col("l_returnflag") == "R", c * 0.85).otherwise(c)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"), F.round(F.least(F.lit(1.0), scaled), 4).alias("confidence"))


@query(r"""WITH c AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\|.*\|'))) AS p, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\s*([-*]\s+|\d+[.)]\s+)'))) AS i FROM documents)
SELECT doc_id, CASE WHEN p >= 2 THEN 'table' WHEN i >= 3 AND i >= 0.3 * n THEN 'list' WHEN length(text) < 200 THEN 'text_short' ELSE 'text_long' END AS format, CASE WHEN p >= 2 THEN least(0.95, 0.70 + 0.05 * p) WHEN i >= 3 AND i >= 0.3 * n THEN least(0.92, 0.65 + 0.03 * i) WHEN length(text) < 200 THEN 0.70 ELSE 0.50 END AS confidence FROM c""")
def str13_format_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.format_of(F.col("text")).alias("f")).select("doc_id", "f.format", "f.confidence")


@query("""SELECT doc_id, (2 * CAST(regexp_matches(text, '[Tt]he [a-z]+tion') AS INT) + 2 * CAST(regexp_matches(text, '[0-9]{4}') AS INT) + CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'eau') AS INT) + CAST(contains(lower(text), 'ung') AS INT)) / 7 AS score FROM documents""")
def str18_block_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.pattern_score(F.col("text"), ["[Tt]he [a-z]+tion", "[0-9]{4}"], ["the", "eau", "ung"]).alias("score"))


@query(r"""SELECT p.page_id, CAST(len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(html, '<li')) AS BIGINT) AS items, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS BIGINT) AS text_chars FROM pages p""")
def str22_page_headings(spark, sf_dir):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n("<h[1-6][^>]*>").alias("headings"), n("<li").alias("items"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("text_chars"))


@query("SELECT p_partkey AS id, lower(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS name, CASE WHEN contains(lower(p_name), 'steel') OR contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_name), 'brass') OR contains(lower(p_type), 'brass') THEN 'alloy' ELSE 'other' END AS area FROM part")
def str34_str36_normalise_and_classify(spark, sf_dir):
    both = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(F.trim(F.regexp_replace("p_name", "[^A-Za-z0-9]+", " "))).alias("name"), T.first_keyword(both, [("steel", "metal"), ("brass", "alloy")], "other").alias("area"))


@query("SELECT doc_id, least((CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'eau') AS INT) + CAST(contains(lower(text), 'ung') AS INT) + CAST(contains(lower(text), 'ing') AS INT) + CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'con') AS INT)) / 5, 1.0) AS relevance FROM documents")
def str44_relevance(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.relevance(F.col("text"), ["the", "eau", "ung", "ing", "tion", "con"]).alias("relevance"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[Tt]he ([a-z]+tion)')) AS BIGINT) AS mentions, list_sort(list_distinct(regexp_extract_all(text, '[Tt]he ([a-z]+tion)', 1))) AS words FROM documents")
def str50_cross_references(spark, sf_dir):
    hits = F.regexp_extract_all("text", F.lit("[Tt]he ([a-z]+tion)"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(hits).cast("long").alias("mentions"), F.array_sort(F.array_distinct(hits)).alias("words"))


@query("""WITH l AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line FROM documents), d AS (SELECT DISTINCT doc_id, regexp_replace(line, '\\d+', '#', 'g') AS norm FROM l WHERE length(line) > 20), n AS (SELECT norm, count(*) AS docs FROM d GROUP BY 1) SELECT norm, docs FROM n WHERE docs >= 3""")
def agg22_repeating_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 20)
    norm = lines.select("doc_id", T.masked_digits("line").alias("norm")).distinct()
    return norm.groupBy("norm").agg(F.count("*").alias("docs")).where("docs >= 3")


@query("""WITH s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS i, len(list_distinct(list_concat(a.w, b.w))) AS u FROM s a JOIN s b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN u = 0 THEN 1.0 ELSE i / u END AS jaccard FROM p""")
def set5_jaccard(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    answer = s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("said"))
    return s.join(answer, ["conv_id", "turn"]).select("conv_id", "turn", jaccard("w", "said").alias("jaccard"))


@query("SELECT code, part FROM (SELECT DISTINCT 'B.' || (p_size % 12) || '.' || (p_partkey % 30) AS code, p_partkey % 30 AS part FROM part) ORDER BY 1")
def srt1_natural_sort(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("B."), (F.col("p_size") % 12).cast("string"), F.lit("."), (F.col("p_partkey") % 30).cast("string")).alias("code"), (F.col("p_partkey") % 30).alias("part")).distinct()
    return rows.orderBy(T.natural_key("code"))


@query(r"""WITH l AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) SELECT doc_id, pos, (length(line) > 100 OR regexp_matches(line, '[A-Z][a-z]+,? [A-Z]\.') OR len(list_filter(string_split_regex(line, '\s+'), lambda w: (length(w) <= 2 AND NOT list_contains(['a', 'an', 'as', 'at', 'by', 'de', 'du', 'en', 'es', 'if', 'in', 'is', 'it', 'la', 'le', 'of', 'on', 'or', 'se', 'to', 'un', 'we'], lower(w))) OR starts_with(w, '-'))) >= 2) AS garbage FROM l""")
def fil5_garbage_header(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), T.garbage_header(F.col("line")).alias("garbage"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) SELECT page_id, (length(title) > 100 OR regexp_matches(title, '[A-Z][a-z]+,? [A-Z]\.') OR len(list_filter(string_split_regex(title, '\s+'), lambda w: (length(w) <= 2 AND NOT list_contains(['a', 'an', 'as', 'at', 'by', 'de', 'du', 'en', 'es', 'if', 'in', 'is', 'it', 'la', 'le', 'of', 'on', 'or', 'se', 'to', 'un', 'we'], lower(w))) OR starts_with(w, '-'))) >= 2) AS garbage FROM t""")
def fil5_garbage_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")).select("page_id", T.garbage_header(F.col("title")).alias("garbage"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def fil16_nested_path(spark, sf_dir):
    v = F.parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@query("SELECT doc_id, sha256(text) AS sha, left(sha256(text), 16) AS short FROM documents")
def mth11_hashes(spark, sf_dir):
    sha = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", sha.alias("sha"), F.left(sha, F.lit(16)).alias("short"))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\f\r]+', ' ', 'g')) AS t FROM documents), s AS (SELECT item_id, UNNEST(string_split_regex(text, '[.!?][ \t\n\f\r]+|\n')) AS x, generate_subscripts(string_split_regex(text, '[.!?][ \t\n\f\r]+|\n'), 1) - 1 AS pos FROM benchmark),
n AS (SELECT item_id, pos, left(trim(regexp_replace(lower(x), '[ \t\n\f\r]+', ' ', 'g')), 60) AS needle FROM s) SELECT doc_id, item_id, pos, CAST(strpos(t, needle) AS BIGINT) AS "at" FROM d JOIN n ON length(needle) >= 20 AND contains(t, needle)""")
def jn23_substring_search(spark, sf_dir):
    from corvane.operators.joins import containing

    needles = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s")).select("item_id", F.col("pos").cast("long").alias("pos"), F.left(T.one_line(F.col("s")), F.lit(60)).alias("needle"))
    docs = table(spark, sf_dir, "documents").select("doc_id", T.one_line(F.col("text")).alias("text"))
    return containing(docs, needles.where(F.length("needle") >= 20), "text", "needle").select("doc_id", "item_id", "pos", F.instr("text", F.col("needle")).cast("long").alias("at"))


@query("""WITH h AS (SELECT d.doc_id, UNNEST(string_split(d.text, chr(10))) AS line FROM documents d), n AS (SELECT sha256(line) AS s, count(*) AS c FROM h WHERE length(line) > 0 GROUP BY 1) SELECT c AS copies, count(*) AS lines FROM n GROUP BY 1""")
def data_op14_line_copies(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 0)
    return lines.groupBy(F.sha2("line", 256).alias("s")).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("lines"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat, count(*) AS turns FROM conversations GROUP BY conv_id")
def src29_render(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("s"), F.count("*").alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("chat"), "turns")


typed(str26_visit_day="confidence DOUBLE", str1_identifier_chain="confidence DOUBLE", str2_date="confidence DOUBLE", str3_numeric="confidence DOUBLE", str5_short_text="confidence DOUBLE", str9_statement="confidence DOUBLE", str13_format_detect="confidence DOUBLE")
