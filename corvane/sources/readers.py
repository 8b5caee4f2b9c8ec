"""Readers and writers with declared schemas: text blocks, tables, sections, study-design tables, registries, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.joins import spread

# Schemas of the persistent tables.
TEXT_BLOCKS = "run_id string, source_registry_id string, source_sha256 string, page_number int, block_index int, text string, block_type string, extraction_timestamp_utc string"
TABLES = "run_id string, source_registry_id string, source_sha256 string, page_number int, extractor_used string, table_index int, header_row array<string>, data_rows array<array<string>>, extraction_timestamp_utc string"
SECTIONS = "run_id string, source_run_id string, source_sha256 string, registry_id string, section_code string, section_name string, content_json string, confidence_score float, review_required boolean, legacy_format boolean, extraction_timestamp_utc string, content_text string"
EPOCHS = "run_id string, registry_id string, epoch_id string, epoch_name string, epoch_type string, epoch_order int"
TIMEPOINTS = "run_id string, registry_id string, timepoint_id string, epoch_id string, visit_name string, day_offset int, window_early int, window_late int, mandatory boolean, visit_type string, repeat_cycle string, conditional_rule string, review_required boolean"
ACTIVITIES = "run_id string, registry_id string, activity_id string, activity_name string, activity_type string"
INSTANCES = "run_id string, registry_id string, instance_id string, activity_id string, timepoint_id string, scheduled boolean"
SYNONYMS = "run_id string, registry_id string, original_text string, canonical_label string, method string, confidence float, review_required boolean"


def sniff(content: Column, path: Column) -> Column:
    """The format of a file by its first 512 bytes, else by its extension."""
    head = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    name = F.lower(path)
    return (
        F.when(head.startswith("%pdf"), "pdf")
        .when(F.contains(head, F.lit("m11")) & (F.contains(head, F.lit("<")) | F.contains(head, F.lit("{"))), "m11")
        .when(head.startswith("<?xml") | F.contains(head, F.lit("<odm")), "ctr_xml")
        .when(head.startswith("pk"), F.when(name.endswith(".docx"), "docx").otherwise("zip"))
        .when(name.endswith(".pdf"), "pdf").when(name.endswith(".xml"), "ctr_xml").when(name.endswith(".docx"), "docx").when(name.endswith(".json"), "json")
        .otherwise("unknown")
    )


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """path, length, format and sha256 of every file of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", sniff(F.col("content"), F.col("path")).alias("format"), F.sha2("content", 256).alias("sha256"))


def manifest(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Study id, version and short hash of files named id_version.pdf, in path order."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    pattern = r"^(NCT\d{8})_(\d+\.\d+)\.pdf$"
    rows = files.where(name.rlike(pattern)).select(F.regexp_extract(name, pattern, 1).alias("nct_id"), F.regexp_extract(name, pattern, 2).alias("version"), F.left("sha256", F.lit(16)).alias("file_sha"), "path").orderBy("path")
    return rows if limit is None else rows.limit(limit)


def declared(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table under its declared schema; columns that it lacks are null."""
    return spark.read.schema(schema).parquet(path)


def checked_sections(sections: DataFrame) -> DataFrame:
    """Sections, failing on a null confidence or a blank timestamp."""
    bad = F.col("confidence_score").isNull() | F.coalesce(F.trim("extraction_timestamp_utc") == "", F.lit(True))
    return sections.withColumn("confidence_score", F.when(bad, F.raise_error(F.lit("a section without confidence or timestamp"))).otherwise(F.col("confidence_score")))


def write_declared(rows: DataFrame, path: str, schema: str, mode: str = "errorifexists") -> None:
    """Parquet with the declared columns and types; an empty table is refused."""
    if rows.isEmpty():
        raise ValueError("no rows to write")
    fields = T.StructType.fromDDL(schema).fields
    rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)).write.mode(mode).option("compression", "snappy").parquet(path)


def text_blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of a Markdown text: blank lines separate them; heading, list, table or paragraph."""
    rows = docs.select(F.col(id_col).alias("source_registry_id"), F.posexplode(F.split(F.col(text_col), r"\n\s*\n|\n")).alias("block_index", "text")).where(F.trim("text") != "")
    return rows.withColumn("block_type", block_type(F.col("text")))


def block_type(text: Column) -> Column:
    return (
        F.when(text.rlike(r"^#{1,6}\s+\S") | (text.rlike(r"^\d+(\.\d+)*\.?\s+[A-Z]") & (F.length(text) <= 120)), "heading")
        .when(text.rlike(r"^\s*(?:[-*]\s+|\d+[.)]\s+|[a-z][.)]\s+)"), "list")
        .when(text.rlike(r"\|.*\|"), "table")
        .otherwise("paragraph")
    )


def xml_blocks(files: DataFrame, xml_col: str, id_col: str) -> DataFrame:
    """Text of the description elements of ODM documents, in document order."""
    texts = F.xpath(xml_col, F.lit("//*[local-name()='TranslatedText']/text()"))
    names = F.xpath(xml_col, F.lit("//*[local-name()='ItemDef' or local-name()='FormDef' or local-name()='StudyEventDef']/@Name"))
    one = lambda c, kind: files.select(F.col(id_col).alias("source_registry_id"), F.posexplode(c).alias("at", "text"), F.lit(kind).alias("block_type"))
    return one(names, "heading").unionByName(one(texts, "paragraph")).withColumn("text", F.trim("text")).where("text <> ''")


def m11_tables(protocols: DataFrame, json_col: str, id_col: str) -> dict[str, DataFrame]:
    """Sections and schedule of structured protocols: cells that are required, conditional or optional count as scheduled."""
    schema = "sections array<struct<code:string,title:string,text:string>>, visits array<struct<id:string,name:string,day:int>>, activities array<struct<name:string,cells:array<struct<visit:string,status:string>>>>"
    rows = protocols.select(F.col(id_col).alias("registry_id"), F.from_json(json_col, schema).alias("p"))
    sections = rows.select("registry_id", F.inline("p.sections"))
    visits = rows.select("registry_id", F.inline("p.visits"))
    cells = rows.select("registry_id", F.explode("p.activities").alias("a")).select("registry_id", F.col("a.name").alias("activity"), F.inline("a.cells"))
    return {"sections": sections, "timepoints": visits, "instances": cells.withColumn("scheduled", F.lower("status").isin("required", "conditional", "optional"))}


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; malformed ones drop."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def registry_metadata(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Cached registry records, keyed by the id in their file names."""
    rows = spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("nct_id", F.regexp_extract("path", r"(NCT\d{8})", 1)).where("nct_id <> ''").drop("path")


def registry_columns(raw: Column | str) -> list[Column]:
    """Flat columns of a registry record."""
    v = F.try_parse_json(raw)
    at = lambda path, kind="string": F.try_variant_get(v, path, kind)
    module = "$.protocolSection."
    return [
        at(module + "identificationModule.nctId").alias("nct_id"), at(module + "identificationModule.briefTitle").alias("title"), at(module + "statusModule.overallStatus").alias("status"), at(module + "sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"),
        at(module + "designModule.phases", "array<string>").alias("phases"), at(module + "designModule.enrollmentInfo.count", "long").alias("enrollment"), at(module + "conditionsModule.conditions", "array<string>").alias("conditions"),
        at(module + "eligibilityModule.eligibilityCriteria").alias("eligibility"), at(module + "statusModule.startDateStruct.date").alias("start_date"), at(module + "outcomesModule.primaryOutcomes", "array<variant>").alias("primary_outcomes"),
    ]


def articles(xml: DataFrame, xml_col: str) -> DataFrame:
    """Article rows of cached search results."""
    article = F.explode(F.arrays_zip(F.xpath(xml_col, F.lit("//PubmedArticle//PMID[1]/text()")).alias("pmid"), F.xpath(xml_col, F.lit("//PubmedArticle//ArticleTitle/text()")).alias("title"), F.xpath(xml_col, F.lit("//PubmedArticle//Abstract/AbstractText[1]/text()")).alias("abstract")))
    # parsing takes far longer than moving, and a small file would be one task
    return spread(xml.select(xml_col)).select(article.alias("a")).select("a.*")


def put_artifacts(artifacts: DataFrame, path: str, run_id: str) -> DataFrame:
    """Write artifacts once (an existing folder is refused) and give the lineage rows to append."""
    artifacts.write.mode("errorifexists").parquet(path)
    return artifacts.select(F.lit(run_id).alias("run_id"), "name", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append JSON lines to an audit or lineage log."""
    rows.write.mode("append").json(path)


def lineage_of(log: DataFrame, run_id: str) -> DataFrame:
    return log.where(F.col("run_id") == run_id).orderBy("id")


def export(rows: DataFrame, path: str, kind: str, columns: list[str] | None = None) -> None:
    """CSV with a header, or JSON lines, of chosen columns."""
    rows = rows.select(*columns) if columns else rows
    if kind == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def markdown(rows: DataFrame) -> DataFrame:
    """One line a row of a Markdown table, under its header lines."""
    columns = rows.columns
    head = rows.sparkSession.createDataFrame([(f"| {' | '.join(columns)} |",), (f"|{'---|' * len(columns)}",)], "line string")
    return head.unionByName(rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |")).alias("line")))


def define_xml(rows: DataFrame, domain: str) -> str:
    """Metadata of a dataset as an ODM fragment; only the schema is read."""
    types = {"string": "text", "double": "float", "int": "integer", "bigint": "integer"}
    items = "".join(f'<ItemDef OID="IT.{domain}.{f.name}" Name="{f.name}" DataType="{types.get(f.dataType.simpleString(), "text")}"/>' for f in rows.schema)
    refs = "".join(f'<ItemRef ItemOID="IT.{domain}.{f.name}" OrderNumber="{i}" Mandatory="{"No" if f.nullable else "Yes"}"/>' for i, f in enumerate(rows.schema, 1))
    return f'<ItemGroupDef OID="IG.{domain}" Name="{domain}" Repeating="Yes">{refs}</ItemGroupDef>{items}'


def cached(rows: DataFrame, now: int, hours: int = 168) -> DataFrame:
    """Cache entries that are not older than their time to live; fetched_at is in epoch seconds."""
    return rows.where(F.lit(now) - F.col("fetched_at") <= hours * 3600)


def latest_per_key(rows: DataFrame, key: list[str], ts: str) -> DataFrame:
    """The last write of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("s")).select(*key, "s.*")


def struct_date(info: Column) -> Column:
    """The date of a registry's date struct in JSON, or '' without one."""
    return F.coalesce(F.get_json_object(info, "$.date"), F.lit(""))


def json_list_length(content: Column, key: str) -> Column:
    """Items of the list at a key; null if there is none."""
    value = F.try_variant_get(F.try_parse_json(content), f"$.{key}", "array<variant>")
    return F.when(F.try_parse_json(content).isNotNull() & value.isNotNull(), F.size(value).cast("long"))


def dims(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A small dimension from JSON lines, or from one YAML file with a list of entries. A wrong type or a missing key raises."""
    if path.endswith((".yaml", ".yml")):
        import yaml  # optional: only these files need it

        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        rows = spark.createDataFrame(yaml.safe_load(text), schema, verifySchema=True)
    else:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    fields = [f.name for f in T.StructType.fromDDL(schema).fields]
    return rows.select(*(F.when(F.col(c).isNull(), F.raise_error(F.lit(f"an entry without {c}"))).otherwise(F.col(c)).alias(c) if c in required else F.col(c) for c in fields))
