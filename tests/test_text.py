"""Literal cases of the text and schedule operators."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import joins, studies, windows
from corvane.operators.sets import jaccard
from corvane.sources import readers


@pytest.mark.parametrize(
    "label, day, method",
    [("Cycle 3 Day 1", 43, "cycle_day"), ("C2D8", 29, "cycle_day"), ("Week 4", 22, "week"), ("Month 2", 31, "month"), ("Screening", -14, "screening"), ("Baseline (Day 1)", 1, "baseline_day1"), ("EOT", 0, "eot"), ("Follow-up", 0, "follow_up"), ("Cycle 4", 64, "cycle_only"), ("Every 2 cycles thereafter", 0, "repeating"), ("Visit X", 0, "unresolved"), ("C1 / D15", 15, "cycle_day"), ("wk12", 78, "week"), ("cycle 2, dosing", 22, "cycle_only"), ("q6w thereafter", 0, "repeating"), ("Post-treatment FU", 0, "follow_up"), ("period 3", 0, "unresolved"), ("Day -1", 0, "unresolved")],
)
def test_visit_day(spark, label, day, method):
    row = spark.createDataFrame([(label,)], "label string").select(T.visit_day(F.col("label")).alias("v")).first()["v"]
    assert (row["day"], row["method"]) == (day, method)


def test_milestones(spark):
    rows = spark.createDataFrame([(1, "DAY", 15, 21), (1, "EOT", 0, 21), (1, "FU", 0, 21), (2, "EOT", 0, 21)], "doc int, label string, day int, cycle int")
    got = {(r["doc"], r["label"]): r["filled_day"] for r in windows.milestones(rows, "doc", "label", "day", "cycle").collect()}
    assert got == {(1, "DAY"): 15, (1, "EOT"): 16, (1, "FU"): 45, (2, "EOT"): 2}


def test_empty_sets(spark):
    row = spark.sql("SELECT array() AS a, array(1) AS b").select(jaccard("a", "a").alias("x"), jaccard("a", "b").alias("y"), jaccard("a", "a", 0.0).alias("z")).first()
    assert tuple(row) == (1.0, 0.0, 0.0)


def test_cell_tie_is_false(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "k string, m boolean")
    got = {r["k"]: (r["scheduled"], r["confidence"], r["disputed"]) for r in studies.cell_votes(rows, ["k"], "m").collect()}
    assert got == {"a": (False, 0.5, True), "b": (True, 1.0, False)}


def test_diff_of_nulls(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (3, "q", "z")], "k int, f string, g string")
    b = spark.createDataFrame([(1, None, "x"), (2, "v", "y"), (4, "q", "z")], "k int, f string, g string")
    got = {(r["k"], r["change"], r["field"], r["after"]) for r in joins.diff(a, b, ["k"], ["f", "g"]).collect()}
    assert got == {(2, "changed", "f", "v"), (3, "removed", None, None), (4, "added", None, None)}


def test_packing_and_overlaps(spark):
    row = spark.sql("SELECT array('aaaa', 'bb', 'cc', 'dddddddddd') AS s, array(named_struct('start', 0L, 'end', 5L), named_struct('start', 3L, 'end', 9L), named_struct('start', 5L, 'end', 7L)) AS o, array() AS e")
    got = row.select(windows.packed(F.col("s"), 7).alias("p"), windows.without_overlaps(F.col("o")).alias("k"), windows.packed(F.col("e").cast("array<string>"), 7).alias("n")).first()
    assert got["p"] == ["aaaa bb", "cc", "dddddddddd"]
    assert [tuple(x) for x in got["k"]] == [(0, 5), (5, 7)]
    assert got["n"] == []


def test_same_source_twice_is_boosted(spark):
    rows = spark.createDataFrame([("n", "v", 0.9), ("n", "v", 0.5)], "name string, visit string, confidence double")
    row = studies.merged_pairs({"t": rows}, ["name", "visit"]).first()
    assert (row["confidence"], row["multi_source"]) == (0.95, False)


def test_sniff(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.txt").write_bytes(b'<?xml version="1.0"?><ODM/>')
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04")
    (tmp_path / "NCT00000001_1.0.pdf").write_bytes(b"\x00")
    rows = readers.sniffed(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["format"]) for r in rows.collect()) == [("NCT00000001_1.0.pdf", "pdf"), ("a.bin", "pdf"), ("b.txt", "ctr_xml"), ("c.docx", "docx")]
    assert [(r["nct_id"], r["version"]) for r in readers.manifest(rows).collect()] == [("NCT00000001", "1.0")]


def test_sections_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r", "B.3", 0.8, "2024-01-01T00:00:00Z")], "run_id string, section_code string, confidence_score double, extraction_timestamp_utc string")
    full = rows.select(*(F.col(n) if n in rows.columns else F.lit(None).alias(n) for n in [x.split()[0] for x in readers.SECTIONS.split(", ")]))
    readers.write_declared(full, str(tmp_path / "s"), readers.SECTIONS)
    back = readers.declared(spark, str(tmp_path / "s"), readers.SECTIONS)
    assert readers.checked_sections(back).first()["section_code"] == "B.3"
    with pytest.raises(ValueError):
        readers.write_declared(full.limit(0), str(tmp_path / "t"), readers.SECTIONS)
    with pytest.raises(Exception):
        readers.checked_sections(back.withColumn("confidence_score", F.lit(None).cast("float"))).collect()


def test_structured_protocols(spark):
    doc = '{"sections": [{"code": "B.1", "title": "T", "text": "x"}], "visits": [{"id": "v1", "name": "Day 1", "day": 1}], "activities": [{"name": "ECG", "cells": [{"visit": "v1", "status": "Optional"}, {"visit": "v2", "status": "none"}]}]}'
    t = readers.m11_tables(spark.createDataFrame([("p", doc)], "id string, j string"), "j", "id")
    assert [(r["activity"], r["visit"], r["scheduled"]) for r in t["instances"].collect()] == [("ECG", "v1", True), ("ECG", "v2", False)]
    assert t["timepoints"].first()["day"] == 1 and t["sections"].first()["code"] == "B.1"


@pytest.mark.parametrize(
    "line, cites",
    [
        ("Alder, B. and Moss, C. (2021). Outcomes of a long observation in small groups. Journal 4, 5.", True),
        ("[12] Alder BC, Moss D. Outcomes of a long observation in small groups. Journal 2021; 4: 5.", True),
        ("3. Alder B, Moss D. Outcomes of a long observation in small groups. Journal 2021; 4: 5.", True),
        ("see the full data set at https://doi.org/10.5555/abc.def-9 which is open to all readers", True),
        ("the record is listed with all of its abstracts under PMID: 123456 in the public index", True),
        ("3. Patients who had an earlier treatment of any kind within the last four weeks are excluded.", False),
        ("outcomes improved in small groups (Alder et al., 2021) and were stable in larger ones after that", False),
        ("Alder, B. (2021). Short.", False),
    ],
)
def test_citations(spark, line, cites):
    from corvane.functions.parsing import is_citation

    assert spark.createDataFrame([(line,)], "line string").select(is_citation(F.col("line")).alias("c")).first()["c"] is cites


def test_cycle_lengths(spark):
    rows = spark.createDataFrame([("a 28-day cycle",), ("Q3W dosing",), ("every 14 days",), ("42 day treatment cycle",), ("none",)], "t string")
    assert [r["n"] for r in rows.select(T.cycle_length("t").alias("n")).collect()] == [28, 21, 14, 42, 21]


def test_articles_of_a_small_file_are_parsed_in_many_tasks(spark):
    one = "<S>" + "".join(f"<PubmedArticle><PMID>{i}</PMID><ArticleTitle>t{i}</ArticleTitle><Abstract><AbstractText>a{i}</AbstractText></Abstract></PubmedArticle>" for i in (1, 2)) + "</S>"
    found = readers.articles(spark.createDataFrame([(one,)] * 200, "x string").coalesce(1), "x").withColumn("task", F.spark_partition_id())
    assert found.groupBy("pmid", "title", "abstract").count().orderBy("pmid").collect() == [("1", "t1", "a1", 200), ("2", "t2", "a2", 200)]
    assert found.select("task").distinct().count() >= 4
