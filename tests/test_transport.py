"""Transport files: numbers, texts, heads."""

import struct

import pandas as pd
import pytest

from corvane.sources import transport


def test_numbers_round_trip():
    for x in (0.0, 1.0, -1.0, 0.1, 100.25, -3.5e10, 1e-9, 16.0, 15.999999999, 2.0**52 + 1):
        assert transport.from_hex_float(transport.hex_float(x)) == x
    assert transport.hex_float(1.0) == bytes.fromhex("4110000000000000") and transport.hex_float(-118.625) == bytes.fromhex("c276a00000000000")
    assert transport.from_hex_float(transport.hex_float(None)) is None and transport.from_hex_float(transport.hex_float(float("nan"))) is None
    with pytest.raises(ValueError):
        transport.hex_float(1e300)


def test_files_are_read_by_others(tmp_path):
    """pandas has a reader of its own."""
    rows = [("ST1", 1.0, "a"), ("ST1", 2.5, "bcd"), ("ST2", None, "")]
    data = transport.file_of("TS", "Trial Summary", [("STUDYID", False), ("TSSEQ", True), ("TSVAL", False)], rows)
    assert len(data) % 80 == 0
    (tmp_path / "ts.xpt").write_bytes(data)
    frame = pd.read_sas(tmp_path / "ts.xpt", format="xport", encoding="utf-8")
    assert list(frame.columns) == ["STUDYID", "TSSEQ", "TSVAL"] and frame["TSSEQ"].tolist()[:2] == [1.0, 2.5] and frame["TSVAL"].tolist()[:2] == ["a", "bcd"]
    assert list(transport.rows_of(data)) == [{"STUDYID": s, "TSSEQ": n, "TSVAL": v} for s, n, v in rows]
    assert struct.calcsize(">hhhh8s40s8shhh2s8shhl52s") == transport.VARIABLE


def test_files_beyond_a_value_are_refused(spark):
    rows = spark.createDataFrame([("ST1", float(i)) for i in range(50)], "STUDYID string, TSSEQ double")
    (r,) = transport.transport_files(rows, "STUDYID", "TS", ["TSSEQ"]).collect()
    assert [x["TSSEQ"] for x in transport.rows_of(bytes(r["content"]))] == list(map(float, range(50)))
    assert transport.held(b"ab", 2) == b"ab"
    with pytest.raises(ValueError, match="xport"):
        transport.held(b"abc", 2)


def test_dimensions_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    from corvane.sources.readers import dims

    schema = "query_id string, section_id string, priority long, required boolean"
    good = "- {query_id: q1, section_id: B.1, priority: 1, required: true}\n- {query_id: q2, section_id: B.2, priority: 2, required: false}\n"
    (tmp_path / "q.yaml").write_text(good)
    assert sorted(map(tuple, dims(spark, str(tmp_path / "q.yaml"), schema, ["query_id", "section_id"]).collect())) == [("q1", "B.1", 1, True), ("q2", "B.2", 2, False)]
    for name, text, error in (("type", good.replace("priority: 1", "priority: high"), "priority"), ("missing", good.replace("section_id: B.1", "section_id: null"), "without section_id")):
        (tmp_path / f"{name}.yaml").write_text(text)
        with pytest.raises(Exception, match=error):
            dims(spark, str(tmp_path / f"{name}.yaml"), schema, ["query_id", "section_id"]).collect()


def test_a_large_study_is_rows_in_parts(spark, monkeypatch):
    """Neither the writer nor the reader of a study's file makes more rows Python objects than a part has."""
    import pyarrow as pa

    from corvane.sources import transport as X

    n = X.ROWS * 2 + 17
    rows = spark.range(n).selectExpr("'S1' AS STUDYID", "CAST(id AS DOUBLE) AS SEQ", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('ä', id % 1000) END AS TERM")
    files = X.transport_files(rows, "STUDYID", "TS", ["SEQ"])
    content = files.first()["content"]
    plain = [("S1", float(i), None if i % 3 == 0 else f"ä{i % 1000}") for i in range(n)]
    assert content == X.file_of("TS", "", [("STUDYID", False), ("SEQ", True), ("TERM", False)], plain)
    assert [(r["STUDYID"], r["SEQ"], r["TERM"] or None) for r in X.rows_of(bytes(content))] == plain
    parts = []

    class Rows:
        def mapInArrow(self, run, _):
            parts.extend(b.num_rows for b in run([pa.RecordBatch.from_pydict({"content": [bytes(content)]})]))

        def select(self, *_):
            return self

    X.transport_rows(Rows(), "STUDYID string, SEQ double, TERM string")
    assert parts == [X.ROWS, X.ROWS, 17]
