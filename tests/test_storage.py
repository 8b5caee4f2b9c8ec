"""Artifact versions, committed stages, keyed tables and metadata documents."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import stages as S
from corvane.sources import define_xml as X
from corvane.sources.artifacts import ArtifactStore, ImmutableArtifact

ARTIFACT = "key string, content binary, content_type string, immutable boolean"


def artifacts(spark, *rows):
    return spark.createDataFrame([(k, c, "text/plain", f) for k, c, f in rows], ARTIFACT)


def test_versions(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path / "a"))
    assert store.list_versions("x").count() == 0 and store.damaged().count() == 0
    made = store.put(artifacts(spark, ("x", b"one", False), ("fixed", b"f", True), ("empty", b"", None)), "run1", "me", source_hash="s")
    assert {(r["key"], r["version"], r["size"], r["run_id"], r["source_hash"]) for r in made.collect()} == {("x", 1, 3, "run1", "s"), ("fixed", 1, 1, "run1", "s"), ("empty", 1, 0, "run1", "s")}
    store.put(artifacts(spark, ("x", b"two", False), ("y", b"a", False), ("y", b"b", False)), "run2", "me")
    assert [r["version"] for r in store.list_versions("x").collect()] == [1, 2] and [r["version"] for r in store.list_versions("y").collect()] == [1, 2]
    assert (store.get("x"), store.get("x", 1), store.get("x", 2), store.get("empty")) == (b"two", b"one", b"two", b"")
    with pytest.raises(FileNotFoundError):
        store.get("x", 3)
    with pytest.raises(FileNotFoundError):
        store.get("none")
    assert store.lineage("run2").count() == 3
    assert {r["key"]: bytes(r["content"]) for r in store.contents().collect()}["x"] == b"two"
    # the same bytes again are a version of their own
    store.put(artifacts(spark, ("x", b"two", False), ("z", b"same", False), ("z", b"same", False)), "run3", "me")
    assert store.list_versions("x").count() == 3 and store.list_versions("z").count() == 2 and store.get("z", 2) == b"same"
    assert store.damaged().count() == 0


def test_immutable_keys_are_refused(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path / "a"))
    store.put(artifacts(spark, ("fixed", b"f", True), ("free", b"1", False)), "run1", "me")
    for rows in ([("fixed", b"g", False)], [("fixed", b"g", True)], [("free", b"2", True)], [("n", b"1", True), ("n", b"2", False)]):
        with pytest.raises(ImmutableArtifact):
            store.put(artifacts(spark, ("other", b"o", False), *rows), "run2", "me")
    assert store.lineage().count() == 2 and store.get("fixed") == b"f"
    made = store.put(artifacts(spark, ("fixed", b"g", False), ("other", b"o", False)), "run3", "me", skip_refused=True)
    assert [r["key"] for r in made.collect()] == ["other"]


def test_uncommitted_batches_are_not_read(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path / "a"))
    store.put(artifacts(spark, ("x", b"one", False)), "run1", "me")
    # what a killed writer leaves: a batch without lineage
    artifacts(spark, ("x", b"lost", False)).write.parquet(str(tmp_path / "a" / "batches" / "dead"))
    assert store.get("x") == b"one" and store.list_versions("x").count() == 1


def doubled(rows, by=2):
    return rows.withColumn("v", F.col("v") * by)


def counted(rows, by=2):
    return rows.groupBy("k").agg(F.sum("v").alias("v"))


def test_stages_resume(spark, tmp_path):
    calls = []

    def failing(rows, by=2):
        calls.append("failing")
        if len(calls) == 1:
            raise RuntimeError("killed")
        return rows.withColumn("v", F.col("v") + 1)

    rows = spark.range(100).select((F.col("id") % 5).alias("k"), F.col("id").alias("v"))
    stages, plan = S.Stages(spark, str(tmp_path / "s")), [("double", doubled), ("fail", failing), ("count", counted)]
    with pytest.raises(RuntimeError):
        stages.run(plan, rows)
    assert [r["stage"] for r in stages.commits().collect()] == ["double"]
    want = sorted(map(tuple, counted(doubled(rows).withColumn("v", F.col("v") + 1)).collect()))
    assert sorted(map(tuple, stages.run(plan, rows).collect())) == want
    # all is committed: nothing runs again, whatever the order of rows
    assert sorted(map(tuple, stages.run(plan, rows.orderBy(F.desc("v")).repartition(7)).collect())) == want and len(calls) == 2
    stages.run(plan, rows.where("v < 99"))
    stages.run(plan, rows, by=3)
    assert len(calls) == 4 and stages.commits().count() == 9
    assert set(stages.loaded(S.input_hash(rows))) == {"double"}


def test_input_hash(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1.5), (2, "y", 1.5)], "a int, b string, c double")
    same = S.input_hash(a)
    assert same == S.input_hash(a.repartition(3, "b")) and same != S.input_hash(a.dropDuplicates()) and same != S.input_hash(a.withColumnRenamed("c", "d"))
    assert same != S.input_hash(a.withColumn("b", F.when(F.col("a") == 1, "z").otherwise(F.col("b")))) and S.input_hash(a.limit(0)) == S.input_hash(a.where("a > 5"))


def test_upsert_rewrites_touched_parts_only(spark, tmp_path):
    import os

    path = str(tmp_path / "t")
    old = [(i, "old", i) for i in range(200)]
    S.create_keyed(spark.createDataFrame(old, "id int, v string, ts int"), path, ["id"], parts=16)
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    new = [(3, "new", 10), (7, "late", 1), (500, "added", 1), (3, "newest", 11), (9, "tie", 9), (11, "none", None)]
    n = S.upsert(spark.createDataFrame(new, "id int, v string, ts int"), path, ["id"], "ts", parts=16)
    after = files()
    kept = set(before) & set(after)
    assert 1 <= n <= 5 and len({os.path.dirname(f) for f in set(after) - kept}) == n and all(before[f] == after[f] for f in kept)
    got = {r["id"]: (r["v"], r["ts"]) for r in spark.read.parquet(path).collect()}
    want = {i: (v, t) for i, v, t in old} | {3: ("newest", 11), 500: ("added", 1), 9: ("tie", 9)}
    assert got == want
    assert S.upsert(spark.createDataFrame([], "id int, v string, ts int"), path, ["id"], "ts", parts=16) == 0


def test_metadata_documents(spark):
    ts = spark.createDataFrame([("S", 1, "A<B", 1.0), ("S", 2, "C & D", None), ("S", 2, None, 2.0)], "STUDYID string, TSSEQ int, TSVAL string, TSNUM double")
    dm = spark.createDataFrame([("S", "F")], "STUDYID string, SEX string")
    lists = X.code_lists(ts, "TS", ["TSVAL"])
    xml = X.to_xml({"TS": ts.schema, "DM": dm.schema}, "ST1", lists, {("TS", "TSVAL"): "Protocol"}, {"TS": "ab" * 32})
    docs = spark.createDataFrame([("d", xml), ("bad", "<ODM>"), ("null", None)], "doc string, xml string")
    got = {(r["domain"], r["variable"]): tuple(r[3:]) for r in X.variables(docs, "doc", "xml").collect()}
    assert got == {
        ("TS", "STUDYID"): ("text", 1, False, None, None), ("TS", "TSSEQ"): ("integer", 2, False, None, None), ("TS", "TSVAL"): ("text", 3, False, "CL.TS.TSVAL", "Protocol"), ("TS", "TSNUM"): ("float", 4, False, None, None),
        ("DM", "STUDYID"): ("text", 1, False, None, None), ("DM", "SEX"): ("text", 2, False, None, None),
    }
    assert sorted(r["item"] for r in X.list_items(docs, "doc", "xml").collect()) == ["A<B", "C & D"]
    assert "sha256 " + "ab" * 32 in xml and 'DefineVersion="2.1.0"' in xml


def test_metadata_issues(spark):
    xml = """<ODM xmlns="http://www.cdisc.org/ns/odm/v1.3"><ItemGroupDef Name="ts"><ItemRef ItemOID="a"/><ItemRef ItemOID="b"/><ItemRef ItemOID="gone"/></ItemGroupDef><ItemGroupDef Name="XX"><ItemRef ItemOID="c"/></ItemGroupDef>
    <ItemDef OID="a" Name="TSSEQ"><CodeListRef CodeListOID="MINE"/></ItemDef><ItemDef OID="b" Name="TSLOST"><CodelistRef CodelistOID="OTHER"/></ItemDef><ItemDef OID="c" Name="V"><CodeListRef CodeListOID="CL.X"/></ItemDef><CodeList OID="MINE"/></ODM>"""
    docs = spark.createDataFrame([(1, xml)], "doc int, xml string")
    actual = spark.createDataFrame([("TS", "TSSEQ"), ("TS", "STUDYID")], "domain string, variable string")
    assert sorted(map(tuple, X.issues(docs, "doc", "xml", actual).collect())) == [(1, "codelist_ref", "TS", "TSLOST"), (1, "structural_mismatch", "TS", "TSLOST")]
