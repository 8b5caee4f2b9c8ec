"""The transport data source against the plain reader and pandas."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.sources import transport as X
from corvane.sources import xport


@pytest.fixture(scope="module")
def known(spark):
    xport.register(spark)
    return spark


def frame(spark, n=500):
    k = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("ST"), (k % 7).cast("string")).alias("STUDYID"), k.cast("double").alias("TSSEQ"), F.when(k % 5 != 0, (k - 250) * 1.37).alias("TSNUM"), F.when(k % 3 == 0, F.concat(F.lit("é µ "), k.cast("string"))).otherwise("").alias("TSVAL")
    )


@pytest.mark.parametrize("split", [1, 1000, 1 << 25])
def test_round_trip(known, tmp_path, split):
    path, rows = str(tmp_path / "x"), frame(known).repartition(3)
    rows.write.format("xport").option("textWidth", 24).option("dataset", "TS").option("label", "Trial Summary").mode("append").save(path)
    assert len([f for f in os.listdir(path) if f.endswith(".xpt")]) == 3 and not any(f.startswith(".writing") for f in os.listdir(path))
    back = known.read.format("xport").option("splitBytes", split).load(path)
    assert [(f.name, f.dataType.simpleString()) for f in back.schema] == [("STUDYID", "string"), ("TSSEQ", "double"), ("TSNUM", "double"), ("TSVAL", "string")]
    key = lambda r: r["TSSEQ"]
    assert sorted(back.collect(), key=key) == sorted(rows.collect(), key=key)
    if split == 1000:
        assert back.rdd.getNumPartitions() > 10


def test_files_of_and_for_others(known, tmp_path):
    data = X.file_of("TS", "", [("STUDYID", False), ("TSSEQ", True)], [("A", 1.0), ("", None), ("bcd", -2.5)])
    os.makedirs(tmp_path / "in" / "more")
    (tmp_path / "in" / "a.xpt").write_bytes(data)
    (tmp_path / "in" / "more" / "b.xpt").write_bytes(X.file_of("TS", "", [("TSSEQ", True), ("EXTRA", False)], [(7.0, "e")]))
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"")
    rows = known.read.format("xport").load(str(tmp_path / "in"))
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("A", 1.0, None), ("", None, None), ("bcd", -2.5, None), (None, 7.0, "e")], key=str)
    some = known.read.format("xport").schema("TSSEQ double, NONE string").load(str(tmp_path / "in" / "a.xpt"))
    assert sorted(map(tuple, some.collect()), key=str) == sorted([(1.0, None), (None, None), (-2.5, None)], key=str)
    # pandas miscounts rows whose last record holds blank texts, and reads 0 as a tiny number
    frame(known, 40).where("TSSEQ % 3 = 0 AND TSSEQ > 0").coalesce(1).write.format("xport").option("textWidth", 12).mode("append").save(str(tmp_path / "out"))
    (name,) = [f for f in os.listdir(tmp_path / "out") if f.endswith(".xpt")]
    read = pd.read_sas(tmp_path / "out" / name, format="xport", encoding="utf-8")
    assert read["TSSEQ"].tolist() == list(map(float, range(3, 40, 3))) and read["TSVAL"][0] == "é µ 3"


def test_overwrite_and_refusals(known, tmp_path):
    path = str(tmp_path / "x")
    for n in (30, 20):
        frame(known, n).write.format("xport").mode("overwrite").save(path)
    assert known.read.format("xport").load(path).count() == 20
    frame(known, 5).write.format("xport").mode("append").save(path)
    assert known.read.format("xport").load(path).count() == 25
    with pytest.raises(Exception, match="8 bytes"):
        frame(known, 5).withColumnRenamed("TSVAL", "TOOLONGNAME").write.format("xport").mode("append").save(path)
    with pytest.raises(Exception, match="out of the format's range"):
        frame(known, 5).withColumn("TSNUM", F.lit(1e300)).write.format("xport").mode("append").save(path)
    assert known.read.format("xport").load(path).count() == 25 and not any(f.startswith(".writing") for f in os.listdir(path))


def test_numbers_are_those_of_the_plain_reader():
    rng = np.random.default_rng(1)
    values = [0.0, 1.0, -1.0, 0.1, None, *(rng.normal(size=200) * 10.0 ** rng.integers(-20, 20, 200)).tolist()]
    raw = np.frombuffer(b"".join(X.hex_float(v) for v in values), np.uint8).reshape(-1, 8)
    assert xport.numbers(raw).to_pylist() == [X.from_hex_float(bytes(r)) for r in raw]
